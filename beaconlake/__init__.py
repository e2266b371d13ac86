"""Fleet telemetry analytics expressed as Spark DataFrame, SQL and streaming operators."""
