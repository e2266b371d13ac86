"""Connected components by joins: every node takes the least label around it, then that label's label, until none changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import dropped, temporary, written


def connected(edges: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """``node, label`` for every node of ``edges`` (a, b); the label is the least node of the component. The table's path is added to ``paths``.

    Each round is written to the shared folder and replaces the one before. Labels are pre-aggregated before they are shuffled, so a node
    with very many neighbours is read by a skewed join that Spark splits; the rounds grow with the logarithm of a component's width.
    """
    spark = edges.sparkSession
    with temporary(spark) as own:
        both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", own)
        held: list[str] = []
        labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")), "labels", held)
        while True:
            heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("heard"))
            lower = labels.join(heard, labels["node"] == heard["a"]).select("node", F.least("label", "heard").alias("next"), F.col("label").alias("last"))
            of = labels.select(F.col("node").alias("via"), F.col("label").alias("via_label"))
            jumped = lower.join(of, lower["next"] == of["via"], "left").select("node", F.least("next", F.coalesce("via_label", "next")).alias("label"), "last")
            fresh: list[str] = []
            new = written(jumped, "labels", fresh)
            if new.filter("label <> last").limit(1).count() == 0:
                dropped(spark, fresh)
                if paths is not None:
                    paths += held
                return labels
            dropped(spark, held)
            labels, held = new.select("node", "label"), fresh
