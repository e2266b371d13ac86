"""Registered queries over the provided tables and their SQL twins.

``QUERIES[name](spark, sf_dir)`` and, where SQL can say the same, ``ORACLE_SQL[name]`` for DuckDB; doubles from sums of many terms are rounded on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from beaconlake.functions.tables import kept, shared_folder
from beaconlake.functions.scan import WIDTH, Scan, by_packet, ranges
from beaconlake.operators import metrics, panels, quality, reports, state, trend
from beaconlake.params import METRICS as METRIC_FAMILIES
from beaconlake.params import OFFLINE_SECONDS, PROGRESS_SECONDS, PUSH_SECONDS, SCRAPE_SECONDS, OomParams
from beaconlake.plans import views as v
from beaconlake.sources import frames, sinks, text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The heap of the views' devices, and a window that their packets fill.
P = OomParams(total_heap_bytes=1048576)
P40 = OomParams(window_size=40, total_heap_bytes=1048576)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _seconds(column: str):
    return F.unix_micros(column) / 1e6


# ---------------------------------------------------------------- packets and state

GAPS = v.TELEMETRY + """, gapped AS (
  SELECT *, coalesce((sequence_num - lag(sequence_num) OVER w - 1 + 2 * 65536) % 65536, 0) AS missing_packets FROM telemetry WINDOW w AS (PARTITION BY device_id ORDER BY pkt_no)
), counted AS (
  SELECT *, CASE WHEN missing_packets > 0 THEN 1 ELSE 0 END AS gap, CAST(count(*) OVER w AS BIGINT) AS packet_count,
    CAST(sum(CASE WHEN missing_packets > 0 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS drop_count
  FROM gapped WINDOW w AS (PARTITION BY device_id ORDER BY pkt_no)
)"""


@query(f"WITH {GAPS} SELECT device_id, pkt_no, sequence_num, gap, CAST(missing_packets AS BIGINT) AS missing_packets FROM counted")
def seq_gaps(spark, sf_dir):
    return quality.seq_gaps(v.telemetry(spark, sf_dir)).select("device_id", "pkt_no", "sequence_num", "gap", "missing_packets")


@query(f"WITH {GAPS} SELECT device_id, pkt_no, packet_count, drop_count FROM counted")
def running_counters(spark, sf_dir):
    return quality.running_counters(v.telemetry(spark, sf_dir)).select("device_id", "pkt_no", "packet_count", "drop_count")


@query(f"WITH {GAPS} SELECT device_id, count(*) AS packets, CAST(sum(gap) AS BIGINT) AS seq_gaps, CAST(sum(missing_packets) AS BIGINT) AS missing_packets, round(sum(gap) / count(*), 9) AS loss_ratio FROM counted GROUP BY device_id")
def packet_quality(spark, sf_dir):
    return quality.packet_quality(v.telemetry(spark, sf_dir)).withColumn("loss_ratio", F.round("loss_ratio", 9))


@query(f"WITH {GAPS} SELECT device_id, pkt_no, round(CASE WHEN packet_count > 0 THEN drop_count / packet_count ELSE 0.0 END, 9) AS loss_ratio FROM counted")
def loss_ratio(spark, sf_dir):
    counted = quality.running_counters(v.telemetry(spark, sf_dir))
    return counted.select("device_id", "pkt_no", F.round(quality.loss_ratio(F.col("drop_count"), F.col("packet_count")), 9).alias("loss_ratio"))


@query(f"WITH {v.TELEMETRY} SELECT device_id, pkt_no, cpu_utilization_pct / 100.0 AS cpu_ratio FROM telemetry")
def cpu_ratio(spark, sf_dir):
    return v.telemetry(spark, sf_dir).select("device_id", "pkt_no", metrics.cpu_ratio(F.col("cpu_utilization_pct")).alias("cpu_ratio"))


@query(f"WITH {v.CHANGES} SELECT device_id, pkt_no, epoch, epoch > 0 AS has_baseline FROM epochs")
def keyframe_epoch(spark, sf_dir):
    return state.keyframe_epoch(v.changes(spark, sf_dir)).select("device_id", "pkt_no", "epoch", "has_baseline")


@query(
    f"""WITH {v.CHANGES} SELECT device_id, pkt_no, epoch, last_value(heap_d IGNORE NULLS) OVER w AS heap_free_bytes, last_value(cpu_d IGNORE NULLS) OVER w AS cpu_utilization_pct
    FROM epochs WHERE epoch > 0 WINDOW w AS (PARTITION BY device_id, epoch ORDER BY pkt_no ROWS UNBOUNDED PRECEDING)"""
)
def rebuild_state(spark, sf_dir):
    rebuilt = state.rebuild_state(v.changes(spark, sf_dir), {"heap_d": "heap_free_bytes", "cpu_d": "cpu_utilization_pct"})
    return rebuilt.select("device_id", "pkt_no", "epoch", "heap_free_bytes", "cpu_utilization_pct")


STALE = v.CHANGES + """, sent AS (
  SELECT *, CASE WHEN n - lag(n) OVER (PARTITION BY device_id ORDER BY pkt_no) > 1 THEN pkt_no END AS gap_pkt FROM (SELECT *, pkt_no + 3 * (event_id // 700) AS n FROM epochs)
), carried AS (
  SELECT device_id, pkt_no, last_value(heap_d IGNORE NULLS) OVER w AS heap_free_bytes, last_value(cpu_d IGNORE NULLS) OVER w AS cpu_utilization_pct, last_value(gap_pkt IGNORE NULLS) OVER w AS last_gap_pkt,
    last_value(CASE WHEN heap_d IS NOT NULL THEN pkt_no END IGNORE NULLS) OVER w AS heap_pkt, last_value(CASE WHEN cpu_d IS NOT NULL THEN pkt_no END IGNORE NULLS) OVER w AS cpu_pkt
  FROM sent WHERE epoch > 0 WINDOW w AS (PARTITION BY device_id, epoch ORDER BY pkt_no ROWS UNBOUNDED PRECEDING)
), marked AS (
  SELECT *, coalesce(last_gap_pkt > coalesce(heap_pkt, -1), FALSE) AS heap_stale, coalesce(last_gap_pkt > coalesce(cpu_pkt, -1), FALSE) AS cpu_stale FROM carried
)"""


@query(
    f"""WITH {STALE} SELECT device_id, pkt_no, heap_free_bytes, cpu_utilization_pct, coalesce(last_gap_pkt, -1) AS last_gap_pkt,
    heap_stale, cpu_stale, heap_stale OR cpu_stale AS stale_since_gap FROM marked"""
)
def stale_since_gap(spark, sf_dir):
    """State with marks of values that a lost delta may have changed; the sequence numbers jump at every 700th event."""
    sent = v.changes(spark, sf_dir).withColumn("sequence_num", F.col("pkt_no") + 3 * F.floor(F.col("event_id") / 700))
    marked = state.stale_since_gap(sent, {"heap_d": "heap_free_bytes", "cpu_d": "cpu_utilization_pct"})
    stale = [F.col("heap_free_bytes_stale").alias("heap_stale"), F.col("cpu_utilization_pct_stale").alias("cpu_stale")]
    return marked.select("device_id", "pkt_no", "heap_free_bytes", "cpu_utilization_pct", F.coalesce("last_gap_pkt", F.lit(-1)).alias("last_gap_pkt"), *stale, "stale_since_gap")


KNOWN = v.CHANGES + """, known AS (
  SELECT * FROM (SELECT *, last_value(task_count IGNORE NULLS) OVER (PARTITION BY device_id, epoch ORDER BY pkt_no ROWS UNBOUNDED PRECEDING) AS n FROM epochs WHERE epoch > 0)
  WHERE NOT is_valid_keyframe AND task_idx_d < n
)"""


@query(f"WITH {KNOWN} SELECT device_id, pkt_no, epoch, task_idx_d, state_d FROM known")
def delta_known_task(spark, sf_dir):
    return state.delta_known_task(v.changes(spark, sf_dir)).select("device_id", "pkt_no", "epoch", "task_idx_d", "state_d")


@query(f"WITH {KNOWN} SELECT device_id, pkt_no, epoch, task_idx_d, state_d, coalesce(lag(state_d) OVER (PARTITION BY device_id, epoch, task_idx_d ORDER BY pkt_no), -1) AS state_before FROM known")
def rebuild_task_state(spark, sf_dir):
    return state.rebuild_task_state(v.changes(spark, sf_dir)).select("device_id", "pkt_no", "epoch", "task_idx_d", "state_d", F.coalesce("state_before", F.lit(-1)).alias("state_before"))


@query(f"WITH {v.TELEMETRY} SELECT device_id, pkt_no, state, heap_free_bytes, sequence_num FROM telemetry QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY pkt_no DESC) = 1")
def latest_state(spark, sf_dir):
    return state.latest_state(v.telemetry(spark, sf_dir), ["state", "heap_free_bytes", "sequence_num"])


@query(
    f"""WITH {v.TELEMETRY}, states AS (SELECT device_id, max(pkt_no) AS pkt_no, arg_max(heap_free_bytes, pkt_no) AS heap_free_bytes FROM telemetry GROUP BY device_id)
    SELECT 'dev-' || c_custkey AS device_id, coalesce(pkt_no, 0) AS pkt_no, coalesce(heap_free_bytes, 0) AS heap_free_bytes, s.device_id IS NULL AS created
    FROM customer LEFT JOIN states s ON s.device_id = 'dev-' || c_custkey"""
)
def device_get_or_create(spark, sf_dir):
    wanted = v.table(spark, sf_dir, "customer").select(F.concat(F.lit("dev-"), F.col("c_custkey").cast("string")).alias("device_id"))
    return state.device_get_or_create(wanted, state.latest_state(v.telemetry(spark, sf_dir), ["heap_free_bytes"]), {"pkt_no": 0, "heap_free_bytes": 0})


@query(
    f"""WITH {v.TELEMETRY}, last AS (SELECT device_id, max(arrival_ts) AS last_seen FROM telemetry GROUP BY device_id), clock AS (SELECT max(last_seen) AS now FROM last)
    SELECT device_id, epoch_us(last_seen) AS last_seen_us, epoch_us(now) - epoch_us(last_seen) > 30000000 AS offline FROM last, clock"""
)
def device_offline(spark, sf_dir):
    packets = v.telemetry(spark, sf_dir)
    # the clock is one row, so the join sends that row to every task
    clock = v.table(spark, sf_dir, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("now"))
    found = quality.device_offline(packets, clock, OFFLINE_SECONDS)
    return found.select("device_id", F.unix_micros("last_seen").alias("last_seen_us"), "offline")


@query(
    f"""WITH {v.COUNTERS}, stepped AS (SELECT *, coalesce((raw_ticks - lag(raw_ticks) OVER w + 4294967296) % 4294967296, 0) AS elapsed, first_value(raw_ticks) OVER w AS start FROM counters WINDOW w AS (PARTITION BY device_id ORDER BY pkt_no))
    SELECT device_id, pkt_no, raw_ticks, CAST(elapsed AS BIGINT) AS elapsed, CAST(start + sum(elapsed) OVER (PARTITION BY device_id ORDER BY pkt_no) AS BIGINT) AS unwrapped FROM stepped"""
)
def counter_unwrap(spark, sf_dir):
    return quality.counter_unwrap(v.counters(spark, sf_dir))


@query(
    f"""WITH {v.TELEMETRY}, marked AS (SELECT *, CASE WHEN pkt_no = 1 OR state IS DISTINCT FROM lag(state) OVER (PARTITION BY device_id ORDER BY pkt_no) THEN 1 ELSE 0 END AS starts FROM telemetry),
    runs AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY device_id ORDER BY pkt_no) AS BIGINT) AS run FROM marked)
    SELECT device_id, run, min(state) AS state, min(pkt_no) AS first_pkt, max(pkt_no) AS last_pkt, count(*) AS packets FROM runs GROUP BY device_id, run"""
)
def state_transitions(spark, sf_dir):
    return state.state_transitions(v.telemetry(spark, sf_dir))


@query(
    f"""WITH {v.TELEMETRY}, wide AS (SELECT device_id, pkt_no, lag(pkt_no) OVER w IS NULL AS first, heap_free_bytes AS h, lag(heap_free_bytes) OVER w AS h0, cpu_utilization_pct AS c, lag(cpu_utilization_pct) OVER w AS c0, state AS s, lag(state) OVER w AS s0
      FROM telemetry WINDOW w AS (PARTITION BY device_id ORDER BY pkt_no))
    SELECT device_id, pkt_no, 'heap_free_bytes' AS field, h AS value FROM wide WHERE first OR h IS DISTINCT FROM h0
    UNION ALL SELECT device_id, pkt_no, 'cpu_utilization_pct', c FROM wide WHERE first OR c IS DISTINCT FROM c0
    UNION ALL SELECT device_id, pkt_no, 'state', s FROM wide WHERE first OR s IS DISTINCT FROM s0"""
)
def change_capture(spark, sf_dir):
    return state.change_capture(v.telemetry(spark, sf_dir), ["heap_free_bytes", "cpu_utilization_pct", "state"])


@query(
    f"""WITH {v.TASKS}, snapshots AS (SELECT device_id, snapshot_id, string_agg(task_name, ',' ORDER BY task_idx) AS topology FROM tasks GROUP BY device_id, snapshot_id),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY snapshot_id) AS pkt_no FROM snapshots),
    reasoned AS (SELECT device_id, snapshot_id, pkt_no, CASE WHEN pkt_no = 1 THEN 'first' WHEN pkt_no % 50 = 0 THEN 'forced' WHEN topology IS DISTINCT FROM lag(topology) OVER (PARTITION BY device_id ORDER BY pkt_no) THEN 'topology' END AS reason FROM numbered)
    SELECT device_id, snapshot_id, pkt_no, reason, reason IS NOT NULL AS is_keyframe FROM reasoned"""
)
def snapshot_policy(spark, sf_dir):
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("task_idx", "task_name"))), lambda t: t["task_name"]), ",")
    snapshots = v.tasks(spark, sf_dir).groupBy("device_id", "snapshot_id").agg(names.alias("topology"))
    numbered = Scan(["device_id"], ["snapshot_id"], ranges("snapshot_id", WIDTH), sums={"pkt_no": F.lit(1).cast("long")}).over(snapshots)
    return state.snapshot_policy(numbered, "topology").select("device_id", "snapshot_id", "pkt_no", "reason", "is_keyframe")


@query(f"WITH {v.TELEMETRY} SELECT * FROM (SELECT device_id, pkt_no, heap_free_bytes, row_number() OVER (PARTITION BY device_id ORDER BY pkt_no DESC) AS from_end FROM telemetry) WHERE from_end <= 20")
def last_n_per_device(spark, sf_dir):
    return quality.last_n_per_device(v.telemetry(spark, sf_dir), 20).select("device_id", "pkt_no", "heap_free_bytes", "from_end")


@query(f"WITH {v.TELEMETRY} SELECT device_id, pkt_no, heap_free_bytes FROM telemetry WHERE device_id = 'dev-7'")
def device_filter(spark, sf_dir):
    return v.telemetry(spark, sf_dir).filter("device_id = 'dev-7'").select("device_id", "pkt_no", "heap_free_bytes")


# ---------------------------------------------------------------- leak analytics


def _trend_sql(p: OomParams) -> str:
    w = p.window_size
    return v.TELEMETRY + f""", base AS (
  SELECT *, (epoch_us(arrival_ts) - epoch_us(first_value(arrival_ts) OVER (PARTITION BY device_id ORDER BY pkt_no))) / 1e6 AS x, CAST(heap_free_bytes AS DOUBLE) AS y FROM telemetry
), framed AS (
  SELECT *, count(*) OVER f AS n, min(heap_free_bytes) OVER f AS window_min, max(heap_free_bytes) OVER f AS window_max, min(pkt_no) OVER f AS window_first_pkt, min(x) OVER f = max(x) OVER f AS one_time,
    regr_slope(y, x) OVER f AS slope0, regr_r2(y, x) OVER f AS r20, regr_syy(y, x) OVER f AS syy
  FROM base WINDOW f AS (PARTITION BY device_id ORDER BY pkt_no ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)
), halves AS (
  SELECT a.device_id, a.pkt_no, min(b.heap_free_bytes) AS first_half_min FROM framed a JOIN telemetry b ON a.device_id = b.device_id AND b.pkt_no BETWEEN a.pkt_no - a.n + 1 AND a.pkt_no - a.n + a.n // 2 GROUP BY ALL
), fitted AS (
  SELECT f.*, h.first_half_min, CASE WHEN one_time THEN 0.0 ELSE coalesce(slope0, 0.0) END AS slope, CASE WHEN syy = 0 OR one_time THEN 0.0 ELSE coalesce(r20, 0.0) END AS r2 FROM framed f LEFT JOIN halves h USING (device_id, pkt_no)
), projected AS (
  SELECT *, CASE WHEN n < {p.min_samples} OR one_time THEN -1.0 WHEN slope < 0 AND r2 >= {p.r_squared_threshold} THEN heap_free_bytes / abs(slope)
    WHEN (first_half_min - window_min) / {float(p.total_heap_bytes)} > {p.rolling_min_threshold} THEN -2.0 ELSE -1.0 END AS projection FROM fitted
), series AS (SELECT *, CASE WHEN projection >= 0 THEN 'leak' WHEN projection = -2.0 THEN 'falling minimum' ELSE 'stable' END AS verdict FROM projected)"""


T, T40 = _trend_sql(P), _trend_sql(P40)
_SERIES = "SELECT device_id, pkt_no, n, round(projection, 4) AS projection, verdict FROM series"


def _series(spark, sf_dir, p):
    return trend.oom_series(v.telemetry(spark, sf_dir), p)


@query(f"WITH {T40} SELECT device_id, pkt_no, n, window_min, window_max, window_first_pkt FROM framed")
def heap_window(spark, sf_dir):
    return trend.heap_window(v.telemetry(spark, sf_dir), P40).select("device_id", "pkt_no", "n", "window_min", "window_max", "window_first_pkt")


@query(f"WITH {T} SELECT device_id, pkt_no, window_min AS rolling_min FROM framed")
def rolling_min(spark, sf_dir):
    return trend.heap_window(v.telemetry(spark, sf_dir), P).select("device_id", "pkt_no", F.col("window_min").alias("rolling_min"))


@query(f"WITH {T40} SELECT device_id, pkt_no, coalesce(first_half_min, -1) AS first_half_min FROM fitted")
def first_half_min(spark, sf_dir):
    return trend.first_half_min(v.telemetry(spark, sf_dir), P40).select("device_id", "pkt_no", F.coalesce("first_half_min", F.lit(-1)).alias("first_half_min"))


@query(f"WITH {T} SELECT device_id, pkt_no, n, round(slope, 6) AS slope, round(r2, 6) AS r2 FROM fitted")
def heap_trend(spark, sf_dir):
    return trend.heap_trend(v.telemetry(spark, sf_dir), P).select("device_id", "pkt_no", "n", F.round("slope", 6).alias("slope"), F.round("r2", 6).alias("r2"))


@query(f"WITH {T} {_SERIES}")
def oom_series(spark, sf_dir):
    return _series(spark, sf_dir, P).select("device_id", "pkt_no", "n", F.round("projection", 4).alias("projection"), "verdict")


@query(f"WITH {T40} {_SERIES}")
def oom_series_full_frames(spark, sf_dir):
    return _series(spark, sf_dir, P40).select("device_id", "pkt_no", "n", F.round("projection", 4).alias("projection"), "verdict")


@query(
    f"""WITH {T}, last AS (SELECT * FROM series QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY pkt_no DESC) = 1)
    SELECT device_id, pkt_no, round(projection, 4) AS projection, verdict FROM last WHERE projection > 0"""
)
def oom_projection(spark, sf_dir):
    """Flagship: devices with a projected exhaustion, soonest first."""
    latest = trend.latest_projection(v.telemetry(spark, sf_dir), P)
    return latest.filter("projection > 0").select("device_id", "pkt_no", F.round("projection", 4).alias("projection"), "verdict").orderBy("projection", "device_id")


@query(f"WITH {T} SELECT device_id, pkt_no, first_half_min, window_min FROM series WHERE projection = -2.0")
def sawtooth_alert(spark, sf_dir):
    return _series(spark, sf_dir, P).filter("projection = -2.0").select("device_id", "pkt_no", "first_half_min", "window_min")


@query(f"WITH {T} SELECT device_id, pkt_no, round(projection, 4) AS projection, verdict AS kind FROM series WHERE projection > 0 OR projection = -2.0")
def leak_alerts(spark, sf_dir):
    return trend.leak_alerts(_series(spark, sf_dir, P)).select("device_id", "pkt_no", F.round("projection", 4).alias("projection"), "kind")


@query(
    f"""WITH {T}, heaps AS (SELECT 'dev-' || c_custkey AS device_id, 4194304.0 AS total FROM customer WHERE c_custkey % 2 = 0)
    SELECT s.device_id, s.pkt_no, round(CASE WHEN n < 30 OR one_time THEN -1.0 WHEN slope < 0 AND r2 >= 0.7 THEN heap_free_bytes / abs(slope)
      WHEN (first_half_min - window_min) / coalesce(h.total, 1048576.0) > 0.1 THEN -2.0 ELSE -1.0 END, 4) AS projection FROM series s LEFT JOIN heaps h USING (device_id)"""
)
def oom_params(spark, sf_dir):
    """The projection with the total heap of some devices given by a dimension."""
    devices = v.table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("dev-"), F.col("c_custkey").cast("string")).alias("device_id"), F.lit(4194304).alias("total_heap_bytes"))
    return trend.oom_series(v.telemetry(spark, sf_dir), P, devices).select("device_id", "pkt_no", F.round("projection", 4).alias("projection"))


@query(f"WITH {T} SELECT device_id, pkt_no, state, heap_free_bytes, round(projection, 4) AS projection FROM series")
def state_with_oom(spark, sf_dir):
    return _series(spark, sf_dir, P).select("device_id", "pkt_no", "state", "heap_free_bytes", F.round("projection", 4).alias("projection"))


# ---------------------------------------------------------------- metrics and panels

SHARED = v.TASKS + """, shared AS (
  SELECT *, CASE WHEN task_name = '' THEN 'unknown' ELSE task_name END AS task_label, runtime_ticks / CASE WHEN sum(runtime_ticks) OVER s = 0 THEN 1 ELSE sum(runtime_ticks) OVER s END AS cpu_share FROM tasks WINDOW s AS (PARTITION BY device_id, snapshot_id)
), named AS (
  SELECT * FROM shared QUALIFY row_number() OVER (PARTITION BY device_id, snapshot_id, task_label ORDER BY task_idx DESC) = 1
), labels(state_id, state_label) AS (VALUES (0, 'running'), (1, 'ready'), (2, 'blocked'), (3, 'suspended'), (4, 'deleted'))"""


@query(f"WITH {SHARED} SELECT device_id, snapshot_id, task_label, task_idx, round(cpu_share, 9) AS cpu_share FROM named")
def task_cpu_share(spark, sf_dir):
    return metrics.named_tasks(v.tasks(spark, sf_dir)).select("device_id", "snapshot_id", "task_label", "task_idx", F.round("cpu_share", 9).alias("cpu_share"))


@query(f"WITH {v.TASKS} SELECT device_id, snapshot_id, task_idx, CAST(stack_hwm_words AS BIGINT) * 4 AS stack_bytes FROM tasks")
def stack_bytes(spark, sf_dir):
    return v.tasks(spark, sf_dir).select("device_id", "snapshot_id", "task_idx", metrics.stack_bytes(F.col("stack_hwm_words")).alias("stack_bytes"))


@query(f"WITH {SHARED} SELECT device_id, snapshot_id, task_idx, state_label, CASE WHEN state = state_id THEN 1 ELSE 0 END AS value FROM tasks, labels")
def state_onehot(spark, sf_dir):
    return metrics.state_onehot(v.tasks(spark, sf_dir)).select("device_id", "snapshot_id", "task_idx", "state_label", "value")


def device_states(spark, sf_dir):
    """The state after each packet, as the metric table takes it."""
    counted = quality.running_counters(v.telemetry(spark, sf_dir))
    return by_packet(least={"heap_min_ever_bytes": F.col("heap_free_bytes")}).over(trend.oom_series(counted, P))


def _latest_states(spark, sf_dir):
    """The last row of ``device_states`` of each device, without the others."""
    gapped = quality.seq_gaps(v.telemetry(spark, sf_dir))
    sums = [F.min("heap_free_bytes").alias("heap_min_ever_bytes"), F.sum("gap").cast("long").alias("drop_count"), F.count("*").alias("packet_count"), F.max_by("cpu_utilization_pct", "pkt_no").alias("cpu_utilization_pct")]
    latest = trend.latest_projection(gapped, P).select("device_id", "pkt_no", "heap_free_bytes", "projection", "arrival_ts")
    return latest.join(gapped.groupBy("device_id").agg(*sums), "device_id")


def _latest_tasks(spark, sf_dir):
    tasks = v.tasks(spark, sf_dir)
    last = tasks.groupBy("device_id").agg(F.max("snapshot_id").alias("snapshot_id"))
    return tasks.join(last, ["device_id", "snapshot_id"])


def metrics_long(spark, sf_dir):
    """The metric table of the latest state of every device."""
    return metrics.to_metrics(_latest_states(spark, sf_dir), _latest_tasks(spark, sf_dir))


def _text_labels(frame):
    return frame.withColumn("labels", metrics.label_text(F.col("attrs"))).drop("attrs")


METRICS = T + """, sequenced AS (
  SELECT device_id, pkt_no, CASE WHEN coalesce((sequence_num - lag(sequence_num) OVER w - 1 + 2 * 65536) % 65536, 0) > 0 THEN 1 ELSE 0 END AS gap FROM telemetry WINDOW w AS (PARTITION BY device_id ORDER BY pkt_no)
), states AS (
  SELECT s.*, min(heap_free_bytes) OVER w AS heap_min_ever_bytes, sum(gap) OVER w AS drop_count, count(*) OVER w AS packet_count FROM series s JOIN sequenced USING (device_id, pkt_no) WINDOW w AS (PARTITION BY device_id ORDER BY pkt_no)
), latest AS (SELECT * FROM states QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY pkt_no DESC) = 1
), """ + SHARED + """, latest_tasks AS (SELECT * FROM named JOIN (SELECT device_id, max(snapshot_id) AS snapshot_id FROM tasks GROUP BY device_id) USING (device_id, snapshot_id)
), metrics_long AS (
  SELECT 'rtos_heap_free_bytes' AS metric, device_id, 'device_id="' || device_id || '"' AS labels, arrival_ts AS ts, CAST(heap_free_bytes AS DOUBLE) AS value FROM latest
  UNION ALL SELECT 'rtos_heap_min_ever_bytes', device_id, 'device_id="' || device_id || '"', arrival_ts, heap_min_ever_bytes FROM latest
  UNION ALL SELECT 'rtos_heap_oom_projection_seconds', device_id, 'device_id="' || device_id || '"', arrival_ts, projection FROM latest
  UNION ALL SELECT 'rtos_cpu_utilization_ratio', device_id, 'device_id="' || device_id || '"', arrival_ts, cpu_utilization_pct / 100.0 FROM latest
  UNION ALL SELECT 'rtos_telemetry_packet_loss_ratio', device_id, 'device_id="' || device_id || '"', arrival_ts, drop_count / packet_count FROM latest
  UNION ALL SELECT 'rtos_task_stack_watermark_bytes', device_id, 'device_id="' || device_id || '",task_name="' || task_label || '"', NULL, stack_hwm_words * 4 FROM latest_tasks
  UNION ALL SELECT 'rtos_task_cpu_ratio', device_id, 'device_id="' || device_id || '",task_name="' || task_label || '"', NULL, cpu_share FROM latest_tasks
  UNION ALL SELECT 'rtos_task_state', device_id, 'device_id="' || device_id || '",state="' || state_label || '",task_name="' || task_label || '"', NULL, CASE WHEN state = state_id THEN 1 ELSE 0 END FROM latest_tasks, labels
)"""


@query(f"WITH {METRICS} SELECT metric, device_id, labels, round(value, 4) AS value FROM metrics_long")
def to_metrics(spark, sf_dir):
    return _text_labels(metrics_long(spark, sf_dir)).select("metric", "device_id", "labels", F.round("value", 4).alias("value"))


DIM = """, dim(metric, otel_name, unit) AS (VALUES ('rtos_heap_free_bytes', 'rtos.heap.free_bytes', 'By'), ('rtos_heap_min_ever_bytes', 'rtos.heap.min_ever_bytes', 'By'),
  ('rtos_heap_oom_projection_seconds', 'rtos.heap.oom_projection_seconds', 's'), ('rtos_cpu_utilization_ratio', 'rtos.cpu.utilization_ratio', '1'), ('rtos_telemetry_packet_loss_ratio', 'rtos.telemetry.packet_loss_ratio', '1'),
  ('rtos_task_state', 'rtos.task.state', '1'), ('rtos_task_stack_watermark_bytes', 'rtos.task.stack_watermark', 'By'), ('rtos_task_cpu_ratio', 'rtos.task.cpu_ratio', '1'))"""


@query(f"WITH {METRICS}{DIM} SELECT otel_name AS name, unit, replace(replace(labels, 'device_id=', 'device.id='), 'task_name=', 'task.name=') AS labels, round(value, 4) AS value FROM metrics_long JOIN dim USING (metric)")
def otel_rename(spark, sf_dir):
    renamed = metrics.otel_rename(metrics_long(spark, sf_dir))
    return renamed.select("name", "unit", metrics.label_text(F.col("attributes")).alias("labels"), F.round("value", 4).alias("value"))


@query(
    f"""WITH {METRICS} SELECT metric, labels, CASE WHEN metric = 'rtos_cpu_utilization_ratio' THEN CASE WHEN value >= 0.9 THEN 'red' WHEN value >= 0.7 THEN 'orange' ELSE 'green' END
      WHEN metric = 'rtos_heap_oom_projection_seconds' THEN CASE WHEN value = -1 THEN 'stable' WHEN value >= 300 THEN 'green' WHEN value >= 60 THEN 'orange' ELSE 'red' END
      WHEN metric = 'rtos_task_stack_watermark_bytes' THEN CASE WHEN value >= 256 THEN 'green' WHEN value >= 128 THEN 'orange' ELSE 'red' END
      WHEN metric = 'rtos_telemetry_packet_loss_ratio' THEN CASE WHEN value >= 0.1 THEN 'red' WHEN value >= 0.05 THEN 'orange' ELSE 'green' END END AS class FROM metrics_long"""
)
def threshold_class(spark, sf_dir):
    return _text_labels(metrics.threshold_class(metrics_long(spark, sf_dir))).select("metric", "labels", "class")


@query(f"WITH {METRICS} SELECT device_id, count(DISTINCT metric || labels) AS series FROM metrics_long GROUP BY device_id")
def series_cardinality(spark, sf_dir):
    return metrics.series_cardinality(metrics_long(spark, sf_dir))


@query(f"WITH {METRICS} SELECT device_id, count(DISTINCT metric || labels) AS series, TRUE AS within FROM metrics_long GROUP BY device_id")
def series_sketches(spark, sf_dir):
    """Distinct series of each device, exactly, and whether the merged sketches of its days are within four standard errors of it."""
    rows = metrics_long(spark, sf_dir)
    estimated = metrics.estimate_series(metrics.series_sketches(rows, F.to_date("ts")), "device_id").withColumnRenamed("series", "about")
    near = F.abs(F.col("about") - F.col("series")) <= F.greatest(F.lit(1.0), 4 * F.col("series") / 64)
    return metrics.series_cardinality(rows).join(estimated, "device_id").select("device_id", "series", near.alias("within"))


@query(f"WITH {METRICS} SELECT DISTINCT device_id FROM metrics_long WHERE metric = 'rtos_task_cpu_ratio'")
def label_values(spark, sf_dir):
    return panels.label_values(metrics_long(spark, sf_dir), "rtos_task_cpu_ratio")


def packet_metrics(spark, sf_dir):
    """The device families after every packet; the loss is null while it is 0."""
    states = device_states(spark, sf_dir)
    long = metrics.device_metrics(states.withColumn("device_pkt", F.struct("device_id", "pkt_no")))
    return long.withColumn("value", F.when((F.col("metric") != "rtos_telemetry_packet_loss_ratio") | (F.col("value") > 0), F.col("value")))


PACKET_METRICS = METRICS + """, packet_metrics AS (
  SELECT 'rtos_heap_free_bytes' AS metric, device_id, arrival_ts AS ts, CAST(heap_free_bytes AS DOUBLE) AS value FROM states
  UNION ALL SELECT 'rtos_heap_min_ever_bytes', device_id, arrival_ts, heap_min_ever_bytes FROM states
  UNION ALL SELECT 'rtos_heap_oom_projection_seconds', device_id, arrival_ts, projection FROM states
  UNION ALL SELECT 'rtos_cpu_utilization_ratio', device_id, arrival_ts, cpu_utilization_pct / 100.0 FROM states
  UNION ALL SELECT 'rtos_telemetry_packet_loss_ratio', device_id, arrival_ts, nullif(drop_count / packet_count, 0) FROM states
)"""


@query(f"WITH {PACKET_METRICS} SELECT metric, device_id, round(arg_max(value, ts), 4) AS value FROM packet_metrics WHERE value IS NOT NULL GROUP BY metric, device_id")
def last_not_null(spark, sf_dir):
    return panels.last_not_null(packet_metrics(spark, sf_dir), F.col("ts")).withColumn("value", F.round("value", 4))


@query(
    f"""WITH {PACKET_METRICS} SELECT metric, device_id, epoch_us(ts) // 3600000000 * 3600 AS bucket_s, arg_max(value, ts) AS value FROM packet_metrics
    WHERE metric IN ('rtos_heap_free_bytes', 'rtos_heap_min_ever_bytes') AND ts >= (SELECT max(ts) - INTERVAL 5 DAY FROM packet_metrics) AND ts < (SELECT max(ts) FROM packet_metrics) GROUP BY ALL"""
)
def panel_timeseries(spark, sf_dir, device_id=None):
    packets = packet_metrics(spark, sf_dir)
    clock = v.table(spark, sf_dir, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("until"))
    timed, until = packets.crossJoin(F.broadcast(clock)), F.col("until")
    found = panels.panel_timeseries(timed, ["rtos_heap_free_bytes", "rtos_heap_min_ever_bytes"], until - F.expr("INTERVAL 5 DAYS"), until, 3600, F.col("ts"), device_id)
    return found.select("metric", "device_id", F.unix_seconds("bucket").alias("bucket_s"), "value")


@query(ORACLE_SQL["panel_timeseries"].replace("WHERE metric IN", "WHERE device_id = 'dev-7' AND metric IN"))
def panel_device(spark, sf_dir):
    """The panel's series of one device."""
    return panel_timeseries(spark, sf_dir, "dev-7")


def _bucketed(seconds: int) -> str:
    return f"WITH {v.TELEMETRY} SELECT device_id, epoch_us(arrival_ts) // {seconds * 1000000} * {seconds} AS bucket_s, arg_max(heap_free_bytes, pkt_no) AS heap_free_bytes FROM telemetry GROUP BY ALL"


@query(_bucketed(SCRAPE_SECONDS))
def scrape_sample(spark, sf_dir):
    return panels.sampled(v.telemetry(spark, sf_dir), SCRAPE_SECONDS, "heap_free_bytes").select("device_id", F.unix_seconds("bucket").alias("bucket_s"), "heap_free_bytes")


@query(_bucketed(PUSH_SECONDS))
def push_sample(spark, sf_dir):
    return panels.sampled(v.telemetry(spark, sf_dir), PUSH_SECONDS, "heap_free_bytes").select("device_id", F.unix_seconds("bucket").alias("bucket_s"), "heap_free_bytes")


PROGRESS = f"""WITH {GAPS}, each AS (SELECT device_id, epoch_us(arrival_ts) // {PROGRESS_SECONDS * 1000000} * {PROGRESS_SECONDS} AS bucket_s, count(*) AS c, sum(gap) AS g FROM counted GROUP BY ALL)
  SELECT device_id, bucket_s, CAST(sum(c) OVER w AS BIGINT) AS packets, CAST(sum(g) OVER w AS BIGINT) AS seq_gaps FROM each WINDOW w AS (PARTITION BY device_id ORDER BY bucket_s)"""


def _progress(spark, sf_dir):
    return panels.progress(quality.seq_gaps(v.telemetry(spark, sf_dir)), PROGRESS_SECONDS)


@query(PROGRESS)
def progress_report(spark, sf_dir):
    return _progress(spark, sf_dir).select("device_id", F.unix_seconds("bucket").alias("bucket_s"), "packets", "seq_gaps")


@query(f"WITH {v.TELEMETRY} SELECT device_id, epoch_us(arrival_ts) // {PROGRESS_SECONDS * 1000000} * {PROGRESS_SECONDS} AS bucket_s, count(*) AS packets FROM telemetry GROUP BY ALL")
def progress_window(spark, sf_dir):
    window = F.window("arrival_ts", f"{PROGRESS_SECONDS} seconds")
    return v.telemetry(spark, sf_dir).groupBy("device_id", window.alias("w")).agg(F.count("*").alias("packets")).select("device_id", F.unix_seconds("w.start").alias("bucket_s"), "packets")


@query(
    f"""WITH {v.TELEMETRY}, span AS (SELECT device_id, min(epoch_us(arrival_ts)) // 86400000000 AS d0, max(epoch_us(arrival_ts)) // 86400000000 + 1 AS d1 FROM telemetry GROUP BY device_id),
    scrapes AS (SELECT device_id, unnest(range(d0, d1 + 1)) * 86400 AS scrape_s FROM span)
    SELECT s.device_id, s.scrape_s, coalesce((SELECT arg_max(t.heap_free_bytes, t.pkt_no) FROM telemetry t WHERE t.device_id = s.device_id AND epoch_us(t.arrival_ts) <= s.scrape_s * 1000000), -1) AS heap_free_bytes FROM scrapes s"""
)
def sampled_asof(spark, sf_dir):
    """What a scrape at each midnight sees."""
    packets = v.telemetry(spark, sf_dir)
    day = F.floor(F.unix_micros("arrival_ts") / 86400000000)
    span = packets.groupBy("device_id").agg(F.min(day).alias("d0"), (F.max(day) + 1).alias("d1"))
    days = span.select("device_id", F.explode(F.sequence("d0", "d1")).alias("day"))
    scrapes = days.select("device_id", F.timestamp_seconds(F.col("day") * 86400).alias("scrape_ts"))
    return panels.sampled_asof(packets, scrapes, "heap_free_bytes").select("device_id", F.unix_seconds("scrape_ts").alias("scrape_s"), F.coalesce("heap_free_bytes", F.lit(-1)).alias("heap_free_bytes"))


@query(
    f"""WITH {PACKET_METRICS}{DIM} SELECT otel_name AS name, unit, device_id, epoch_us(ts) // {PUSH_SECONDS * 1000000} * {PUSH_SECONDS} AS push_s, round(arg_max(value, ts), 4) AS value
    FROM packet_metrics JOIN dim USING (metric) WHERE value IS NOT NULL GROUP BY ALL"""
)
def otlp_export(spark, sf_dir):
    pushed = metrics.otlp_export(packet_metrics(spark, sf_dir).filter("value is not null"), PUSH_SECONDS)
    return pushed.select("name", "unit", F.col("attrs")["device_id"].alias("device_id"), F.unix_seconds("push_start").alias("push_s"), F.round("value", 4).alias("value"))


# ---------------------------------------------------------------- reports

_STATS = "min(cycles) AS min_cycles, max(cycles) AS max_cycles, count(*) AS samples, CAST(sum(cycles) AS BIGINT) AS total_cycles, CAST(sum(cycles) // count(*) AS BIGINT) AS mean_cycles"


@query(f"WITH {v.CYCLES} SELECT label, {_STATS} FROM cycles GROUP BY label")
def profile_stats(spark, sf_dir):
    return reports.profile_stats(v.cycles(spark, sf_dir))


@query(f"WITH {v.CYCLES} SELECT label, (n - 1) // 100 AS block, {_STATS} FROM cycles GROUP BY ALL")
def profile_blocks(spark, sf_dir):
    return reports.profile_blocks(v.cycles(spark, sf_dir))


@query(f"WITH {v.CYCLES}, s AS (SELECT label, {_STATS} FROM cycles GROUP BY label) SELECT label, mean_cycles, round(mean_cycles / 84.0, 6) AS mean_us, round(mean_cycles / 84.0 / 100000.0 * 100, 6) AS overhead_pct FROM s")
def cycles_to_overhead(spark, sf_dir):
    out = reports.cycles_to_overhead(reports.profile_stats(v.cycles(spark, sf_dir)), 84.0, 100000.0)
    return out.select("label", "mean_cycles", F.round("mean_us", 6).alias("mean_us"), F.round("overhead_pct", 6).alias("overhead_pct"))


@query(
    """SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS idle, CAST(10 * l_linenumber - 10 AS BIGINT) AS period,
    CAST(CASE WHEN l_linenumber = 1 THEN 0 WHEN 100 - CAST(l_quantity AS BIGINT) * 100 // (10 * l_linenumber - 10) BETWEEN 0 AND 100 THEN 100 - CAST(l_quantity AS BIGINT) * 100 // (10 * l_linenumber - 10) ELSE 100 END AS BIGINT) AS cpu_pct FROM lineitem"""
)
def cpu_from_idle(spark, sf_dir):
    rows = v.idle(spark, sf_dir)
    return rows.withColumn("cpu_pct", reports.cpu_from_idle(F.col("idle"), F.col("period")))


@query(f"WITH {v.TELEMETRY} SELECT device_id, CASE WHEN max(arrival_ts) > min(arrival_ts) THEN round((max(pkt_no) - arg_min(pkt_no, pkt_no)) / ((epoch_us(max(arrival_ts)) - epoch_us(min(arrival_ts))) / 1e6), 9) END AS hz FROM telemetry GROUP BY device_id")
def cadence(spark, sf_dir):
    rows = v.telemetry(spark, sf_dir).select("device_id", F.col("arrival_ts").alias("ts"), F.col("pkt_no").alias("packets"))
    return reports.cadence(rows).select("device_id", F.round("hz", 9).alias("hz"))


@query(f"WITH {PACKET_METRICS} SELECT metric, device_id, count(*) AS samples, round(min(value), 4) AS min_value, round(max(value), 4) AS max_value, min(value) IS NOT DISTINCT FROM max(value) AS stable FROM packet_metrics GROUP BY metric, device_id")
def soak_summary(spark, sf_dir):
    return reports.soak_summary(packet_metrics(spark, sf_dir)).withColumns({"min_value": F.round("min_value", 4), "max_value": F.round("max_value", 4)})


@query(f"WITH {GAPS} SELECT device_id, round(sum(gap) / count(*), 9) AS value, sum(gap) / count(*) BETWEEN 0 AND 0.001 AS passed FROM counted GROUP BY device_id")
def acceptance_gate(spark, sf_dir):
    rows = quality.packet_quality(v.telemetry(spark, sf_dir)).select("device_id", F.lit("loss").alias("name"), F.col("loss_ratio").alias("value"))
    return reports.acceptance_gate(rows, [("loss", 0.0, 0.001)]).select("device_id", F.round("value", 9).alias("value"), "passed")


@query(f"WITH {v.TASKS} SELECT device_id, snapshot_id, task_idx, CASE WHEN stack_hwm_words * 2 > 90 THEN 'CRITICAL' WHEN stack_hwm_words * 2 > 80 THEN 'HIGH' WHEN stack_hwm_words * 2 > 70 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM tasks")
def stack_risk(spark, sf_dir):
    return v.tasks(spark, sf_dir).select("device_id", "snapshot_id", "task_idx", reports.stack_risk(F.col("stack_hwm_words"), F.lit(50)).alias("risk"))


@query(
    f"""WITH {v.TELEMETRY}, base AS (SELECT device_id, avg(heap_free_bytes) AS m, stddev_pop(heap_free_bytes) AS s FROM telemetry GROUP BY device_id)
    SELECT device_id, pkt_no, round(CASE WHEN s > 0 THEN abs(heap_free_bytes - m) / s ELSE 0.0 END, 6) AS z, CASE WHEN s > 0 THEN abs(heap_free_bytes - m) / s ELSE 0.0 END > 3 AS anomaly FROM telemetry JOIN base USING (device_id)"""
)
def zscore(spark, sf_dir):
    return reports.zscore(v.telemetry(spark, sf_dir), "heap_free_bytes").select("device_id", "pkt_no", F.round("z", 6).alias("z"), "anomaly")


# ---------------------------------------------------------------- text and binary


_HELP = ", ".join(f"('{name}', '{text}')" for name, _, _, _, text in METRIC_FAMILIES)


@query(
    f"""WITH {METRICS}, help(metric, description) AS (VALUES {_HELP}), lines AS (
      SELECT device_id, metric, 2 AS part, metric || '{{' || labels || '}} ' AS head, value FROM metrics_long
      UNION ALL SELECT DISTINCT device_id, metric, 0, '# HELP ' || metric || ' ' || description, NULL FROM metrics_long JOIN help USING (metric)
      UNION ALL SELECT DISTINCT device_id, metric, 1, '# TYPE ' || metric || ' gauge', NULL FROM metrics_long)
    SELECT device_id, metric, CAST(row_number() OVER (PARTITION BY device_id ORDER BY metric, part, head) AS INTEGER) AS line_no, head, round(value, 4) AS value FROM lines"""
)
def exposition_lines(spark, sf_dir):
    """The lines of metric text, with the number of a sample apart from what stands before it."""
    lines = render_exposition(spark, sf_dir)
    sample = ~F.col("line").startswith("#")
    number = F.regexp_extract("line", r"(\S+)$", 1)
    head = F.when(sample, F.expr("substring(line, 1, length(line) - length(regexp_extract(line, '(\\\\S+)$', 1)))")).otherwise(F.col("line"))
    return lines.select("device_id", "metric", "line_no", head.alias("head"), F.when(sample, F.round(number.cast("double"), 4)).alias("value"))


@query()
def render_exposition(spark, sf_dir):
    return metrics.render_exposition(metrics_long(spark, sf_dir))


@query(f"WITH {METRICS} SELECT metric, labels, round(value, 4) AS value FROM metrics_long")
def read_exposition(spark, sf_dir):
    """The metric table written as text and read again."""
    read = text.read_exposition(metrics.render_exposition(metrics_long(spark, sf_dir)))
    return _text_labels(read).select("metric", "labels", F.round("value", 4).alias("value"))


@query(
    f"""WITH {PACKET_METRICS}{DIM} SELECT otel_name AS name, unit, device_id, round(arg_max(value, ts), 4) AS value
    FROM packet_metrics JOIN dim USING (metric) WHERE value IS NOT NULL GROUP BY otel_name, unit, device_id, epoch_us(ts) // {PUSH_SECONDS * 1000000}"""
)
def read_otlp_json(spark, sf_dir):
    """The pushed payloads, read again."""
    pushed = metrics.otlp_export(packet_metrics(spark, sf_dir).filter("value is not null"), PUSH_SECONDS)
    return text.read_otlp_json(pushed).select("name", "unit", F.col("attrs")["device_id"].alias("device_id"), F.round("value", 4).alias("value"))


def log_lines(spark, sf_dir):
    """Progress of every device as log text, one file a device; clocks pass midnight."""
    rows = _progress(spark, sf_dir)
    line = F.format_string("%s [INFO] bridge: [main] %d packets received | drops=%d | seq_gaps=%d", F.date_format("bucket", "HH:mm:ss"), "packets", F.lit(0).cast("long"), "seq_gaps")
    return rows.select(F.col("device_id").alias("file"), F.unix_seconds("bucket").alias("line_no"), line.alias("line"))


@query(PROGRESS.replace("SELECT device_id, bucket_s, CAST(sum(c)", "SELECT device_id AS file, CAST(0 AS BIGINT) AS drops, bucket_s AS line_no, CAST(sum(c)"))
def read_progress_log(spark, sf_dir):
    return text.read_progress_log(log_lines(spark, sf_dir)).select("file", "line_no", "packets", "drops", "seq_gaps")


def frame_rows(spark, sf_dir, repeat=False):
    """``changes`` as frames: keyframes with four tasks, deltas with the fields that are given; every 97th event's checksum is broken.

    With ``repeat``, every 89th event's delta gives its task field twice.
    """
    rows = v.changes(spark, sf_dir).filter("state is not null")
    entry = "array<struct<task_idx:int,field:int,value:bigint>>"

    def one(task, field, value):
        return F.struct(task.cast("int").alias("task_idx"), F.lit(field).alias("field"), value.cast("long").alias("value"))

    entries = F.array_compact(F.array(F.when(F.col("heap_d").isNotNull(), one(F.lit(15), 5, F.col("heap_d"))), F.when(F.col("cpu_d").isNotNull(), one(F.lit(15), 7, F.col("cpu_d"))), one(F.col("task_idx_d"), 1, F.col("state_d")), F.when(F.lit(repeat) & (F.col("event_id") % 89 == 0), one(F.col("task_idx_d"), 1, F.col("state_d"))))).cast(entry)
    tasks = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(F.concat(F.lit("task-"), i.cast("string")).alias("name"), F.col("state").alias("state"), i.alias("priority"), (i * 100).alias("stack_hwm_words"), (i * 1000).alias("runtime_ticks")))
    ticks = F.col("event_id")
    key = frames.keyframe_payload(F.col("sequence_num"), ticks, tasks, F.col("heap_d"), F.col("heap_d"), F.col("cpu_d"))
    payload = F.when(F.col("is_valid_keyframe"), key).otherwise(frames.delta_payload(entries))
    frame = frames.framed(F.col("packet_type"), F.col("sequence_num"), ticks, payload, broken=F.col("event_id") % 97 == 0)
    return rows.select("device_id", "pkt_no", "event_id", frame.alias("frame"))


def chunks(spark, sf_dir, repeat=False):
    """The frames of each device as a capture in chunks that cut them: each chunk ends five bytes into the next frame."""
    order = Window.partitionBy("device_id").orderBy("pkt_no")
    following = F.lead("frame").over(order)
    first = F.row_number().over(order) == 1
    own = F.when(first, F.col("frame")).otherwise(F.substring(F.col("frame"), F.lit(6), F.octet_length("frame")))
    cut = F.concat(own, F.coalesce(F.substring(following, 1, 5), F.lit(b"")))
    rows = frame_rows(spark, sf_dir, repeat).select("device_id", F.lit("run").alias("capture_id"), F.col("pkt_no").alias("chunk_no"), F.lit(None).cast("timestamp").alias("arrival_ts"), cut.alias("bytes"))
    return kept(rows, "chunks")  # a capture is a table, and is read more than once


@query(f"WITH {v.CHANGES} SELECT device_id, count(*) FILTER (event_id % 97 <> 0) AS packets, count(*) FILTER (event_id % 97 = 0) AS crc_drops, CAST(0 AS BIGINT) AS version_rejects, CAST(0 AS BIGINT) AS truncated FROM changes WHERE state IS NOT NULL GROUP BY device_id")
def ingest_frames(spark, sf_dir):
    return frames.frame_quality(frames.ingest_frames(chunks(spark, sf_dir)))


@query(f"WITH {v.CHANGES} SELECT device_id, pkt_no, CASE WHEN event_id % 97 = 0 THEN 'crc' ELSE 'ok' END AS status, sequence_num, event_id % 4294967296 AS timestamp_ticks FROM changes WHERE state IS NOT NULL")
def parse_framed(spark, sf_dir):
    return frames.parse_framed(frame_rows(spark, sf_dir)).select("device_id", "pkt_no", "status", "sequence_num", "timestamp_ticks")


ACCEPTED = v.CHANGES + """, accepted AS (
  SELECT *, row_number() OVER w AS own_pkt, CAST(sum(CASE WHEN is_valid_keyframe THEN 1 ELSE 0 END) OVER w AS BIGINT) AS own_epoch FROM changes WHERE state IS NOT NULL AND event_id % 97 <> 0 WINDOW w AS (PARTITION BY device_id ORDER BY pkt_no)
), kept AS (SELECT device_id, own_epoch AS epoch, own_pkt AS pkt_no, is_valid_keyframe AS k, heap_d, cpu_d, task_idx_d, state_d, state FROM accepted WHERE own_epoch > 0)"""


@query(
    f"""WITH {ACCEPTED} SELECT device_id, epoch, pkt_no, 'system' AS scope, 15 AS task_idx, 'heap_free_bytes' AS field, heap_d % 4294967296 AS value FROM kept WHERE heap_d IS NOT NULL
    UNION ALL SELECT device_id, epoch, pkt_no, 'system', 15, 'heap_min_ever_bytes', heap_d FROM kept WHERE k
    UNION ALL SELECT device_id, epoch, pkt_no, 'system', 15, 'cpu_utilization_pct', cpu_d FROM kept WHERE cpu_d IS NOT NULL
    UNION ALL SELECT device_id, epoch, pkt_no, 'task', task_idx_d, 'state', state_d FROM kept WHERE NOT k AND task_idx_d < 4
    UNION ALL SELECT device_id, epoch, pkt_no, 'task', i, f, CASE f WHEN 'state' THEN state WHEN 'priority' THEN i WHEN 'stack_hwm_words' THEN i * 100 ELSE i * 1000 END
      FROM kept, range(4) t(i), (VALUES ('state'), ('priority'), ('stack_hwm_words'), ('runtime_ticks')) fields(f) WHERE k"""
)
def expand_payloads(spark, sf_dir):
    """Frames decoded from chunks, and what their payloads set."""
    packets = frames.packets_of(frames.ingest_frames(chunks(spark, sf_dir)))
    return frames.expand_payloads(packets).drop("place")


@query(
    f"""WITH {ACCEPTED.replace("is_valid_keyframe AS k, heap_d", "is_valid_keyframe AS k, event_id, heap_d")}
    SELECT device_id, pkt_no, task_idx_d AS task_idx, 'state' AS field, state_d AS value, 'repeated' AS problem FROM kept, range(2) WHERE NOT k AND event_id % 89 = 0 AND task_idx_d < 4"""
)
def strict_delta(spark, sf_dir):
    packets = frames.packets_of(frames.ingest_frames(chunks(spark, sf_dir, repeat=True)))
    return frames.strict_delta(frames.expand_payloads(packets)).select("device_id", "pkt_no", "task_idx", "field", "value", "problem")


# ---------------------------------------------------------------- state from payloads


def decoded_changes(spark, sf_dir):
    """Packets decoded from chunks, and what their payloads set."""
    packets = frames.packets_of(frames.ingest_frames(chunks(spark, sf_dir)))
    return packets, frames.expand_payloads(packets)


SET = ACCEPTED + """, system_rows AS (
  SELECT device_id, epoch, pkt_no, last_value(heap_d % 4294967296 IGNORE NULLS) OVER w AS heap_free_bytes, last_value(CASE WHEN k THEN heap_d END IGNORE NULLS) OVER w AS heap_min_ever_bytes,
    last_value(cpu_d IGNORE NULLS) OVER w AS cpu_utilization_pct, heap_d IS NOT NULL OR cpu_d IS NOT NULL AS given FROM kept WINDOW w AS (PARTITION BY device_id, epoch ORDER BY pkt_no ROWS UNBOUNDED PRECEDING)
), task_rows AS (
  SELECT device_id, epoch, task_idx_d AS task_idx, pkt_no, state_d AS state FROM kept WHERE NOT k AND task_idx_d < 4
  UNION ALL SELECT device_id, epoch, i, pkt_no, state FROM kept, range(4) t(i) WHERE k
)"""


@query(f"WITH {SET} SELECT device_id, epoch, pkt_no, heap_free_bytes, heap_min_ever_bytes, cpu_utilization_pct FROM system_rows WHERE given")
def rebuild_full_state(spark, sf_dir):
    """The system fields after each packet that sets one, from the packets' bytes."""
    return state.full_state(decoded_changes(spark, sf_dir)[1])


@query(f"WITH {SET} SELECT device_id, epoch, task_idx, pkt_no, state, task_idx AS priority, task_idx * 100 AS stack_hwm_words, task_idx * 1000 AS runtime_ticks FROM task_rows")
def rebuild_tasks(spark, sf_dir):
    """Every task's fields after each packet that sets one, from the packets' bytes."""
    return state.task_state(decoded_changes(spark, sf_dir)[1])


_CURRENT = f"""WITH {SET}, newest AS (SELECT device_id, max(epoch) AS epoch FROM task_rows GROUP BY device_id)
  SELECT device_id, epoch, task_idx, max(pkt_no) AS pkt_no, arg_max(state, pkt_no) AS state FROM task_rows JOIN newest USING (device_id, epoch) GROUP BY ALL"""


@query(f"SELECT device_id, task_idx, 'task-' || task_idx AS task_name, pkt_no, state, epoch AS snapshot_id FROM ({_CURRENT})")
def current_tasks(spark, sf_dir):
    packets, changes = decoded_changes(spark, sf_dir)
    found = state.current_tasks(state.task_state(changes), frames.task_names(packets))
    return found.select("device_id", "task_idx", "task_name", "pkt_no", "state", "snapshot_id")


@query(f"""WITH {SET} SELECT device_id, task_idx, 'task-' || task_idx AS task_name, arg_max(pkt_no, epoch * 1000000000 + pkt_no) AS pkt_no, arg_max(state, epoch * 1000000000 + pkt_no) AS state FROM task_rows GROUP BY device_id, task_idx""")
def stale_tasks(spark, sf_dir):
    """The last state of every task that was ever seen."""
    packets, changes = decoded_changes(spark, sf_dir)
    found = state.current_tasks(state.task_state(changes), frames.task_names(packets), include_stale=True)
    return found.select("device_id", "task_idx", "task_name", "pkt_no", "state")


@query(
    f"""WITH cur AS ({_CURRENT}), named AS (SELECT *, 'device_id="' || device_id || '"' AS d, ',task_name="task-' || task_idx || '"' AS t FROM cur), labels(state_id, state_label) AS (VALUES (0, 'running'), (1, 'ready'), (2, 'blocked'), (3, 'suspended'), (4, 'deleted'))
    SELECT 'rtos_task_stack_watermark_bytes' AS metric, device_id, d || t AS labels, task_idx * 400.0 AS value FROM named
    UNION ALL SELECT 'rtos_task_cpu_ratio', device_id, d || t, round(task_idx / 6.0, 6) FROM named
    UNION ALL SELECT 'rtos_task_state', device_id, d || ',state="' || state_label || '"' || t, CASE WHEN state = state_id THEN 1.0 ELSE 0.0 END FROM named, labels"""
)
def payload_task_metrics(spark, sf_dir):
    """The task families of the metric table, from bytes to labels."""
    packets, changes = decoded_changes(spark, sf_dir)
    found = metrics.task_metrics(state.current_tasks(state.task_state(changes), frames.task_names(packets)))
    return _text_labels(found).select("metric", "device_id", "labels", F.round("value", 6).alias("value"))


@query(
    f"""WITH {ACCEPTED}, gapped AS (SELECT device_id, CASE WHEN (sequence_num - lag(sequence_num) OVER (PARTITION BY device_id ORDER BY own_pkt) - 1 + 2 * 65536) % 65536 > 0 THEN 1 ELSE 0 END AS gap FROM accepted)
    SELECT device_id, packets, seq_gaps, crc_drops FROM (SELECT device_id, count(*) AS packets, CAST(sum(gap) AS BIGINT) AS seq_gaps FROM gapped GROUP BY device_id)
      JOIN (SELECT device_id, count(*) FILTER (event_id % 97 = 0) AS crc_drops FROM changes WHERE state IS NOT NULL GROUP BY device_id) USING (device_id)"""
)
def frame_packet_quality(spark, sf_dir):
    """Packets, gaps and failed checksums of each device, from its bytes."""
    decoded = frames.ingest_frames(chunks(spark, sf_dir))
    return quality.packet_quality(frames.packets_of(decoded), decoded).select("device_id", "packets", "seq_gaps", "crc_drops")


@query(
    f"""WITH {v.CHANGES} SELECT device_id, pkt_no, CASE WHEN epoch = 0 THEN 0 ELSE last_value(heap_d IGNORE NULLS) OVER (PARTITION BY device_id, epoch ORDER BY pkt_no ROWS UNBOUNDED PRECEDING) END AS heap_free_bytes FROM epochs"""
)
def heap_samples_prebaseline(spark, sf_dir):
    """The samples of the leak analytics with those before the first keyframe."""
    timed = v.changes(spark, sf_dir).withColumn("arrival_ts", F.lit(None).cast("timestamp"))
    return state.heap_samples(timed, include_prebaseline=True).select("device_id", "pkt_no", "heap_free_bytes")


# ---------------------------------------------------------------- tasks over time


def task_packets(spark, sf_dir):
    """The tasks view with the snapshots of a device as its packets."""
    return v.tasks(spark, sf_dir).withColumn("pkt_no", F.col("snapshot_id"))


_FIELDS = ["state", "priority", "stack_hwm_words", "runtime_ticks"]


@query(
    f"""WITH {v.TASKS}, wide AS (SELECT *, lag(snapshot_id) OVER w IS NULL AS first, {", ".join(f"lag({f}) OVER w AS {f}_0" for f in _FIELDS)} FROM tasks WHERE task_idx < 15 WINDOW w AS (PARTITION BY device_id, task_idx ORDER BY snapshot_id))
    """ + " UNION ALL ".join(f"SELECT device_id, snapshot_id AS pkt_no, task_idx * 4 + {i} AS place, task_idx, '{f}' AS field, CAST({f} AS BIGINT) AS value FROM wide WHERE first OR {f} IS DISTINCT FROM {f}_0" for i, f in enumerate(_FIELDS))
)
def task_change_capture(spark, sf_dir):
    return state.task_change_capture(task_packets(spark, sf_dir))


@query(
    f"""WITH {v.TASKS}, marked AS (SELECT *, CASE WHEN lag(snapshot_id) OVER w IS NULL OR state IS DISTINCT FROM lag(state) OVER w THEN 1 ELSE 0 END AS starts FROM tasks WINDOW w AS (PARTITION BY device_id, task_idx ORDER BY snapshot_id)),
    runs AS (SELECT *, sum(starts) OVER (PARTITION BY device_id, task_idx ORDER BY snapshot_id) AS run FROM marked)
    SELECT device_id, task_idx, min(snapshot_id) AS first_pkt, max(snapshot_id) AS last_pkt, count(*) AS packets FROM runs WHERE state = 0 GROUP BY device_id, task_idx, run"""
)
def task_timeline(spark, sf_dir):
    return state.task_timeline(task_packets(spark, sf_dir))


@query(
    f"""WITH {v.TASKS}, stepped AS (SELECT *, (runtime_ticks - lag(runtime_ticks) OVER (PARTITION BY device_id, task_idx ORDER BY snapshot_id) + 4294967296) % 4294967296 AS step FROM tasks)
    SELECT device_id, snapshot_id, task_idx, round(step / nullif(sum(step) OVER (PARTITION BY device_id, snapshot_id), 0), 9) AS cpu_share FROM stepped"""
)
def interval_cpu_share(spark, sf_dir):
    return metrics.interval_cpu_share(v.tasks(spark, sf_dir)).select("device_id", "snapshot_id", "task_idx", F.round("cpu_share", 9).alias("cpu_share"))


HEAT_SECONDS = 10_000


@query(f"WITH {SHARED} SELECT device_id, task_label, snapshot_id // {HEAT_SECONDS} * {HEAT_SECONDS} AS bucket_s, round(avg(cpu_share), 9) AS cpu_share FROM named GROUP BY ALL")
def cpu_heatmap(spark, sf_dir):
    shares = metrics.named_tasks(v.tasks(spark, sf_dir)).withColumn("ts", F.timestamp_seconds("snapshot_id"))
    return metrics.cpu_heatmap(shares, HEAT_SECONDS).select("device_id", "task_label", F.unix_seconds("bucket").alias("bucket_s"), F.round("cpu_share", 9).alias("cpu_share"))


@query(
    f"""WITH {v.TASKS}, base AS (SELECT device_id, task_name, avg(snapshot_id) AS mid, stddev_pop(snapshot_id) AS unit FROM tasks GROUP BY ALL),
    scaled AS (SELECT device_id, task_name, snapshot_id, (snapshot_id - mid) / unit AS u, CAST(stack_hwm_words AS DOUBLE) AS y, (snapshot_id - mid + 3600) / unit AS ahead FROM tasks JOIN base USING (device_id, task_name) WHERE unit > 0),
    sums AS (SELECT device_id, task_name, count(*) AS samples, count(DISTINCT snapshot_id) AS times, max(ahead) AS a, CAST(count(*) AS DOUBLE) AS n, sum(u) AS s1, sum(u*u) AS s2, sum(u*u*u) AS s3, sum(u*u*u*u) AS s4, sum(y) AS t0, sum(y*u) AS t1, sum(y*u*u) AS t2 FROM scaled GROUP BY ALL),
    solved AS (SELECT *, n*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2) AS d, t0*(s2*s4-s3*s3) - s1*(t1*s4-s3*t2) + s2*(t1*s3-s2*t2) AS d0, n*(t1*s4-s3*t2) - t0*(s1*s4-s3*s2) + s2*(s1*t2-t1*s2) AS d1, n*(s2*t2-t1*s3) - s1*(s1*t2-t1*s2) + t0*(s1*s3-s2*s2) AS d2 FROM sums)
    SELECT device_id, task_name, samples, round(CASE WHEN samples >= 10 AND times >= 3 THEN (d0 + d1*a + d2*a*a) / nullif(d, 0) END, 3) AS predicted, CASE WHEN samples >= 10 AND times >= 3 THEN (d0 + d1*a + d2*a*a) / nullif(d, 0) END > 50 AS overflow FROM solved"""
)
def stack_growth(spark, sf_dir):
    rows = v.tasks(spark, sf_dir).select("device_id", "task_name", F.col("snapshot_id").cast("double").alias("x"), F.col("stack_hwm_words").alias("used"), F.lit(50).alias("total"))
    return reports.stack_growth(rows).withColumn("predicted", F.round("predicted", 3))


@query(f"WITH {T} SELECT device_id, pkt_no, n >= 60 AND slope < -0.01 AND r2 > 0.8 AS leak, round(CASE WHEN n >= 60 AND slope < -0.01 AND r2 > 0.8 THEN heap_free_bytes / abs(slope) / 3600 END, 4) AS hours FROM fitted")
def leak_strict(spark, sf_dir):
    found = trend.leak_strict(v.telemetry(spark, sf_dir), P, max_slope=-0.01)
    return found.select("device_id", "pkt_no", "leak", F.round("hours", 4).alias("hours"))


@query(
    f"""WITH {v.TELEMETRY}, apart AS (SELECT device_id, pkt_no, epoch_us(arrival_ts) - event_id * 1000000 // 1000 AS a FROM telemetry)
    SELECT device_id, pkt_no, a - min(a) OVER (PARTITION BY device_id) AS latency_us FROM apart"""
)
def latency(spark, sf_dir):
    """Arrival over the device's own clock of a thousand ticks a second."""
    packets = v.telemetry(spark, sf_dir).withColumn("timestamp_ticks", F.col("event_id"))
    return reports.latency(packets, 1000).select("device_id", "pkt_no", "latency_us")


# ---------------------------------------------------------------- evidence texts


@query(f"WITH {v.CYCLES}, b AS (SELECT label, (n - 1) // 100 AS block, {_STATS} FROM cycles GROUP BY ALL) SELECT label || '-' || block AS file, label, min_cycles, max_cycles, mean_cycles, samples, 'MEASURE' AS kind FROM b")
def read_profile_lines(spark, sf_dir):
    """Block statistics printed into captures among other output, and read from them."""
    blocks = reports.profile_blocks(v.cycles(spark, sf_dir))
    line = F.format_string("\x02noise[MEASURE] %s min=%d max=%d mean=%d cycles samples=%d\r\nrest", "label", "min_cycles", "max_cycles", "mean_cycles", "samples")
    texts = blocks.select(F.concat("label", F.lit("-"), F.col("block").cast("string")).alias("file"), line.alias("text"))
    return text.read_profile_lines(texts).select("file", "label", "min_cycles", "max_cycles", "mean_cycles", "samples", "kind")


_PUSHED = ORACLE_SQL["otlp_export"]


@query(_PUSHED.replace("SELECT otel_name AS name, unit, device_id, epoch_us(ts) //", "SELECT otel_name AS name, unit, device_id, max(epoch_us(ts)) AS ts_us, epoch_us(ts) //").replace("SELECT otel_name", "SELECT otel_name"))
def read_otlp_dump(spark, sf_dir):
    """Pushed values as a collector prints them, a text a push, and read from that."""
    pushed = metrics.otlp_export(packet_metrics(spark, sf_dir).filter("value is not null"), PUSH_SECONDS)
    dump = F.concat(
        F.lit("Metric #0\nDescriptor:\n     -> Name: "), "name", F.lit("\n     -> Unit: "), "unit", F.lit("\n     -> DataType: Gauge\nNumberDataPoints #0\nData point attributes:\n     -> device.id: Str("),
        F.col("attrs")["device_id"], F.lit(")\nTimestamp: "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" +0000 UTC\nValue: "), F.col("value").cast("string"), F.lit("\n"),
    )
    read = text.read_otlp_dump(pushed.select(dump.alias("text")))
    stamp = F.unix_micros("ts")
    return read.select("name", "unit", F.col("attrs")["device.id"].alias("device_id"), stamp.alias("ts_us"), F.expr(f"unix_micros(ts) div {PUSH_SECONDS * 1000000} * {PUSH_SECONDS}").alias("push_s"), F.round("value", 4).alias("value"))


@query(f"WITH {v.TELEMETRY} SELECT device_id, epoch_us(date_trunc('second', arrival_ts)) // 1000000 AS ts_s, CAST(heap_free_bytes AS DOUBLE) AS value FROM telemetry")
def read_soak_summary(spark, sf_dir):
    """Samples as sections of a soak summary, and read from it."""
    section = F.concat(F.lit("["), F.date_format("arrival_ts", "yyyy-MM-dd_HH-mm-ss"), F.lit(']\nrtos_heap_free_bytes{device_id="'), "device_id", F.lit('"} '), F.col("heap_free_bytes").cast("string"), F.lit("\n"))
    read = text.read_soak_summary(v.telemetry(spark, sf_dir).select(section.alias("text")))
    return read.select(F.col("attrs")["device_id"].alias("device_id"), F.unix_seconds("ts").alias("ts_s"), "value")


@query("SELECT 'c' || c_custkey AS file, k AS key, CASE k WHEN 'Board' THEN c_name ELSE c_mktsegment || ': ' || c_nationkey END AS value FROM customer, (VALUES ('Board'), ('Notes')) t(k)")
def read_soak_metadata(spark, sf_dir):
    body = F.concat(F.lit("Run notes\nBoard: "), "c_name", F.lit("\nNotes: "), "c_mktsegment", F.lit(": "), F.col("c_nationkey").cast("string"))
    texts = v.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("file"), body.alias("text"))
    return text.read_soak_metadata(texts)


def _sunk(objects: DataFrame, batch: str) -> DataFrame:
    """The objects' lines, written through the sink (twice, of which one counts) and read back."""
    path = f"{shared_folder(objects.sparkSession)}/objects-{uuid.uuid4().hex}"
    objects = kept(objects, "objects")  # what both writes read is made once
    for _ in range(2):
        sinks.write_objects(objects, path, batch)
    return sinks.read_objects(objects.sparkSession, path)


#: Packets of the views are hours apart, so the objects below are of a month each.
MONTH = 30 * 86400


@query(
    f"""WITH {PACKET_METRICS} SELECT metric, device_id, epoch_us(ts) // {MONTH * 1000000} * {MONTH} AS scrape_s, round(arg_max(value, ts), 4) AS value
    FROM packet_metrics WHERE value IS NOT NULL GROUP BY ALL"""
)
def scrape_objects(spark, sf_dir):
    """The metric text of every device and month as objects, read again."""
    lines = _sunk(metrics.scrape_objects(packet_metrics(spark, sf_dir).filter("value is not null"), MONTH), "scrapes")
    read = text.read_exposition(lines.withColumnRenamed("object", "file"))
    return read.select("metric", F.col("attrs")["device_id"].alias("device_id"), F.unix_seconds("ts").alias("scrape_s"), F.round("value", 4).alias("value"))


@query(
    f"""WITH {PACKET_METRICS}{DIM} SELECT otel_name AS name, unit, device_id, round(arg_max(value, ts), 4) AS value
    FROM packet_metrics JOIN dim USING (metric) WHERE value IS NOT NULL GROUP BY otel_name, unit, device_id, epoch_us(ts) // {MONTH * 1000000}"""
)
def push_objects(spark, sf_dir):
    """What every device pushes in a month as objects, read again."""
    lines = _sunk(metrics.push_objects(packet_metrics(spark, sf_dir).filter("value is not null"), MONTH), "pushes")
    return text.read_otlp_json(lines, "line").select("name", "unit", F.col("attrs")["device_id"].alias("device_id"), F.round("value", 4).alias("value"))
