"""Readers of metric text, logs and collector dumps: lines in, typed rows out.

Each takes a DataFrame with ``line`` (and ``file``, ``path`` where it matters which file it is) or, for short whole files, ``text``; ``lines_of`` and ``texts_of`` read
them from paths. What stands in sections (dumps, soak summaries) is also read from lines, with the section's head carried along the file, so that no file is ever one row.

No line ends a job: of a name that a line gives twice the last value counts, and what can't be read is left out. The ``..._rejects`` functions give those lines with the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconlake.functions.scan import Scan, ranges

SAMPLE = r"^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{(.*)\})? (\S+)$"
LABEL = r'([A-Za-z_][A-Za-z0-9_]*)="((?:[^"\\]|\\.)*)"'


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """``path, file, line_no, line``: a file's path and name, and a number that orders its lines.

    It is the split's first byte and the row's place in its task, which is below the split size, so it holds for a large file of many splits too.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), (F.col("_metadata.file_block_start") + place).alias("line_no"), F.col("value").alias("line"))


def texts_of(spark: SparkSession, path: str) -> DataFrame:
    """``path, file, text``, a row a file: for files that fit in one."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


#: Lines of so many bytes of a file are scanned at once.
SPAN = 1 << 22


def _file_of(rows: DataFrame) -> str:
    """The column that tells files apart: two folders may hold files of one name."""
    return "path" if "path" in rows.columns else "file"


def _last_wins(names: Column, values: Column) -> Column:
    """A map of names to values; null names are left out, and of a repeated name the last one counts."""
    plain = F.size(F.array_except(names, F.array(F.lit(None).cast("string")))) == F.size(names)  # no name is null or repeated
    pairs = F.transform(names, lambda name, i: F.struct(name.alias("k"), F.get(values, i).alias("v"), i.alias("i")))
    kept = F.filter(pairs, lambda p: p["k"].isNotNull() & ~F.coalesce(F.array_contains(F.slice(names, p["i"] + 2, F.greatest(F.size(names), F.lit(1))), p["k"]), F.lit(False)))
    return F.when(plain, F.map_from_arrays(names, values)).otherwise(F.map_from_entries(F.transform(kept, lambda p: F.struct(p["k"], p["v"]))))


def _number(text):
    return F.when(F.lower(text) == "nan", F.lit(float("nan"))).when(text == "+Inf", F.lit(float("inf"))).when(text == "-Inf", F.lit(float("-inf"))).otherwise(text.try_cast("double"))


def _unquoted(value):
    """Undo backslash escapes; an escaped backslash waits as a NUL, which no label holds."""
    for mark, char in (("\\\\", "\x00"), ('\\"', '"'), ("\\n", "\n"), ("\x00", "\\")):
        value = F.replace(value, F.lit(mark), F.lit(char))
    return value


def read_exposition(lines: DataFrame) -> DataFrame:
    """``metric, attrs, value`` of every sample line of metric text; comments and other lines are left out.

    A ``file`` named ``yyyy-MM-dd_HH-mm-ss`` gives ``ts``. Label values may hold commas and escaped quotes.
    """
    samples = lines.filter(~F.col("line").startswith("#") & F.col("line").rlike(SAMPLE))
    inner = F.regexp_extract("line", SAMPLE, 2)
    names, values = F.regexp_extract_all(inner, F.lit(LABEL), F.lit(1)), F.regexp_extract_all(inner, F.lit(LABEL), F.lit(2))
    plain = F.transform(values, _unquoted)
    ts = F.try_to_timestamp(F.regexp_extract("file", r"(\d{4}-\d\d-\d\d_\d\d-\d\d-\d\d)[^/]*$", 1), F.lit("yyyy-MM-dd_HH-mm-ss")) if "file" in lines.columns else F.lit(None).cast("timestamp")
    return samples.select(F.regexp_extract("line", SAMPLE, 1).alias("metric"), _last_wins(names, plain).alias("attrs"), ts.alias("ts"), _number(F.regexp_extract("line", SAMPLE, 3)).alias("value"))


def exposition_rejects(lines: DataFrame) -> DataFrame:
    """The lines, with ``reason``, that are neither comments nor empty nor a sample with labels and a number."""
    inner, number = F.regexp_extract("line", SAMPLE, 2), F.regexp_extract("line", SAMPLE, 3)
    rest = F.regexp_replace(inner, LABEL, "")
    reason = F.when(~F.col("line").rlike(SAMPLE), "no sample").when(rest.rlike(r"[^,\s]"), "labels").when(_number(number).isNull(), "no number")
    return lines.filter(~F.col("line").startswith("#") & F.col("line").rlike(r"\S")).withColumn("reason", reason).filter("reason is not null")


PROGRESS = r"^(\d\d:\d\d:\d\d) \[\w+\] .*?(\d+) packets received \| drops=(\d+) \| seq_gaps=(\d+)"


def _progress(lines: DataFrame) -> DataFrame:
    counts = [F.regexp_extract("line", PROGRESS, i).try_cast("long").alias(name) for i, name in ((2, "packets"), (3, "drops"), (4, "seq_gaps"))]
    clock = F.expr(f"aggregate(split(regexp_extract(line, r'{PROGRESS}', 1), ':'), 0L, (a, x) -> a * 60 + try_cast(x as bigint))").alias("clock")
    return lines.filter(F.col("line").rlike(PROGRESS)).select("*", *counts, clock)


def read_progress_log(lines: DataFrame) -> DataFrame:
    """``file, line_no, seconds, packets, drops, seq_gaps`` of each progress line; ``seconds`` counts from midnight of the first day and grows by a day where the clock goes back.

    ``lines`` has ``file``, ``line_no`` and ``line``, and ``path`` where names of files may repeat; a file is one run's log. Lines with a number over 64 bits are left out.
    """
    name = _file_of(lines)
    found = _progress(lines.select(*dict.fromkeys([name, "file", "line_no", "line"]))).filter("packets is not null and drops is not null and seq_gaps is not null").drop("line")
    before = Scan([name], ["line_no"], ranges("line_no", SPAN), before={"_clock_before": F.col("clock")}).over(found)
    back = F.coalesce((F.col("clock") < F.col("_clock_before")).cast("long"), F.lit(0))
    days = Scan([name], ["line_no"], ranges("line_no", SPAN), sums={"_days": F.col("_back")}).over(before.withColumn("_back", back))
    return days.withColumn("seconds", F.col("clock") + 86400 * F.col("_days")).select("file", "line_no", "seconds", "packets", "drops", "seq_gaps")


def progress_rejects(lines: DataFrame) -> DataFrame:
    """The progress lines, with ``reason``, whose numbers can't be read."""
    bad = _progress(lines).filter("packets is null or drops is null or seq_gaps is null")
    return bad.select(*[F.col(f"`{c}`") for c in lines.columns], F.lit("number over 64 bits").alias("reason"))


PROFILE = r"\[(PROFILER|MEASURE)\] (\S+) min=(\d+) max=(\d+) mean=(\d+) cycles samples=(\d+)"


def _profile(texts: DataFrame) -> DataFrame:
    body = "line" if "line" in texts.columns else "text"
    each = texts.select("*", F.posexplode(F.regexp_extract_all(body, F.lit(f"({PROFILE})"), F.lit(1))).alias("place", "found"))
    numbers = [F.regexp_extract("found", PROFILE, i).try_cast("long").alias(name) for i, name in ((3, "min_cycles"), (4, "max_cycles"), (5, "mean_cycles"), (6, "samples"))]
    return each.select("*", F.regexp_extract("found", PROFILE, 1).alias("kind"), F.regexp_extract("found", PROFILE, 2).alias("label"), *numbers)


_WHOLE = "min_cycles is not null and max_cycles is not null and mean_cycles is not null and samples is not null"


def read_profile_lines(texts: DataFrame) -> DataFrame:
    """``file, place, kind, label, min_cycles, max_cycles, mean_cycles, samples`` of each profile line, wherever it stands in the text.

    ``place`` numbers them in a text or, where ``texts`` has ``line`` (and ``line_no``, which then comes along), in a line. Those with a number over 64 bits are left out.
    """
    own = ["file", "line_no"] if "line" in texts.columns else ["file"]
    return _profile(texts).filter(_WHOLE).select(*own, "place", "kind", "label", "min_cycles", "max_cycles", "mean_cycles", "samples")


def profile_rejects(texts: DataFrame) -> DataFrame:
    """``file, place, found, reason`` of the profile lines whose numbers can't be read."""
    return _profile(texts).filter(f"not ({_WHOLE})").select("file", "place", "found", F.lit("number over 64 bits").alias("reason"))


def _line(head: str, rest: str) -> str:
    """A pattern for a line that begins with ``head``; texts are searched for that first, and only where it stands for the line's beginning."""
    return f"{head}(?<=^{head}){rest}"


_METRIC, _POINT = _line("Metric #", r"\d+\s*$"), _line("NumberDataPoints #", r"\d+\s*$")
_STAMP, _VALUE = _line("Timestamp: ", r"(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(?:\.\d{1,6})?)"), _line("Value: ", r"(\S+)")
_ATTRIBUTE = r"-> ([\w.]+): \w+\((.*)\)"


def _dump_points(texts: DataFrame) -> DataFrame:
    """``name, unit, point, attrs, ts, value`` of every data point of whole dumps; ``point`` is its text."""

    def behind(column: str, head: str):
        """The parts behind each head line."""
        return F.explode(F.slice(F.split(column, head), 2, 1 << 30))

    blocks = texts.select(behind("text", f"(?m){_METRIC}").alias("block"))
    head = blocks.select(
        F.regexp_extract("block", r"-> Name: (\S+)", 1).alias("name"), F.regexp_extract("block", r"-> Unit: (\S+)", 1).alias("unit"), behind("block", f"(?m){_POINT}").alias("point")
    )
    names, values = (F.regexp_extract_all("point", F.lit(_ATTRIBUTE), F.lit(i)) for i in (1, 2))
    value = F.regexp_extract("point", f"(?m){_VALUE}", 1).try_cast("double")
    return head.select("name", "unit", "point", _last_wins(names, values).alias("attrs"), F.try_to_timestamp(F.regexp_extract("point", f"(?m){_STAMP}", 1)).alias("ts"), value.alias("value"))


def read_otlp_dump(texts: DataFrame) -> DataFrame:
    """``name, unit, attrs, ts, value`` of every data point in a collector's debug text; points without a number are left out.

    ``texts`` has a dump a row in ``text``. Where it has ``line``, ``line_no`` and ``file`` (or ``path``), as of ``lines_of``, the head of a metric and of a point is carried
    along each file, over as many splits as it has, and only the lines of one point come together.
    """
    if "line" not in texts.columns:
        return _dump_points(texts).filter("value is not null").drop("point")
    return _points_of_lines(texts).filter("value is not null").select("name", "unit", "attrs", "ts", "value")


def _points_of_lines(lines: DataFrame) -> DataFrame:
    name, line = _file_of(lines), F.col("line")
    metric, point = line.rlike(_METRIC), line.rlike(_POINT)
    given = lambda pattern: F.nullif(F.regexp_extract("line", pattern, 1), F.lit(""))
    # the head of a metric stands before its first point, and nothing of it is carried into the next metric
    first = {"name": F.when(~line.rlike(_ATTRIBUTE), given(r"-> Name: (\S+)")), "unit": F.when(~line.rlike(_ATTRIBUTE), given(r"-> Unit: (\S+)")), "point": F.when(point, F.col("line_no"))}
    order = Scan([name], ["line_no"], ranges("line_no", SPAN), last=first, sums={"metric": metric.cast("long")}, reset=metric)
    inside = order.over(lines.select(name, "line_no", "line")).filter("metric > 0 and point is not null")
    entry = F.when(line.rlike(_ATTRIBUTE), F.struct("line_no", F.regexp_extract("line", _ATTRIBUTE, 1).alias("k"), F.regexp_extract("line", _ATTRIBUTE, 2).alias("v")))
    stamp, value = F.when(line.rlike(f"(?m){_STAMP}"), F.regexp_extract("line", f"(?m){_STAMP}", 1)), F.when(line.rlike(r"^Value: \S"), F.regexp_extract("line", r"^Value: (\S+)", 1))
    points = inside.groupBy(name, "point").agg(
        F.min_by("name", "line_no").alias("name"), F.min_by("unit", "line_no").alias("unit"), F.array_sort(F.collect_list(entry)).alias("entries"),
        F.min_by(stamp, F.when(stamp.isNotNull(), F.col("line_no"))).alias("stamp"), F.min_by(value, F.when(value.isNotNull(), F.col("line_no"))).alias("number"),
    )
    attrs = _last_wins(F.transform("entries", lambda e: e["k"]), F.transform("entries", lambda e: e["v"]))
    return points.select(name, "point", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("unit", F.lit("")).alias("unit"), attrs.alias("attrs"), F.try_to_timestamp("stamp").alias("ts"), F.col("number").try_cast("double").alias("value"))


def otlp_dump_rejects(texts: DataFrame) -> DataFrame:
    """The data points without a number, with ``reason``: their text or, from lines, their file and the number of their first line."""
    points = _dump_points(texts).select("name", "point", "value") if "line" not in texts.columns else _points_of_lines(texts).select(_file_of(texts), "name", "point", "value")
    return points.filter("value is null").drop("value").withColumn("reason", F.lit("no number"))


OTLP = (
    "struct<name:string,unit:string,data:struct<dataPoints:array<struct<attributes:array<struct<key:string,value:struct<stringValue:string>>>,asInt:bigint,asDouble:double>>>>"
)


def read_otlp_json(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """``name, unit, attrs, value`` of every data point of metric JSON; payloads that aren't JSON give none, and ``value`` is null where a point has no number."""
    read = payloads.select(F.from_json(payload, OTLP).alias("m"))
    points = read.select("m.name", "m.unit", F.explode("m.data.dataPoints").alias("p"))
    attrs = _last_wins(F.transform("p.attributes", lambda a: a["key"]), F.transform("p.attributes", lambda a: a["value"]["stringValue"]))
    return points.select("name", "unit", attrs.alias("attrs"), F.coalesce("p.asDouble", F.col("p.asInt").cast("double")).alias("value"))


def otlp_json_rejects(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """The payloads, with ``reason``, that aren't metric JSON, and those with a point that has no number."""
    m = F.from_json(payload, OTLP)
    bare = F.exists(F.coalesce(m["data"]["dataPoints"], F.array()), lambda p: p["asDouble"].isNull() & p["asInt"].isNull())
    return payloads.withColumn("reason", F.when(m["name"].isNull() | m["data"]["dataPoints"].isNull(), "no metric JSON").when(bare, "no number")).filter("reason is not null")


_SECTION = r"\[(\d{4}-\d\d-\d\d_\d\d-\d\d-\d\d)\]"


def read_soak_summary(texts: DataFrame) -> DataFrame:
    """``metric, attrs, ts, value`` of a soak summary: sections of a time in brackets followed by sample lines.

    ``texts`` has ``text`` or, as of ``lines_of``, ``line``, ``line_no`` and ``file`` (or ``path``); from lines, the section's time is carried along the file.
    """
    if "line" in texts.columns:
        name = _file_of(texts)
        head = F.nullif(F.regexp_extract("line", _SECTION, 1), F.lit(""))
        timed = Scan([name], ["line_no"], ranges("line_no", SPAN), last={"_section": head}).over(texts.select(name, "line_no", "line")).filter("_section is not null")
        return read_exposition(timed.select(F.col("_section").alias("file"), F.regexp_replace("line", f"^.*{_SECTION}", "").alias("line")))
    sections = texts.select(F.explode(F.regexp_extract_all("text", F.lit(_SECTION + r"([^\[]*)"), F.lit(0))).alias("section"))
    named = sections.select(F.regexp_extract("section", r"\[(.*?)\]", 1).alias("file"), F.explode(F.split(F.regexp_replace("section", r"^\[.*?\]", ""), r"\r?\n")).alias("line"))
    return read_exposition(named)


def read_soak_metadata(texts: DataFrame) -> DataFrame:
    """``file, key, value`` of each ``Key: value`` line, from ``text`` or from ``line``."""
    each = texts if "line" in texts.columns else texts.select("file", F.explode(F.split("text", r"\r?\n")).alias("line"))
    return each.filter(F.col("line").rlike(r"^[^:]+: ")).select("file", F.regexp_extract("line", r"^([^:]+): (.*)$", 1).alias("key"), F.regexp_extract("line", r"^([^:]+): (.*)$", 2).alias("value"))
