"""Ordered scans of a key's rows in two levels, so that no task orders a whole key.

A window over a device holds all its packets in one task. Here the rows of a key are cut into ranges of their order, and every range is scanned by itself;
a range leaves one summary row (sums, last values, whether there was a reset), the summaries are scanned in order, and what comes from the
ranges before is joined back and combined with each row's local value. Summaries are made by plain aggregates, so tasks add up before anything is sent, and a
key with most of all rows is as many groups as it has ranges.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: So many numbers of the order make a range where the caller gives no other width.
WIDTH = 1 << 16


def ranges(order: Column | str, width: int) -> Column:
    """The range of a whole number; rows without one come first and are one range."""
    order = F.col(order) if isinstance(order, str) else order
    return F.floor(order / width)


@dataclass
class Scan:
    """What is computed over the rows of each key, in order; names are those of the new columns.

    ``sums`` and ``least``: running sums and minima with the row's own value; ``before``: the value of the row before, null in a key's first; ``known``: the last value before the row that isn't null;
    ``last``: the last value that isn't null since the last reset, the row's own among them; ``first``: the value of the key's first row. ``reset`` is true where ``last`` begins anew.
    """

    keys: list[str]
    order: list[str]
    ranged: Column
    sums: dict[str, Column] = field(default_factory=dict)
    least: dict[str, Column] = field(default_factory=dict)
    before: dict[str, Column] = field(default_factory=dict)
    known: dict[str, Column] = field(default_factory=dict)
    last: dict[str, Column] = field(default_factory=dict)
    first: dict[str, Column] = field(default_factory=dict)
    reset: Column | None = None

    def over(self, rows: DataFrame) -> DataFrame:
        """The rows with the new columns. Columns that begin with ``_scan_`` are this module's own."""
        out = [*self.sums, *self.least, *self.before, *self.known, *self.last, *self.first]
        place = F.col(self.order[0]) if len(self.order) == 1 else F.struct(*[F.col(c) for c in self.order])
        # the key is a struct, so that null keys meet in the join
        ranged = rows.withColumns({"_scan_key": F.struct(*[F.col(k) for k in self.keys]), "_scan_range": F.struct(self.ranged), "_scan_reset": F.coalesce(self.reset, F.lit(False)) if self.reset is not None else F.lit(False)})
        values = {**self.sums, **self.least, **self.before, **self.known, **self.last, **self.first}
        ranged = ranged.withColumns({f"_scan_v{i}": values[name] for i, name in enumerate(out)})
        at = {name: F.col(f"_scan_v{i}") for i, name in enumerate(out)}
        carry = self._carried(ranged, at, place)

        by_range = Window.partitionBy("_scan_key", "_scan_range").orderBy(*self.order)
        so_far, earlier = by_range.rowsBetween(Window.unboundedPreceding, 0), by_range.rowsBetween(Window.unboundedPreceding, -1)
        resets = F.sum(F.col("_scan_reset").cast("long")).over(so_far)
        local = ranged.withColumn("_scan_resets", resets) if self.last else ranged
        new: dict[str, Column] = {}
        for name in self.sums:
            new[name] = F.sum(at[name]).over(so_far)
        for name in self.least:
            new[name] = F.min(at[name]).over(so_far)
        for name in self.before:
            new[name] = F.lag(at[name]).over(by_range)
        for name in self.known:
            new[name] = F.last(at[name], ignorenulls=True).over(earlier)
        for name in self.last:
            new[name] = F.last(F.when(at[name].isNotNull(), F.struct(F.col("_scan_resets").alias("r"), at[name].alias("v"))), ignorenulls=True).over(so_far)
        begins = {"_scan_begins": F.row_number().over(by_range) == 1} if self.before else {}
        local = local.withColumns({f"_scan_w{i}": new[name] for i, name in enumerate(out) if name in new} | begins)
        joined = local.join(carry, ["_scan_key", "_scan_range"], "left")
        done: dict[str, Column] = {}
        for i, name in enumerate(out):
            here, from_before = F.col(f"_scan_w{i}"), F.col(f"_scan_c{i}")
            if name in self.sums:
                done[name] = F.coalesce(here + from_before, here, from_before)
            elif name in self.least:
                done[name] = F.least(here, from_before)
            elif name in self.before:
                done[name] = F.when(F.col("_scan_begins"), from_before).otherwise(here)
            elif name in self.known:
                done[name] = F.coalesce(here, from_before)
            elif name in self.last:
                since = F.when(here["r"] == F.col("_scan_resets"), here["v"])
                done[name] = F.when(F.col("_scan_resets") == 0, F.coalesce(since, from_before)).otherwise(since)
            else:
                done[name] = from_before
        kept = [F.col(f"`{c}`") for c in rows.columns if c not in done]
        return joined.select(*kept, *[value.alias(name) for name, value in done.items()])

    def _carried(self, ranged: DataFrame, at: dict[str, Column], place: Column) -> DataFrame:
        """A row a range with what its rows have from the ranges before."""
        out = list(at)
        totals = [F.max(F.when(F.col("_scan_reset"), place)).alias("_scan_last_reset")]
        for i, name in enumerate(out):
            value, given = at[name], F.when(at[name].isNotNull(), place)
            # plain values and numbers as places, so that tasks add up in hash tables
            of = {"sums": lambda: F.sum(value), "least": lambda: F.min(value), "before": lambda: F.max_by(value, place), "known": lambda: F.max_by(value, given), "last": lambda: F.max_by(value, given), "first": lambda: F.min_by(value, place)}  # noqa: B023
            totals.append(of[self._kind(name)]().alias(f"_scan_t{i}"))
            if name in self.last:
                totals.append(F.max(given).alias(f"_scan_p{i}"))
        each = ranged.groupBy("_scan_key", "_scan_range").agg(*totals)
        by_key = Window.partitionBy("_scan_key").orderBy("_scan_range")
        so_far, earlier = by_key.rowsBetween(Window.unboundedPreceding, 0), by_key.rowsBetween(Window.unboundedPreceding, -1)
        part = each.withColumn("_scan_part", F.sum(F.col("_scan_last_reset").isNotNull().cast("long")).over(so_far))
        in_part = Window.partitionBy("_scan_key", "_scan_part").orderBy("_scan_range").rowsBetween(Window.unboundedPreceding, 0)
        lasts = {}
        for i, name in enumerate(out):
            if name in self.last:  # what a range hands on: its own last value if no reset follows it, else what it was given
                own = F.when(F.col("_scan_last_reset").isNull() | (F.col(f"_scan_p{i}") >= F.col("_scan_last_reset")), F.col(f"_scan_t{i}"))
                lasts[f"_scan_t{i}"] = F.last(own, ignorenulls=True).over(in_part)
        carried = part.withColumns(lasts) if lasts else part
        columns = []
        for i, name in enumerate(out):
            total = F.col(f"_scan_t{i}")
            of = {"sums": lambda: F.sum(total).over(earlier), "least": lambda: F.min(total).over(earlier), "known": lambda: F.last(total, ignorenulls=True).over(earlier), "first": lambda: F.first(total).over(so_far)}  # noqa: B023
            columns.append(of.get(self._kind(name), lambda: F.lag(total).over(by_key))().alias(f"_scan_c{i}"))  # noqa: B023
        return carried.select("_scan_key", "_scan_range", *columns)

    def _kind(self, name: str) -> str:
        return next(kind for kind in ("sums", "least", "before", "known", "last", "first") if name in getattr(self, kind))


def by_packet(width: int = WIDTH, **what) -> Scan:
    """A scan over the packets of each device in order of ``pkt_no``."""
    return Scan(["device_id"], ["pkt_no"], ranges("pkt_no", width), **what)
