"""Packing into optimal length buckets with token-budget batches.

Texts are cut into pieces of at most ``max_len`` words; the global histogram of piece lengths (at most ``max_len``
numbers, whatever the size of the corpus) is brought to the driver, where dynamic programming picks the bucket
bounds that minimise padding. Every piece goes to the smallest bucket that holds it, and batches of
``budget // bound`` rows form inside the buckets. A bucket is dealt into shards of about ``shard_rows`` pieces, or of ``shard_batches`` batches where that is more, so
that no task gets a whole bucket; only the last batch of a shard can be short. Pieces are dealt by a hash of their id and their place in the input, so that
an id that is repeated very often is spread too; other splits of the input give other batches of the same sizes.

Words are maximal runs of characters other than space and U+0009 to U+000D. Defined results: a null or empty text
has no words and gives one piece of length 0, which stands in the smallest bucket, so no document is lost; repeated rows
are packed as often as they occur (rows alike in id and piece number take any order among themselves); very long texts
become many pieces and are never cut off.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD_BREAK = r"[\x20\x09-\x0D]+"
BREAKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class PackParams:
    max_len: int = 2048
    buckets: int = 12
    budget: int = 16384
    shard_rows: int = 2048
    shard_batches: int = 64


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(BREAKS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, WORD_BREAK)))


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Bucket bounds, ascending, that minimise the padding of ``counts`` pieces of the distinct ``lengths``.

    cost(i, j) is what it takes to pad lengths i..j to lengths[j]; best[k][j] = min over i of best[k-1][i-1] + cost(i, j).
    Uses as few buckets as give the least padding; among equals, the smaller bounds.
    """
    order = np.argsort(lengths)
    length, count = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n = len(length)
    if not n:
        return []
    number = np.concatenate([[0], np.cumsum(count)])
    total = np.concatenate([[0], np.cumsum(count * length)])
    best = np.full(n + 1, np.iinfo(np.int64).max // 4, np.int64)
    best[0] = 0
    froms = []
    for _ in range(min(buckets, n)):
        step, came = best.copy(), np.full(n + 1, -1)
        step[0] = 0
        for j in range(1, n + 1):
            i = np.arange(j)
            padding = best[:j] + (number[j] - number[i]) * length[j - 1] - (total[j] - total[i])
            k = int(np.argmin(padding))
            if padding[k] < step[j]:
                step[j], came[j] = padding[k], k
        froms.append(came)
        best = step
    bounds, j = [], n
    for came in reversed(froms):
        if j > 0 and came[j] >= 0:
            bounds.append(int(length[j - 1]))
            j = int(came[j])
    return bounds[::-1]


def pieces(docs: DataFrame, params: PackParams, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, first_word, n_tokens``: each text as consecutive pieces of at most ``max_len`` words."""
    sized = docs.select(F.col(doc_id).alias("doc_id"), n_words(F.col(text)).alias("n"))
    last = F.greatest(F.ceil(F.col("n") / params.max_len).cast("int") - 1, F.lit(0))
    cut = sized.select("doc_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    first = F.col("piece") * params.max_len
    return cut.select("doc_id", "piece", first.alias("first_word"), F.least(F.lit(params.max_len), F.col("n") - first).alias("n_tokens"))


def pack(docs: DataFrame, params: PackParams = PackParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, first_word, n_tokens, bucket, shard, batch, slot, padding`` for every piece.

    A batch is named by (bucket, shard, batch) and holds at most ``budget`` tokens, padding included.
    """
    from .scratch import written

    # the place is written, so that a task that is run again deals its rows as before
    cut = written(pieces(docs, params, doc_id, text).withColumn("place", F.monotonically_increasing_id()), "pieces")
    histogram = cut.groupBy("n_tokens").count().toPandas()  # at most max_len + 1 rows
    bounds = optimal_bounds(histogram["n_tokens"].to_numpy(), histogram["count"].to_numpy(), params.buckets)
    if not bounds:
        bounds = [params.max_len]
    inside = np.searchsorted(bounds, histogram["n_tokens"].to_numpy(np.int64)) if len(histogram) else np.array([], int)
    held = np.bincount(inside, weights=histogram["count"].to_numpy(np.float64), minlength=len(bounds)) if len(histogram) else np.zeros(len(bounds))

    bucket, shards, per_batch = F.lit(bounds[-1]), F.lit(1), F.lit(1)
    for bound, rows in reversed(list(zip(bounds, held, strict=True))):
        here = F.col("n_tokens") <= bound
        bucket = F.when(here, F.lit(bound)).otherwise(bucket)
        fits = max(1, params.budget // max(1, bound))
        shards = F.when(here, F.lit(max(1, -(-int(rows) // max(params.shard_rows, params.shard_batches * fits))))).otherwise(shards)
        per_batch = F.when(here, F.lit(fits)).otherwise(per_batch)
    placed = cut.withColumns({"bucket": bucket, "per_batch": per_batch, "shard": F.pmod(F.xxhash64("doc_id", "piece", "place"), shards).cast("int")})
    at = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "piece", "place")) - 1
    return placed.withColumn("at", at).select(
        "doc_id", "piece", "first_word", "n_tokens", "bucket", "shard",
        F.floor(F.col("at") / F.col("per_batch")).alias("batch"), (F.col("at") % F.col("per_batch")).alias("slot"),
        (F.col("bucket") - F.col("n_tokens")).alias("padding"),
    )
