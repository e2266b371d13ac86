"""URL filters: declared host/path rules, then a blocked Bloom filter in front of an exact hash join.

``url_filter(pages, rules, listed)`` judges every URL:

* a rule that fits (its host or a subdomain of it, and a path that starts with the rule's) decides; the longest
  rule wins;
* any other URL is blocked exactly when its canonical form is in ``listed``. A blocked Bloom filter (512-bit
  blocks of eight 64-bit words, one bit a word) of the listed canonical URLs passes the possible hits on to a hash
  join with the list, which removes the false positives. URLs that the filter clears are never shuffled.

The filter has as many blocks of 72 bytes as fit in ``filter_mb``, which bounds its broadcast at any list
length; a list over about 4 million URLs for 10 MB raises the share of URLs that the exact join has to clear, so a long list calls for a
larger budget. The canonical list is written once.

Defined results: a null URL, or one without ``://``, has empty host and path, no rule and no canonical form, and is
allowed. Null URLs in ``listed`` are skipped; repeated ones count once. A very common URL makes one large join key,
which adaptive skew handling splits, as the list side has one row a key.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

FILTER_MB = 10
BLOCK_BYTES = 72
MAX_BLOCKS = 1 << ((FILTER_MB << 20) // BLOCK_BYTES).bit_length() - 1
BITS_PER_KEY = 16
WORDS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """``verdict`` (allow or block) for ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def label(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without trailing slashes, sorted query without ``utm_`` tags, no fragment; null
    where there is no ``://``."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_")))
    bare = F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), r"/+$", ""))
    full = F.when(F.size(kept) > 0, F.concat(bare, F.lit("?"), F.array_join(kept, "&"))).otherwise(bare)
    return F.when(F.instr(url, "://") > 0, full)


def rule_fits(rule: Rule, host: Column, path: Column) -> Column:
    inside = (host == rule.host) | F.endswith(host, F.lit("." + rule.host))
    return inside & F.startswith(path, F.lit(rule.path))


def _first_fit(rules: Sequence[Rule], host: Column, path: Column, value: str) -> Column:
    """``value`` of the longest rule that fits, else null; ties go to the label that sorts first."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.label), [-ord(c) for c in r.label])):
        found = F.when(rule_fits(rule, host, path), F.lit(getattr(rule, value))).otherwise(found)
    return found


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    """One bit for each word of a block, from a hash that is independent of the block number."""
    bits = F.xxhash64(key, F.lit("bits"))
    return [_bit(bits, j) for j in range(WORDS)]


def _bit(bits: Column, j: int) -> Column:
    place = F.shiftrightunsigned(bits, 6 * j).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def bloom_blocks(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter as a table: ``bloom_block`` and its words ``w0``..``w7``, for blocks with a bit set."""
    masked = keys.select(_block(F.col(key), blocks).alias("bloom_block"), *(m.alias(f"w{j}") for j, m in enumerate(_masks(F.col(key)))))
    return masked.groupBy("bloom_block").agg(*(F.bit_or(f"w{j}").alias(f"w{j}") for j in range(WORDS)))


def blocks_for(n_keys: int, filter_mb: int = FILTER_MB) -> int:
    """Blocks for ``BITS_PER_KEY`` bits a key, as a power of two, as far as they fit in ``filter_mb``."""
    blocks = 1
    while 2 * blocks * BLOCK_BYTES <= filter_mb << 20 and blocks * 64 * WORDS < n_keys * BITS_PER_KEY:
        blocks *= 2
    return blocks


def url_filter(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame, page_id: str = "page_id", url: str = "url", listed_url: str = "url", filter_mb: int = FILTER_MB) -> DataFrame:
    """``page_id, host, path, rule, verdict, canonical_url, bloom_hit`` for every row of ``pages``.

    ``bloom_hit`` says whether the exact join had to look the URL up (false where a rule decided).
    """
    keys = listed.select(canonical(F.col(listed_url)).alias("listed_key")).filter(F.col("listed_key").isNotNull()).distinct()
    keys = written(keys, "listed")
    blocks = blocks_for(keys.count(), filter_mb)
    bloom = bloom_blocks(keys, "listed_key", blocks)

    address = F.col(url)
    parsed = pages.select(F.col(page_id).alias("page_id"), host_of(address).alias("host"), path_of(address).alias("path"), canonical(address).alias("canonical_url"))
    ruled = parsed.withColumns({
        "rule": _first_fit(rules, F.col("host"), F.col("path"), "label"),
        "rule_verdict": _first_fit(rules, F.col("host"), F.col("path"), "verdict"),
        "bloom_block": _block(F.col("canonical_url"), blocks),
    })
    all_set = F.lit(True)
    for j, mask in enumerate(_masks(F.col("canonical_url"))):
        all_set = all_set & (F.col(f"w{j}").bitwiseAND(mask) == mask)
    probed = ruled.join(F.broadcast(bloom), "bloom_block", "left").withColumn(
        "bloom_hit", F.coalesce(F.col("rule").isNull() & F.col("canonical_url").isNotNull() & all_set, F.lit(False))
    )
    out = ["page_id", "host", "path", "rule", "verdict", "canonical_url", "bloom_hit"]
    cleared = probed.filter(~F.col("bloom_hit")).withColumn("verdict", F.coalesce("rule_verdict", F.lit("allow"))).select(out)
    hits = probed.filter("bloom_hit").drop("bloom_block", *(f"w{j}" for j in range(WORDS)))
    looked_up = (
        hits.join(keys.hint("shuffle_hash"), hits["canonical_url"] == keys["listed_key"], "left")
        .withColumn("verdict", F.when(F.col("listed_key").isNotNull(), "block").otherwise("allow"))
        .select(out)
    )
    return cleared.unionByName(looked_up)
