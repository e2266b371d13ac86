"""Packing, chat formatting, quality rules and URL filters against brute force on small fixtures with odd rows."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconlake.llm import chat_format, packing, quality_rules, url_filters

DOCS = "doc_id long, text string, lang string, bucket string, quality string"
ODD_TEXTS = [None, "", " \t\n", "one", "a b\tc\x0bd\ne  f", "w " * 700, "é" * 300, "x" * 20000, "# # $ | <b> & *", "The the\nThe the\n\nThe the\n", "a b c a b c a b c"]


def odd_docs(spark):
    rows = [(i, t, None if i % 3 else "en", "clash", "clash") for i, t in enumerate(ODD_TEXTS)]
    return spark.createDataFrame([*rows, rows[4], rows[4], (None, "null id " * 20, "xx", None, None)], DOCS)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---- packing


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))


@pytest.mark.parametrize("seed", range(12))
def test_optimal_bounds_equal_brute_force(seed):
    r = random.Random(seed)
    lengths = sorted(r.sample(range(0, 60), r.randint(1, 9)))
    counts = [r.randint(1, 30) for _ in lengths]
    k = r.randint(1, 5)
    best = min(padding(lengths, counts, c) for m in range(1, k + 1) for c in itertools.combinations(lengths, m) if max(c) == max(lengths))
    bounds = packing.optimal_bounds(np.array(lengths), np.array(counts), k)
    assert len(bounds) <= k and padding(lengths, counts, bounds) == best


def test_pack_whole_corpus(spark):
    p = packing.PackParams(max_len=64, buckets=3, budget=256, shard_rows=4)
    docs = odd_docs(spark)
    rows = packing.pack(docs, p).collect()
    want = Counter()
    for d in docs.collect():
        n = len(words_of(d.text))
        for k in range(max(1, -(-n // 64))):
            want[d.doc_id, k, min(64, n - 64 * k)] += 1
    assert Counter((r.doc_id, r.piece, r.n_tokens) for r in rows) == want
    assert all(r.n_tokens <= r.bucket and r.padding == r.bucket - r.n_tokens for r in rows)
    batches = Counter((r.bucket, r.shard, r.batch) for r in rows)
    assert all(n * max(1, bucket) <= max(256, bucket) for (bucket, _, _), n in batches.items())
    assert len({(r.bucket, r.shard, r.batch, r.slot) for r in rows}) == len(rows)
    assert len({r.bucket for r in rows}) <= 3


def test_repeated_ids_are_spread(spark):
    """Rows of one id, or without one, go to all shards of their bucket; a shard holds many whole batches."""
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).alias("doc_id"), F.lit("a b c").alias("text"))
    out = packing.pack(rows, packing.PackParams(budget=6, shard_rows=100)).groupBy("shard").count().collect()
    assert sum(r["count"] for r in out) == 4000 and len(out) >= 25 and max(r["count"] for r in out) < 300
    batches = packing.pack(rows, packing.PackParams(budget=30, shard_rows=20)).groupBy("shard", "batch").count().collect()
    assert sum(r["count"] < 10 for r in batches) <= len({r.shard for r in batches})


def test_pack_empty(spark):
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


# ---- chat formatting

TURNS = "conv_id long, turn long, role string, text string, segments string"


def test_chat_round_trip(spark):
    r = random.Random(4)
    parts = ["\\", "#", "### ", "<", " </turn>\n", ":", "e", "h", "\\h", "Assistant: ", "x" * 50, "é", "\n", ""]
    rows = [(c, t, r.choice(["user", "assistant", "system", "ro:le#", None, ""]), None if r.random() < 0.1 else "".join(r.choices(parts, k=r.randint(0, 8))), "clash") for c in range(60) for t in range(r.randint(1, 6))]
    rows += [(100, 1, "user", "same", ""), (100, 1, "user", "same", ""), (None, 0, "user", "null id", ""), (101, None, "user", "no turn", ""), (102, 0, "assistant", "long " * 20000, "")]
    frame = spark.createDataFrame(rows, TURNS)
    out = chat_format.format_chats(frame)
    got = {x.conv_id: x for x in out.select("*", chat_format.read_back(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("segments")).alias("loss")).collect()}
    groups = {}
    for c, t, role, text, _ in rows:
        groups.setdefault(c, []).append((t if t is not None else -1, role or "", text or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns = [(role, text) for _, role, text in sorted(turns)]
        assert [(t.role, t.text) for t in got[c].turns] == turns
        assert got[c].loss == "".join(text for role, text in turns if role == "assistant")
        assert got[c].formatted == "".join(s.text for s in got[c].segments)


@pytest.mark.parametrize("roles, valid, bad", [("ua", True, None), ("sua", True, None), ("uaua", True, None), ("u", False, None), ("au", False, 1), ("uua", False, 2), ("usa", False, 2), ("ux", False, 2)])
def test_role_machine(spark, roles, valid, bad):
    names = {"u": "user", "a": "assistant", "s": "system", "x": "tool"}
    row = chat_format.format_chats(spark.createDataFrame([(1, i, names[r], "t", "") for i, r in enumerate(roles)], TURNS)).first()
    assert (row.valid, row.first_bad_turn) == (valid, bad)


def test_chat_empty(spark):
    assert chat_format.format_chats(spark.createDataFrame([], TURNS)).count() == 0


# ---- quality rules


def brute_counts(text):
    text = text or ""
    w = words_of(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {p for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_equal_brute_force(spark):
    r = random.Random(9)
    texts = [" ".join(r.choices(["a", "b", "c", "die", "The", "é#"], k=r.randint(0, 60))).replace(" a ", "\n") for _ in range(150)]
    docs = spark.createDataFrame([(i, t, "en", "", "") for i, t in enumerate(texts)], DOCS).union(odd_docs(spark))
    out = quality_rules.quality_features(docs).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out)
    assert got == Counter((d.doc_id, *brute_counts(d.text)) for d in docs.collect())
    for row, text in [(r, texts[r.doc_id]) for r in out if r.doc_id is not None and r.doc_id >= len(ODD_TEXTS) and r.doc_id < len(texts)]:
        assert sum(row.class_counts) == len(text)
        assert all(times == words_of(text.lower()).count(word) for word, times in row.word_counts.items())


def test_js_distance(spark):
    p = F.array(F.lit(0.5), F.lit(0.5))
    row = spark.range(1).select(quality_rules.js_distance(p, [0.5, 0.5]).alias("same"), quality_rules.js_distance(F.array(F.lit(1.0), F.lit(0.0)), [0.0, 1.0]).alias("apart"), quality_rules.js_distance(p, [1.0, 0.0]).alias("half")).first()
    assert row.same == pytest.approx(0) and row.apart == pytest.approx(1) and row.half == pytest.approx(0.5579, abs=1e-3)


def test_keep_good_keeps_rows(spark):
    docs = odd_docs(spark)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.subtract(docs).count() == 0  # a column named quality stays as it is
    judged = quality_rules.quality_rules(docs)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in judged.filter("kept").collect())
    assert judged.count() == docs.count() and judged.filter("base_failed and kept").count() == 0
    assert quality_rules.keep_good(spark.createDataFrame([], DOCS)).count() == 0


def odd_language_docs(spark, lang, junk, good=0, script="a"):
    """The given corpus with further documents of one language: junk of digits and symbols, and prose of made-up words."""
    r = random.Random(f"{lang}{junk}{good}")
    first = ord(script)
    words = ["".join(chr(first + r.randrange(26)) for _ in range(r.randint(2, 9))) for _ in range(400)]

    def prose():
        return ". ".join(" ".join(r.choice(words) for _ in range(r.randint(6, 12))) for _ in range(12)) + "."

    def rubbish():
        return " ".join("".join(r.choice("0123456789#%&|<>*$;:xq") for _ in range(r.randint(3, 12))) for _ in range(120))

    rows = [(10**9 + i, rubbish() if i < junk else prose(), lang) for i in range(junk + good)]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    return docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


@pytest.mark.parametrize(("junk", "good", "script"), [(5, 5, "a"), (25, 0, "a"), (25, 3, "а"), (0, 12, "а"), pytest.param(3, 30, "a", marks=pytest.mark.xfail(reason="a new reference without common words is the nearest for some documents of other languages, and their verdict changes"))])
def test_quality_of_rare_and_dirty_languages(spark, junk, good, script):
    """Junk of a language with few good documents, or of one that is mostly junk, goes; prose of an unseen language and script stays, and others are judged as before."""
    docs = odd_language_docs(spark, "zz", junk, good, script)
    got = quality_rules.quality_rules(docs).select("doc_id", "kept", "base_failed", "nearest").collect()
    own = [x for x in got if x.doc_id >= 10**9]
    assert not any(x.base_failed for x in own)
    assert [x.kept for x in sorted(own, key=lambda x: x.doc_id)] == [False] * junk + [True] * good
    if good < 20:
        assert all(x.nearest is None for x in own)
    plain = quality_rules.quality_rules(docs.filter(F.col("doc_id") < 10**9)).select("doc_id", "kept").collect()
    assert sorted((x.doc_id, x.kept) for x in plain) == sorted((x.doc_id, x.kept) for x in got if x.doc_id < 10**9)


def test_quality_without_a_pool(spark):
    """Too few good documents in all: the base rule alone decides."""
    docs = odd_language_docs(spark, "zz", 5, 5).filter(F.col("doc_id") >= 10**9)
    assert all(x.kept and x.class_distance is None for x in quality_rules.quality_rules(docs).collect())


def test_quality_against_labels(spark):
    sf = "/root/testdata/sf0.1"
    judged = quality_rules.quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("not base_failed")
    counts = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert counts.get((1, False), 0) <= 0.005 * counts[1, True]
    assert counts.get((0, False), 0) >= 0.5 * (counts.get((0, True), 0) + counts.get((0, False), 0))


def test_every_language_has_its_reference(spark):
    """Documents of a language that nothing was fixed for are kept like others; one without a reference is left alone."""
    r = random.Random(4)

    def prose(lang, letters):
        common = ["".join(r.choices(letters, k=2)) for _ in range(9)]
        rare = ["".join(r.choices(letters, k=r.randint(4, 9))) for _ in range(800)]
        return [(lang, " ".join(r.choice(common) if r.random() < 0.45 else r.choice(rare) for _ in range(200)) + ".") for _ in range(60)]

    texts = prose("it", "aeiolnrtscdp") + prose("xx", [chr(c) for c in range(0x4E00, 0x4E80)]) + prose("yy", "qwzkjx")[:5]
    texts += [("it", " ".join("".join(r.choices("QX7#|&", k=5)) for _ in range(200))) for _ in range(3)]
    docs = spark.createDataFrame([(i, t, lang, "", "") for i, (lang, t) in enumerate(texts)], DOCS)
    rows = sorted(quality_rules.quality_rules(docs).collect(), key=lambda x: x.doc_id)
    assert all(x.kept for x in rows[:125]) and not any(x.kept for x in rows[125:])
    assert {x.nearest for x in rows[:60]} == {"it"} and {x.nearest for x in rows[60:120]} == {"xx"} and {x.nearest for x in rows[120:125]} == {None}


def test_repeats_in_a_long_text(spark):
    """Over the limit of the short codes, windows are compared by pairs; the counts are the same."""
    r = random.Random(6)
    text = " ".join(r.choices([f"w{i}" for i in range(60)], k=5000))
    docs = spark.createDataFrame([(1, text, "en", "", "")], DOCS)
    want = brute_counts(text)[-1]
    for limit in (100, 8192):
        assert quality_rules.quality_features(docs, quality_rules.QualityParams(long_text_words=limit)).first().n_repeat_words == want


def test_short_documents_against_labels(spark):
    sf = "/root/testdata/sf0.1"
    judged = quality_rules.quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("not base_failed and n_words < 100")
    for fold in (0, 1):  # the limit was set on fold 0
        rows = judged.filter(F.crc32(F.col("doc_id").cast("string")) % 2 == fold).groupBy("quality", "kept").count().collect()
        counts = {(r.quality, r.kept): r["count"] for r in rows}
        assert counts.get((1, False), 0) <= 0.01 * counts[1, True]
        assert counts.get((0, False), 0) >= 0.6 * (counts.get((0, True), 0) + counts.get((0, False), 0))


# ---- URL filters

PAGES = "page_id long, url string, html string, host string, verdict string"
RULES = (url_filters.Rule("allow", "org", "/"), url_filters.Rule("block", "example.org", "/es/"), url_filters.Rule("block", "example.org", "/en/1"), url_filters.Rule("allow", "com", "/fr/"))


def test_url_filter_equals_brute_force(spark):
    r = random.Random(2)
    urls = [f"{s}://{h}{p}{q}" for s in ("http", "HTTPS") for h in ("Example.ORG", "a.example.org", "xexample.org", "www.b.net", "b.net", "c.com:80") for p in ("", "/", "/es/1", "/en/12", "/en/2/", "/fr/") for q in ("", "?utm_source=z", "?b=2&a=1&utm_x=1", "?a=1&b=2", "#top")]
    rows = [(i, u, None, "clash", "clash") for i, u in enumerate(urls)] + [(9000, None, "", "", ""), (9001, "no scheme", "", "", ""), (9002, "", "", "", ""), (None, urls[3], "", "", ""), (9003, "http://", "", "", "")]
    listed = [(r.choice(urls),) for _ in range(30)] + [(None,), ("bad",)]

    def canonical(u):
        if not u or "://" not in u:
            return None
        host, path, query = re.match(r"([^/?#]*)([^?#]*)(?:\?([^#]*))?", u.split("://", 1)[1]).groups()
        params = sorted(p for p in (query or "").split("&") if p and not p.startswith("utm_"))
        return re.sub(r"^www\.", "", host.lower()) + path.rstrip("/") + ("?" + "&".join(params) if params else "")

    blocked = {canonical(u) for (u,) in listed} - {None}
    out = url_filters.url_filter(spark.createDataFrame(rows, PAGES), RULES, spark.createDataFrame(listed, "url string")).collect()
    assert len(out) == len(rows)
    by_id = {x.page_id: x for x in out}
    for i, u, *_ in rows:
        x = by_id[i]
        host, path = ("", "") if not u or "://" not in u else re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1]).groups()
        fits = [k for k in RULES if (host.lower() == k.host or host.lower().endswith("." + k.host)) and path.startswith(k.path)]
        rule = max(fits, key=lambda k: len(k.label), default=None)
        assert (x.host, x.path, x.rule) == (host.lower(), path, rule.label if rule else None)
        assert x.verdict == (rule.verdict if rule else "block" if canonical(u) in blocked else "allow"), u


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("k"))
    blocks = url_filters.blocks_for(3000)
    bloom = url_filters.bloom_blocks(keys, "k", blocks)
    probe = spark.range(9000).select(F.concat(F.lit("k"), "id").alias("k"), "id", url_filters._block(F.concat(F.lit("k"), "id"), blocks).alias("bloom_block")).join(bloom, "bloom_block", "left")
    hit = F.lit(True)
    for j, mask in enumerate(url_filters._masks(F.col("k"))):
        hit = hit & F.coalesce(F.col(f"w{j}").bitwiseAND(mask) == mask, F.lit(False))
    assert probe.filter(hit & (F.col("id") < 3000)).count() == 3000
    assert probe.filter(hit & (F.col("id") >= 3000)).count() < 120
    assert url_filters.blocks_for(10**12) == url_filters.MAX_BLOCKS


def test_url_filter_empty(spark):
    none = spark.createDataFrame([], PAGES)
    assert url_filters.url_filter(none, RULES, none).count() == 0


def test_formatted_digests(spark):
    text = "\\### Assistant: </turn> ok"
    rows = spark.createDataFrame([(-7, 0, "user", text, ""), (-7, 1, "assistant", text, "")], TURNS)
    row = chat_format.format_chats(rows).select(chat_format.loss_text(F.col("segments")).alias("loss")).first()
    assert hashlib.sha256(row.loss.encode()).hexdigest() == hashlib.sha256(text.encode()).hexdigest()
