"""The n-gram Jaccard join and the pipeline against brute force."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from beaconlake.llm import components, ngram_join, queries

DOCS = "doc_id long, text string, cls string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, n, percent):
    """(doc_id, set size, least id of its component) by comparing every pair that shares a shingle."""
    sets = []
    for _, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in holders[x] if j < i)
        for j, k in shared.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                up[top(i)] = top(j)
    least = {}
    for i, row in enumerate(rows):
        r = top(i)
        least[r] = min(least.get(r, row[0]), row[0])
    return sorted((row[0], len(sets[i]), least[top(i)]) for i, row in enumerate(rows))


def made_rows(seed, size):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [r.choices(words, k=r.randint(3, 120)) for _ in range(size // 25)]
    passage, rows = r.choices(words, k=60), []
    for i in range(size):
        kind, b = r.random(), list(r.choice(base))
        if kind < 0.5:
            for _ in range(r.randint(0, 4)):
                b[r.randrange(len(b))] = r.choice(words)
        elif kind < 0.6:
            b = b[r.randint(0, 3) :] + r.choices(words, k=r.randint(0, 5))
        elif kind < 0.75:
            b = r.choices(words, k=r.randint(20, 60)) + passage
        elif kind < 0.8:
            b = passage + r.choices(words, k=r.randint(0, 8))
        elif kind < 0.85:
            b = r.choices(words[:6], k=r.randint(0, 9))
        else:
            b = r.choices(words, k=r.randint(0, 200))
        rows.append((i, None if r.random() < 0.01 else " ".join(x.upper() if r.random() < 0.1 else x for x in b), "clash"))
    return rows


@pytest.mark.parametrize("params", [ngram_join.JoinParams(words=4, percent=85), ngram_join.JoinParams(cell=20, leaf=4, sketch_bits=6), ngram_join.JoinParams(words=1, percent=60, cell=40, leaf=8, groups=16)])
def test_join_equals_brute_force(spark, params):
    rows = made_rows(3, 600)
    got = ngram_join.link_components(spark.createDataFrame(rows, DOCS).repartition(4), params).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute(rows, params.words, params.percent)


def test_registered_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op2_ngram_join(spark, sf).collect())) == brute(rows, 4, 85)


def brute_links(rows, n, percent):
    """(doc_id, number of other rows that are linked with it) by comparing all pairs."""
    sets = []
    for _, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    linked = [0] * len(rows)
    for i, s in enumerate(sets):
        for j in range(i):
            k = len(s & sets[j])
            if k and 100 * k >= percent * (len(s) + len(sets[j]) - k):
                linked[i] += 1
                linked[j] += 1
    return sorted((row[0], linked[i]) for i, row in enumerate(rows))


@pytest.mark.parametrize("params", [ngram_join.JoinParams(words=4, percent=85), ngram_join.JoinParams(cell=20, leaf=4, sketch_bits=6, link_rows=7), ngram_join.JoinParams(words=1, percent=60, groups=16, link_shingles=900)])
def test_link_counts_equal_brute_force(spark, params):
    rows = made_rows(3, 600)
    rows += [(1000 + i, text, "copy") for i, (_, text, _) in enumerate(rows[:40])]
    got = ngram_join.link_counts(spark.createDataFrame(rows, DOCS).repartition(4), params)
    want = brute_links(rows, params.words, params.percent)
    assert max(n for _, n in want) > 3  # links inside components, more than a star gives
    assert sorted(map(tuple, got.select("doc_id", "n_links").collect())) == want
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == brute(rows, params.words, params.percent)


def test_link_counts_of_repeated_rows(spark):
    """Rows repeated one to five times under one id: each counts, and no link twice."""
    rows = [row for i, row in enumerate(made_rows(8, 200)) for _ in range(1 + i % 5)]
    p = ngram_join.JoinParams(words=2, percent=70, cell=20, leaf=4, link_rows=9)
    got = ngram_join.link_counts(spark.createDataFrame(rows, DOCS).repartition(4), p)
    assert sorted(map(tuple, got.select("doc_id", "n_links").collect())) == brute_links(rows, 2, 70)


def test_repeated_row_is_one_text(spark, tmp_path):
    """A third of the rows are one row: it is verified as one text, and the other rows' results stay as they are."""
    rows = made_rows(9, 300)
    whole = " ".join(f"z{i}" for i in range(80))
    rows += [(5000, whole, "")] * 150 + [(5001, whole + " end", "")]
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    paths = []
    p = ngram_join.JoinParams()
    named = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), "text")
    sets = ngram_join.summarise(docs, p, "doc_id", "text", paths)
    least = ngram_join.classes_of(sets)
    assert least.filter("rows >= 150").select("one.copies").collect()[0][0] == 150
    pairs = least.select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    texts = ngram_join._texts(pairs, least, named, p, paths)
    assert texts.count() == texts.select("cls").distinct().count() == least.count()
    got = ngram_join.link_components(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute(rows, 5, 80)


def test_keep_first_with_any_names(spark):
    names = ["doc_id", "text", "id", "key", "keep_id", "keep_key", "row", "body", "_keep_id", "cls"]
    docs = spark.createDataFrame([(1, "a b c d e f", *"qrstuvwx"), (2, "a b c d e f", *"qrstuvwx"), (3, "other", *"qrstuvwx")], names)
    kept = ngram_join.keep_first(docs)
    assert kept.columns == names and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_link_counts_empty(spark):
    assert ngram_join.link_counts(spark.createDataFrame([], DOCS)).count() == 0


def test_odd_rows_and_keep_first(spark):
    a, b = " ".join(f"x{i}" for i in range(60)), " ".join(f"x{i}" for i in range(59)) + " other"
    rows = [(5, a, ""), (3, b, ""), (5, a, ""), (7, None, ""), (8, "", ""), (9, " \n", ""), (10, "one", ""), (11, "ONE", ""), (None, a, ""), (12, "y " * 30000, "")]
    docs = spark.createDataFrame(rows, DOCS)
    got = Counter(map(tuple, ngram_join.link_components(docs).select("doc_id", "component_id").collect()))
    assert got == Counter({(5, 3): 2, (3, 3): 1, (7, 7): 1, (8, 8): 1, (9, 9): 1, (10, 10): 1, (11, 10): 1, (None, 3): 1, (12, 12): 1})
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert sum(ids.values()) == 6 and all(ids[i] == 1 for i in (3, 7, 8, 9, 10, 12))
    copies = spark.createDataFrame([(1, a, "u"), (1, a, "v"), (2, a, "w")], DOCS)
    assert [r.doc_id for r in ngram_join.keep_first(copies).collect()] == [1]


def test_join_empty(spark):
    none = spark.createDataFrame([], DOCS)
    assert ngram_join.link_components(none).count() == 0 and ngram_join.keep_first(none).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200)]
    got = {r.node: r.label for r in components.connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "ngram_join", "packing"]
    from beaconlake.llm.scratch import written

    stage = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = written(f(spark, stage, sf), name)
        assert out.columns == docs.columns and 0 < out.count() <= stage.count()
        assert out.join(stage, "doc_id", "left_anti").count() == 0
        stage = out
    rows = [tuple(r) for r in stage.select("doc_id", "text").collect()]
    assert all(d == c for d, _, c in brute(rows, 5, 80))  # no two that stay are linked
    packed = corpus_pipeline.STAGES[-1][1](spark, stage, sf)
    assert packed.select("doc_id").distinct().count() == stage.count()
    assert packed.agg(F.max("n_tokens")).first()[0] <= 2048
