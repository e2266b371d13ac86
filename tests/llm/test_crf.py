"""The chain over lines: exact inference, gradients, features, defined results, and held-out labels."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from beaconlake.llm import line_crf, queries
from beaconlake.llm.line_crf import BASE, CrfParams, line_features, marginals
from beaconlake.llm.shingles import buffer_of

SF = "/root/testdata/sf0.01"


def chain(rng, places):
    return {"T": rng.standard_normal((2, 2)), "B": rng.standard_normal(2), "w": rng.standard_normal(3)}, rng.standard_normal((places, 3))


def log_weight(labels, emission, params):
    """Of one labelling of a chain."""
    first, *_ = labels
    total = params["B"][first] + sum((0.5 if y else -0.5) * e for y, e in zip(labels, emission, strict=True))
    return total + sum(params["T"][a, b] for a, b in zip(labels, labels[1:], strict=False))


@pytest.mark.parametrize("sizes", [[1], [5], [1, 4, 2, 7, 1]])
def test_marginals_equal_enumeration(sizes):
    rng = np.random.default_rng(len(sizes))
    params, x = chain(rng, sum(sizes))
    emission, want, at = x @ params["w"], [], 0
    for n in sizes:
        every = list(itertools.product((0, 1), repeat=n))
        weight = np.exp([log_weight(y, emission[at : at + n], params) for y in every])
        want += list((weight[:, None] * np.array(every)).sum(0) / weight.sum())
        at += n
    assert np.allclose(marginals(emission, np.array(sizes), params), want, atol=1e-9)


def test_long_chain_is_stable():
    lines = np.array([200_000, 3])
    rng = np.random.default_rng(2)
    params, x = chain(rng, int(lines.sum()))
    good = marginals(40 * x @ params["w"], lines, params)
    assert np.isfinite(good).all() and good.min() >= 0 and good.max() <= 1
    assert np.allclose(good[-3:], marginals(40 * x[-3:] @ params["w"], np.array([3]), params), atol=1e-9)


def test_gradients_equal_differences():
    rng = np.random.default_rng(3)
    lines = np.array([4, 1, 3])
    params, x = chain(rng, 8)
    label = rng.integers(0, 2, 8)

    def loss():
        total, at = 0.0, 0
        for n in lines:
            emission = x[at : at + n] @ params["w"]
            every = [log_weight(y, emission, params) for y in itertools.product((0, 1), repeat=int(n))]
            total += np.logaddexp.reduce(every) - log_weight(label[at : at + n], emission, params)
            at += n
        return total / len(x)

    for name, gradient in line_crf.gradients(x, label, lines, params).items():
        for at in np.ndindex(gradient.shape):
            value, e = params[name][at], 1e-6
            params[name][at] = value + e
            up = loss()
            params[name][at] = value - e
            down = loss()
            params[name][at] = value
            assert gradient[at] == pytest.approx((up - down) / (2 * e), rel=1e-3, abs=1e-6), name


def test_features():
    texts = ["One two two.\n\nOne two two.\nabc", "", "\n", "ÄB # 12\tx!", None, "tail\n"]
    base, chars, lines = line_features(*buffer_of(pa.array(texts)))
    assert lines.tolist() == [4, 1, 2, 1, 1, 2]
    assert chars.tolist() == [12, 0, 12, 3, 0, 0, 0, 10, 0, 4, 0]
    of = dict(zip(BASE, base.T, strict=True))
    assert of["repeats_line"].tolist() == [0, 0, 1] + [0] * 8  # an empty line repeats nothing
    assert of["empty"].tolist() == [0, 1, 0, 0, 1, 1, 1, 0, 1, 0, 1]
    assert of["doubled_words"][0] == 0 and of["distinct_words"][0] == 1  # "two" and "two." differ
    assert of["marks"][7] == pytest.approx(0.1) and of["symbols"][7] == pytest.approx(0.1) and of["digits"][7] == pytest.approx(0.2)
    assert of["word_length"][7] == pytest.approx(8 / 4 - 0.25)
    # whatever stands around a text, its measures are the same
    for i, t in enumerate(texts):
        alone = line_features(*buffer_of(pa.array([t])))[0]
        assert np.allclose(alone, base[lines[:i].sum() : lines[: i + 1].sum()], atol=1e-6)


def held_out(spark, sf):
    got = queries.op11_line_crf(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id").filter("held_out").toPandas()
    return got


def test_held_out_quality(spark):
    got = held_out(spark, "/root/testdata/sf0.1")
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert (got.predicted == (got.score >= 0.3)).all() and got.score.between(0, 1).all()
    assert len(bad) > 50 and (good.predicted == 1).mean() >= 0.99 and (bad.predicted == 0).mean() >= 0.95


def test_no_input_but_the_text(spark):
    """Scores don't depend on the order, the other columns, or the batch."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = line_crf.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    some = docs.limit(60)
    one = {r.doc_id: r.score for r in line_crf.score(some, model).collect()}
    other = some.withColumns({"lang": F.lit("x"), "score": F.lit(1), "lines": F.lit(2)}).repartition(7)
    assert {r.doc_id: r.score for r in line_crf.score(other, model).collect()} == one
    lines = {r.doc_id: r["count"] for r in line_crf.label_lines(some, model).groupBy("doc_id").count().collect()}
    assert lines == {r.doc_id: (r.text or "").count("\n") + 1 for r in some.collect()}


def test_defined_results(spark):
    schema = "doc_id long, text string, quality int, features string"
    docs = spark.createDataFrame([(1, "a b c", 1, "x"), (1, "a b c", 1, "x"), (2, None, 0, "x"), (None, "x", 1, "x"), (3, "", 0, None), (4, "word " * 200_000, None, None), (5, "a\n" * 50_000, 1, "x")], schema)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (4, 1), (5, 1), (5, None), (3, 7)], "doc_id long, quality int")
    model = line_crf.fit(docs, labels)
    got = sorted(((r.doc_id or 0, r.score, r.predicted) for r in line_crf.score(docs, model).collect()))
    assert len(got) == 7 and all(0 <= s <= 1 for _, s, _ in got)
    assert line_crf.score(docs.limit(0), model).count() == 0
    # one label only: the share of good rows
    for quality, want in ((1, 1.0), (0, 0.0)):
        one = line_crf.fit(docs, labels.filter(f"quality = {quality}"))
        assert {r.score for r in line_crf.score(docs, one).collect()} == {want}
    assert {r.score for r in line_crf.score(docs, line_crf.fit(docs, labels.limit(0))).collect()} == {1.0}


def test_long_rows_teach_too(spark):
    """Texts of any length are among the training rows, and a bound on rows keeps both labels."""
    rows = [(i, ("good line of some words\n" if i % 2 else "### ||| $$$ ###\n") * 2000) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = line_crf.fit(docs, labels, CrfParams(max_rows=10))
    got = line_crf.score(docs, model).join(labels, "doc_id").collect()
    assert all(r.predicted == r.quality for r in got)
