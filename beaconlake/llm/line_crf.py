"""Document quality by a linear-chain conditional random field over lines.

Every line of a text is described by ``BASE`` measures of its characters, words and repetitions; a place of the chain sees those of its own line, by ranges, and those of the lines
before and after it. Two labels, bad and good, with learned transitions; forward-backward gives each line's probability of being good,
and their mean, weighted by the lines' characters, is the document's score.

Products of 2x2 matrices are associative, so forward and backward messages are prefix products: all chains of a batch run together in as many
numpy steps as the logarithm of the longest chain, and a text of a million lines costs no loop over lines.

``fit`` learns from a bounded sample of labelled rows: at most ``max_rows`` of each label, the first by a hash of the id among those that have a text, and of each at most
``max_segments`` segments of ``segment`` lines, chosen by hash. Features are made on Spark, and only those come to the driver. A line first has its document's label; after ``warm_steps`` the lines
of bad documents that the model finds good, all but the worst ones of each segment, become good, since a bad document has good lines too.

Defined results: a null text is an empty one, an empty text is one empty line, and a line counts one character more than it has, so that empty lines have a say; without training rows of both
labels every score is the share of good ones (1 if there are none); rows of one id with several labels count as bad if one of them does; of an id's several rows every one is used. Scores have five digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.session import ship_package

from . import bigru
from .chunks import sliced
from .shingles import buffer_of, mixed, word_hashes

SCHEMA = "doc_id long, score double, predicted int"
BASE = (
    "log_chars", "log_words", "lower", "upper", "digits", "white", "stops", "symbols", "marks", "word_length", "short_words", "long_words", "distinct_words", "doubled_words", "capital_words", "odd_words",
    "repeats_line", "empty", "log_doc_lines", "doc_distinct_words",
)


@dataclass(frozen=True)
class CrfParams:
    max_rows: int = 1500
    segment: int = 64
    max_segments: int = 2
    bins: int = 8
    warm_steps: int = 80
    steps: int = 160
    rate: float = 0.05
    decay: float = 1e-4
    share_bad: float = 0.5
    threshold: float = 0.3


@dataclass
class CrfModel:
    """``cuts`` (features, bins - 1) are the ranges' ends; ``mean`` and ``spread`` those of the measures; ``params`` None where nothing could be learned."""

    cuts: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    params: bigru.Params | None
    base: float = 1.0


def _classes() -> np.ndarray:
    """Kinds of bytes as rows: lower, upper, digits, white space, ends of sentences, symbols, exclamation marks, begins of characters."""
    kinds = np.zeros((8, 256), bool)
    for row, some in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c\n", b".,;:?", b"#*$%&|<>[]{}=+/\\^~_@", b"!")):
        kinds[row, list(some)] = True
    kinds[7] = True
    kinds[7, 128:192] = False
    return kinds


_KINDS = _classes()
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\r\x0b\x0c\n")] = True


def _before(count: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(count)])


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures (lines, BASE), characters of each line, and the number of lines of each text, for a buffer of texts."""
    texts = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    of_text = np.searchsorted(offsets, breaks, "right") - 1
    lines = np.bincount(of_text, minlength=texts).astype(np.int64) + 1
    first = np.cumsum(lines) - lines
    start, stop = np.empty(int(lines.sum()), np.int64), np.empty(int(lines.sum()), np.int64)
    place = np.arange(len(breaks)) + of_text  # of the line that a break ends
    start[first], stop[first + lines - 1] = offsets[:-1], offsets[1:]
    stop[place], start[place + 1] = breaks, breaks + 1
    text = np.repeat(np.arange(texts), lines)

    def within(flags: np.ndarray) -> np.ndarray:
        sums = _before(flags)
        return (sums[stop] - sums[start]).astype(np.float64)

    chars, shares = within(_KINDS[7][data]), [within(_KINDS[k][data]) for k in range(7)]
    inside = ~_BLANK[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[1:-1][offsets[1:-1] < len(data)]
    begins[cuts] = inside[cuts]
    at = np.flatnonzero(begins)
    hashes, _ = word_hashes(data, offsets)  # words end at white space and where texts do, so there is one for each begin
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[cuts[cuts > 0] - 1] = inside[cuts[cuts > 0] - 1]
    letters = _before(_KINDS[0][data] | _KINDS[1][data] | (data >= 128))
    until = np.flatnonzero(ends) + 1
    characters = _before(_KINDS[7][data])
    length = characters[until] - characters[at]
    line = np.searchsorted(start, at, "right") - 1
    words = np.bincount(line, minlength=len(start)).astype(np.float64)

    def of_words(flags: np.ndarray) -> np.ndarray:
        return np.bincount(line, flags, len(start)) / np.maximum(words, 1)

    def distinct(group: np.ndarray, groups: int) -> np.ndarray:
        order = np.lexsort((hashes, group))
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (group[order][1:] != group[order][:-1])
        return np.bincount(group[order], new, groups)

    same = np.zeros(len(at), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    repeats = _repeats(hashes, line, words, text)
    doc_words = np.bincount(text[line], minlength=texts)
    doc_distinct = np.where(doc_words > 0, distinct(text[line], texts) / np.maximum(doc_words, 1), 1.0)
    per = 1 / np.maximum(chars, 1)
    columns = [
        np.log1p(chars), np.log1p(words), *[x * per for x in shares], np.bincount(line, length, len(start)) / np.maximum(words, 1), of_words(length <= 3), of_words(length >= 13),
        np.where(words > 0, distinct(line, len(start)) / np.maximum(words, 1), 1.0), of_words(same), of_words(_KINDS[1][data[at]]), of_words(letters[until] == letters[at]),
        repeats, words == 0, np.log1p(lines)[text], doc_distinct[text],
    ]
    return np.stack(columns, 1).astype(np.float32), chars, lines


def _repeats(hashes: np.ndarray, line: np.ndarray, words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """1 for lines whose words an earlier line of the text has in the same order."""
    step = np.multiply.accumulate(np.full(int(words.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
    place = np.arange(len(line)) - np.repeat(_before(words.astype(np.int64))[:-1], words.astype(np.int64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * step[place], dtype=np.uint64)])
    ends = _before(words.astype(np.int64))
    key = mixed(sums[ends[1:]] - sums[ends[:-1]])
    order = np.lexsort((np.arange(len(key)), key, text))
    again = np.zeros(len(key), bool)
    again[order[1:]] = (key[order][1:] == key[order][:-1]) & (text[order][1:] == text[order][:-1])
    return again & (words > 0)


def with_neighbours(base: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Each line's measures beside those of the lines before and after it in its text (lines, 3 BASE); at a text's ends its own."""
    first = np.cumsum(lines) - lines
    before, after = np.arange(len(base)) - 1, np.arange(len(base)) + 1
    before[first], after[first + lines - 1] = first, first + lines - 1
    return np.concatenate([base, base[before], base[after]], 1)


def inputs(three: np.ndarray, model: CrfModel) -> np.ndarray:
    """What the chain sees: the own measures by ranges, their standing, that of the neighbours', and how far these are from the own ones."""
    k = len(BASE)
    ranges = (three[:, :k, None] > model.cuts[None]).astype(np.float32)  # every end that is passed counts
    z = np.clip((three.reshape(len(three), 3, k) - model.mean) / model.spread, -3, 3).astype(np.float32)
    return np.concatenate([ranges.reshape(len(three), -1), z.reshape(len(three), -1), np.abs(z[:, 1] - z[:, 0]), np.abs(z[:, 2] - z[:, 0]), np.ones((len(three), 1), np.float32)], 1)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of many 2x2 matrices, scaled to a largest element of 1."""
    out = a[:, :, :1] * b[:, :1] + a[:, :, 1:] * b[:, 1:]
    return out / np.maximum(np.maximum(out[:, 0, 0], out[:, 0, 1]), np.maximum(out[:, 1, 0], out[:, 1, 1]))[:, None, None]


def _chained(m: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Products of each chain's matrices up to every place, each up to a factor; ``first`` is the place where a place's chain begins."""
    m, here, step = m.copy(), np.arange(len(m)), 1
    reach = int((here - first).max(initial=0))
    while step <= reach:
        at = np.flatnonzero(here - step >= first)
        m[at] = _product(m[at - step], m[at])
        step *= 2
    return m


def messages(emission: np.ndarray, lines: np.ndarray, params: bigru.Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward messages (places, 2), and the step matrices; ``emission`` is what speaks for good over bad at each place."""
    begin = np.repeat(np.cumsum(lines) - lines, lines)
    here = np.arange(len(emission))
    half = 0.5 * np.clip(emission.astype(np.float64), -60, 60)
    steps = np.exp(params["T"].astype(np.float64))[None] * np.exp(np.stack([-half, half], 1))[:, None, :]
    steps[begin == here] = (np.exp(params["B"].astype(np.float64)) * np.exp(np.stack([-half, half], 1)[begin == here]))[:, None, :] * 0.5  # a chain's first step comes from nowhere
    steps /= steps.max((1, 2), keepdims=True)
    forward = _chained(steps, begin).sum(1)
    # backward: the same products from the other end, with every matrix turned
    last = np.repeat(np.cumsum(lines) - 1, lines)
    turned = steps.transpose(0, 2, 1)[::-1]
    back = _chained(turned, (len(emission) - 1 - last)[::-1])[::-1].sum(1)  # of the steps from each place to its chain's end
    after = np.ones((len(emission), 2))
    after[here < last] = back[np.flatnonzero(here < last) + 1]
    forward /= forward.sum(1, keepdims=True)
    after /= after.sum(1, keepdims=True)
    return forward, after, steps


def marginals(emission: np.ndarray, lines: np.ndarray, params: bigru.Params) -> np.ndarray:
    """The probability of good at every place."""
    if not len(emission):
        return np.zeros(0)
    forward, after, _ = messages(emission, lines, params)
    both = forward * after
    return both[:, 1] / both.sum(1)


def gradients(x: np.ndarray, label: np.ndarray, lines: np.ndarray, params: bigru.Params) -> bigru.Params:
    """Of the mean negative log-likelihood a place: expected less observed features."""
    forward, after, steps = messages(x @ params["w"], lines, params)
    both = forward * after
    good = both[:, 1] / both.sum(1)
    starts = np.zeros(len(label), bool)
    starts[np.cumsum(lines) - lines] = True
    inner = np.flatnonzero(~starts)
    pair = forward[inner - 1][:, :, None] * steps[inner] * after[inner][:, None, :]
    pair /= pair.sum((1, 2), keepdims=True)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[inner - 1], label[inner]), 1)
    begun = np.bincount(label[starts], minlength=2)
    expected = np.array([(1 - good[starts]).sum(), good[starts].sum()])
    return {"w": x.T @ ((good - label) / len(label)).astype(x.dtype), "T": ((pair.sum(0) - seen) / len(label)).astype(np.float32), "B": ((expected - begun) / len(label)).astype(np.float32)}


def sample(docs: DataFrame, labels: DataFrame, p: CrfParams, doc_id: str, text: str, label: str) -> list:
    """(label, lines, features) of the training segments. Only the chosen ids are broadcast."""
    known = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    marked = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).filter("id is not null and label in (0, 1)").groupBy("id").agg(F.min("label").alias("label"))
    there = marked.join(known.select("id").distinct(), "id", "left_semi")
    order = [F.xxhash64("id", F.lit("lines")), F.col("id")]
    chosen = there.filter("label = 1").orderBy(*order).limit(p.max_rows).unionByName(there.filter("label = 0").orderBy(*order).limit(p.max_rows))
    rows = known.join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, rows=256, megabytes=4):
            base, _, lines = line_features(*buffer_of(batch.column(2)))
            three = with_neighbours(base, lines)
            first = np.cumsum(lines) - lines
            ids, out = batch.column(0).to_pylist(), []
            for i, (a, n) in enumerate(zip(first.tolist(), lines.tolist(), strict=True)):
                cuts = np.arange(0, n, p.segment)
                order = np.argsort(mixed(cuts.astype(np.uint64) ^ np.uint64(ids[i] & 0xFFFFFFFF)), kind="stable")[: p.max_segments]
                out += [(batch.column(1)[i].as_py(), ids[i], int(c), three[a + c : a + min(c + p.segment, n)].astype("<f4").tobytes()) for c in cuts[np.sort(order)]]
            yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["label", "id", "line", "features"])

    found = rows.select(F.col("id").cast("long").alias("id"), "label", "text").mapInArrow(run, "label int, id long, line long, features binary")
    return found.orderBy("id", "line", "features").limit(2 * p.max_rows * p.max_segments).collect()


def train(rows: list, p: CrfParams) -> CrfModel:
    """The model of segments (``label``, ``features``)."""
    label = np.array([r["label"] for r in rows], np.int64)
    if not len(label) or label.min() == label.max():
        return CrfModel(np.zeros((len(BASE), 0)), np.zeros(len(BASE)), np.ones(len(BASE)), None, float(label.mean()) if len(label) else 1.0)
    parts = [np.frombuffer(r["features"], "<f4").reshape(-1, 3 * len(BASE)) for r in rows]
    lines = np.array([len(x) for x in parts], np.int64)
    three = np.concatenate(parts)
    own = three[:, : len(BASE)]
    cuts = np.quantile(own, np.arange(1, p.bins) / p.bins, axis=0).T.astype(np.float32)
    model = CrfModel(cuts, own.mean(0), own.std(0) + 1e-3, None)
    x = inputs(three, model)
    params = {"w": np.zeros(x.shape[1], np.float32), "T": np.zeros((2, 2), np.float32), "B": np.zeros(2, np.float32)}
    place, first = np.repeat(label, lines), np.cumsum(lines) - lines
    chain = np.repeat(np.arange(len(lines)), lines)
    now, adam = place, bigru.Adam(params, p.rate)
    for step in range(p.steps):
        if step >= p.warm_steps and step % 40 == 0:
            good = marginals(x @ params["w"], lines, params)
            order = np.lexsort((good, chain))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order)) - np.repeat(first, lines)
            now = np.where((place == 0) & (good > 0.5) & (rank >= np.ceil(p.share_bad * lines)[chain]), 1, place)
        grads = gradients(x, now, lines, params)
        grads = {k: g + p.decay * params[k] for k, g in grads.items()}
        adam.update(grads)
    model.params, model.base = params, float(label.mean())
    return model


def fit(docs: DataFrame, labels: DataFrame, p: CrfParams = CrfParams(), doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> CrfModel:
    """A model of the documents' labels (0 or 1) in ``labels``; other labels are left out."""
    ship_package(docs.sparkSession)
    return train(sample(docs, labels, p, doc_id, text, label), p)


def scores(data: np.ndarray, offsets: np.ndarray, model: CrfModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's score, each line's probability of being good, and the number of lines of each text."""
    base, chars, lines = line_features(data, offsets)
    if model.params is None:
        good = np.full(len(base), model.base)
    else:
        good = np.concatenate([np.zeros(0), *(marginals(inputs(t, model) @ model.params["w"], n, model.params) for t, n in _portions(with_neighbours(base, lines), lines))])
    weight = chars + 1
    text = np.repeat(np.arange(len(lines)), lines)
    return np.bincount(text, weight * good, len(lines)) / np.bincount(text, weight, len(lines)), good, lines


def _portions(three: np.ndarray, lines: np.ndarray, most: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole chains, about ``most`` places at a time."""
    ends = np.cumsum(lines)
    low = 0
    while low < len(lines):
        done = ends[low] - lines[low]
        high = max(low + 1, int(np.searchsorted(ends, done + most, "right")))
        yield three[done : ends[high - 1]], lines[low:high]
        low = high


def score(docs: DataFrame, model: CrfModel, p: CrfParams = CrfParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns of SCHEMA for every row; ``predicted`` is 1 from ``threshold`` on."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, rows=1024, megabytes=4):
            found = np.round(scores(*buffer_of(batch.column(1)), shared.value)[0], 5)
            yield pa.record_batch([batch.column(0), pa.array(found), pa.array((found >= p.threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


def label_lines(docs: DataFrame, model: CrfModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, line_no, good`` for every line of every row: its probability of being good; lines are numbered from 0."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, rows=1024, megabytes=4):
            _, good, lines = scores(*buffer_of(batch.column(1)), shared.value)
            row = np.repeat(np.arange(len(lines)), lines)
            number = np.arange(len(row)) - np.repeat(np.cumsum(lines) - lines, lines)
            yield pa.record_batch([batch.column(0).take(pa.array(row)), pa.array(number), pa.array(np.round(good, 5))], ["doc_id", "line_no", "good"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, line_no long, good double")
