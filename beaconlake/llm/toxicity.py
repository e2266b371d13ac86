"""Toxicity by a bidirectional gated recurrent network with attention pooling over word and character inputs.

A text is read as words (runs of ASCII letters, digits and bytes above 127, A-Z in lower case). Each word gives the word
itself and its characters. They come in twice: its first 4 to 10 bytes, where more follow, and its last four are looked up like the word; and its bytes (of a word
over ``CHARS`` bytes the first and the last) run through a learned byte embedding, a convolution of three bytes, and a maximum over the places, which needs no table.
A looked-up input known to the model is a row of a table: its smoothed log-odds in the windows of the training rows, and components that are learned with the network; unknown
ones are zero. The network runs over windows of ``window`` words, each overlapping the next by half; attention pools the states of a window into one
logit. A document's score is that of its worst window, so every word of every text is read twice or more.

``fit`` learns from a bounded sample of labelled rows: at most ``max_toxic`` and ``max_clean`` of them, chosen by a hash of the id among those that have a text. Of a text over
``max_chars`` characters a bounded number of windows is taken on Spark: most of them those with the largest log-odds of their words in the sample, the others by a hash. A toxic text teaches with its window of the largest log-odds, a clean one with that and a random one. Log-odds of
a training row leave its own label out, so a word seen once teaches nothing about the row that it came from.

Defined results: a null or empty text, or one without words, gets the share of toxic rows in the training sample; without training rows of both labels every
score is 0, and ``fit`` warns; rows of one id with several labels count as toxic if one of them does. Scores have five digits, so that they don't depend on what else is in a batch.
"""

from __future__ import annotations

import pickle
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.session import ship_package

from . import bigru
from .chunks import sliced
from .scratch import temporary, written
from .shingles import buffer_of, mixed

SCHEMA = "doc_id long, score double, predicted int"
HEADS = (4, 5, 6, 7, 8, 10)
TAIL = 4
CHARS = 16
INPUTS = ("word", *(f"head{k}" for k in HEADS), "tail")


@dataclass(frozen=True)
class ToxicityParams:
    max_toxic: int = 1000
    max_clean: int = 2000
    max_chars: int = 8000
    hot_words: int = 8192
    window: int = 64
    learned: int = 2
    embedding: int = 4
    filters: int = 8
    hidden: int = 8
    attention: int = 8
    smoothing: float = 2.0
    min_texts: int = 3
    batch: int = 64
    steps: int = 300
    rate: float = 0.02
    seed: int = 5


@dataclass
class ToxicityModel:
    """``keys[i]`` are the sorted hashes of input i's known values; row 0 of ``params['T{i}']`` stands for all others."""

    keys: list[np.ndarray]
    params: bigru.Params
    window: int
    base: float = 0.0


_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, and the number of words of each text."""
    inside = _LETTER[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1][offsets[1:-1] < len(data)]
    begins[cuts] |= inside[cuts]
    ends[cuts[cuts > 0] - 1] |= inside[cuts[cuts > 0] - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets[1:]) - np.searchsorted(start, offsets[:-1])


def word_inputs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (inputs, words) of all words in a buffer of texts, and the number of words of each text.

    A text ends a word; the hash of a word is the sum of its bytes' numbers, each times a power for its place.
    """
    inside = _LETTER[data]
    start, stop, counts = _words(data, offsets)
    if not len(start):
        return np.zeros((len(INPUTS), 0), np.uint64), counts
    length = stop - start
    place = np.arange(len(data)) - np.repeat(start, np.diff(np.append(start, len(data)))) if start[0] == 0 else None
    if place is None:
        place = np.zeros(len(data), np.int64)
        place[start[0] :] = np.arange(start[0], len(data)) - np.repeat(start, np.diff(np.append(start, len(data))))
    powers = np.multiply.accumulate(np.full(int(length.max()) + 1, _STEP))
    terms = _BYTE[data]
    terms *= powers[np.minimum(place, len(powers) - 1)]
    terms[~inside] = 0
    out = np.zeros((len(INPUTS), len(start)), np.uint64)
    out[0] = np.add.reduceat(terms, start)
    last = len(data) - 1
    head = np.zeros(len(start), np.uint64)
    for k in range(max(HEADS)):
        power = powers[min(k, len(powers) - 1)]
        head += np.where(k < length, _BYTE[data[np.minimum(start + k, last)]], np.uint64(0)) * power
        if k + 1 in HEADS:
            out[1 + HEADS.index(k + 1)] = head * (length > k + 1)
        if k < TAIL:
            out[-1] += np.where(k < length, _BYTE[data[np.maximum(stop - 1 - k, 0)]], np.uint64(0)) * power
    return out, counts


def word_bytes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bytes of every word (words, CHARS + 2), A-Z in lower case, with zeros on both sides; of a longer word its first and last ones."""
    start, stop, _ = _words(data, offsets)
    length = (stop - start)[:, None]
    place = np.arange(CHARS)[None, :]
    at = np.where((length > CHARS) & (place >= CHARS // 2), stop[:, None] - CHARS + place, start[:, None] + place)
    out = np.zeros((len(start), CHARS + 2), np.uint8)
    if len(start):
        out[:, 1:-1] = np.where(place < length, _LOWER[data[np.minimum(at, len(data) - 1)]], 0)
    return out


def char_features(chars: np.ndarray, params: bigru.Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, filters) of ``word_bytes``, the place of each maximum, and the embedded bytes by threes."""
    embedded = params["C"][chars] * (chars > 0)[..., None]
    threes = np.concatenate([embedded[:, :-2], embedded[:, 1:-1], embedded[:, 2:]], -1)
    found = np.tanh(threes @ params["K"])
    place = found.argmax(1)
    return np.take_along_axis(found, place[:, None], 1)[:, 0], place, threes


def char_gradients(d: np.ndarray, chars: np.ndarray, out: np.ndarray, place: np.ndarray, threes: np.ndarray, params: bigru.Params) -> bigru.Params:
    """Gradients of the embedding and the convolution from those of ``char_features``."""
    dz = d * (1 - out**2)  # words, filters
    at = np.arange(len(chars))[:, None]
    chosen = threes[at, place]  # words, filters, inputs
    dk = np.einsum("wfi,wf->if", chosen, dz)
    dthree = (dz[..., None] * params["K"].T).reshape(*dz.shape, 3, -1)
    dc = np.zeros_like(params["C"])
    for k in range(3):
        np.add.at(dc, chars[at, place + k].ravel(), dthree[:, :, k].reshape(-1, dc.shape[1]))
    dc[0] = 0
    return {"C": dc, "K": dk}


def rows_of(keys: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """Table rows (inputs, words) of hashed inputs; 0 where unknown."""
    out = np.zeros(hashes.shape, np.int64)
    for i, known in enumerate(keys):
        if len(known):
            at = np.minimum(np.searchsorted(known, hashes[i]), len(known) - 1)
            out[i] = np.where(known[at] == hashes[i], at + 1, 0)
    return out


def _shortened(rows: DataFrame, p: ToxicityParams) -> DataFrame:
    """``label, id, text`` with the long texts cut to windows, about ``max_chars`` characters in all; the others as they are."""
    if not rows.filter(F.length("text") > p.max_chars).limit(1).count():
        return rows

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In how many windows (those of toxic rows, all) and texts a word stands; without a word, how many windows there are."""
        for batch in sliced(batches, rows=256, megabytes=4):
            hashes, counts = word_inputs(*buffer_of(batch.column(1)))
            label = np.asarray(batch.column(0)).astype(np.int64)
            text = np.repeat(np.arange(len(counts)), counts)
            place = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
            order = np.lexsort((place, text, hashes[0]))
            word, text, window = hashes[0][order], text[order], place[order] // p.window
            other = np.ones((2, len(order)), bool)  # another text than the row before, another window
            other[0, 1:] = (word[1:] != word[:-1]) | (text[1:] != text[:-1])
            other[1, 1:] = other[0, 1:] | (window[1:] != window[:-1])
            new, windows = other[1], -(-counts // p.window)
            columns = [
                pa.concat_arrays([pa.array(word[new].view(np.int64)), pa.nulls(len(counts), pa.int64())]), np.concatenate([label[text[new]], label * windows]),
                np.concatenate([np.ones(new.sum(), np.int64), windows]), np.concatenate([other[0][new].astype(np.int64), np.zeros(len(counts), np.int64)]),
            ]
            yield pa.record_batch([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], ["word", "toxic", "n", "texts"])

    sums = [F.sum(c).alias(c) for c in ("toxic", "n", "texts")]
    each = rows.select("label", "text").mapInArrow(counted, "word long, toxic long, n long, texts long").groupBy("word").agg(*sums)
    total = each.filter("word is null").first()
    base = min(max(total["toxic"] / max(total["n"], 1), 1e-6), 1 - 1e-6)
    # a window's share, not a text's, as a long text has most words somewhere
    odds = F.log((F.col("toxic") + p.smoothing * base) / (F.col("n") - F.col("toxic") + p.smoothing * (1 - base))) - float(np.log(base / (1 - base)))
    hot = each.filter(F.col("word").isNotNull() & (F.col("texts") >= p.min_texts)).select("word", odds.alias("odds")).orderBy(F.desc("odds"), "word").limit(p.hot_words).collect()
    order = np.argsort(np.array([r["word"] for r in hot], np.int64).view(np.uint64))
    keys, worth = np.array([r["word"] for r in hot], np.int64).view(np.uint64)[order], np.maximum(np.array([r["odds"] for r in hot], np.float64)[order], 0)
    most = max(2, p.max_chars // (8 * p.window))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, rows=256, megabytes=4):
            long = np.asarray(pc.utf8_length(batch.column(2))) > p.max_chars
            texts = batch.column(2).to_pylist()
            for i in np.flatnonzero(long):
                data = np.frombuffer(texts[i].encode(), np.uint8)
                offsets = np.array([0, len(data)])
                start, stop, _ = _words(data, offsets)
                firsts = np.arange(0, len(start), p.window)
                if not len(firsts):
                    texts[i] = ""
                    continue
                hashes = word_inputs(data, offsets)[0][0]
                at = np.minimum(np.searchsorted(keys, hashes), max(0, len(keys) - 1))
                value = np.where(keys[at] == hashes, worth[at], 0) if len(keys) else np.zeros(len(hashes))
                sums = np.add.reduceat(value**2, firsts)
                best = np.argsort(-sums, kind="stable")[: most - most // 4]
                rest = np.setdiff1d(np.arange(len(firsts)), best)
                chosen = np.sort(np.concatenate([best, rest[np.argsort(mixed(rest.astype(np.uint64)), kind="stable")[: most // 4]]]))
                lasts = np.minimum(firsts + p.window, len(start)) - 1
                texts[i] = "\n".join(data[start[firsts[c]] : stop[lasts[c]]].tobytes().decode("utf-8", "replace") for c in chosen)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["label", "id", "text"])

    return rows.select("label", "id", "text").mapInArrow(cut, "label int, id long, text string")


def _chosen(docs: DataFrame, labels: DataFrame, p: ToxicityParams, paths: list[str], doc_id: str, text: str, label: str) -> DataFrame:
    """``label, id, text`` of the training rows, toxic ones first, in the order of a hash: one sorted partition. Only the chosen ids are broadcast; long texts are in windows."""
    marked = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("label")).filter("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    named = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).filter("id is not null and text is not null")
    order = [F.xxhash64("id", F.lit("sample")), F.col("id")]
    there = written(marked.join(named.select("id").distinct(), "id", "left_semi"), "labelled", paths)
    chosen = there.filter("label = 1").orderBy(*order).limit(p.max_toxic).unionByName(there.filter("label = 0").orderBy(*order).limit(p.max_clean))
    # an id that is repeated gives as many rows as it has texts; the bound holds for the rows of each label
    rows = written(named.join(F.broadcast(chosen), "id").select("label", "id", "text").dropDuplicates(), "sample", paths)
    short = written(_shortened(rows, p), "shortened", paths)
    toxic, clean = (short.filter(F.col("label") == y).orderBy(*order, "text").limit(most) for y, most in ((1, p.max_toxic), (0, p.max_clean)))
    return toxic.unionByName(clean).coalesce(1).sortWithinPartitions(F.desc("label"), *order, "text")


def sample(docs: DataFrame, labels: DataFrame, p: ToxicityParams, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> list[tuple[int, str]]:
    """(label, text) of the training rows, in the driver."""
    with temporary(docs.sparkSession) as paths:
        return [(int(r["label"]), r["text"]) for r in _chosen(docs, labels, p, paths, doc_id, text, label).collect()]


def train(rows: list[tuple[int, str]], p: ToxicityParams) -> ToxicityModel:
    rng = np.random.default_rng(p.seed)
    label = np.array([y for y, _ in rows], np.int64)
    width = 1 + p.learned
    params = bigru.init_recurrent(rng, p.hidden)
    inputs = len(INPUTS) * width + p.filters
    params["C"] = (rng.standard_normal((256, p.embedding)) / 2).astype(np.float32)
    params["K"] = (rng.standard_normal((3 * p.embedding, p.filters)) / np.sqrt(3 * p.embedding)).astype(np.float32)
    params["W"] = (rng.standard_normal((2, 3, inputs, p.hidden)) / np.sqrt(inputs)).astype(np.float32)
    params["b"] = np.zeros((2, 3, 1, p.hidden), np.float32)
    params["A"] = (rng.standard_normal((2 * p.hidden, p.attention)) / 4).astype(np.float32)
    params["a"] = np.zeros(p.attention, np.float32) + rng.standard_normal(p.attention).astype(np.float32) / 3
    params["V"] = (rng.standard_normal(2 * p.hidden) / 4).astype(np.float32)
    params["c"] = np.zeros(1, np.float32)
    if len(label) == 0 or label.min() == label.max():
        warnings.warn("no training rows of both labels: every toxicity score is 0", stacklevel=2)
        return ToxicityModel([], params, p.window)

    parts, chars = [], []
    for first in range(0, len(rows), 128):  # the inputs of a few texts at a time, as they take many times the texts' size
        texts = [t.encode("utf-8", "replace") for _, t in rows[first : first + 128]]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        data = np.frombuffer(b"".join(texts), np.uint8)
        parts.append(word_inputs(data, offsets))
        chars.append(word_bytes(data, offsets))
    chars = np.concatenate([*chars, np.zeros((1, CHARS + 2), np.uint8)])  # the last row stands for no word
    counts = np.concatenate([c for _, c in parts])
    owner = np.repeat(np.arange(len(rows)), counts)
    window = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) // p.window
    windows = -(-counts // p.window)
    stride, share = int(windows.max(initial=0)) + 1, label.mean()
    base = float(np.clip((windows * label).sum() / max(windows.sum(), 1), 1e-6, 1 - 1e-6))
    keys = []
    at = np.zeros((len(INPUTS), len(owner)), np.int32)  # table rows
    odds = np.zeros((len(INPUTS), len(owner)), np.float32)
    for i in range(len(INPUTS)):
        values, inverse = np.unique(np.concatenate([h[i] for h, _ in parts]), return_inverse=True)
        found = np.unique((inverse.astype(np.int64) * len(rows) + owner) * stride + window)  # each window counts once
        pairs, times = np.unique(found // stride, return_counts=True)
        value, text = pairs // len(rows), pairs % len(rows)
        texts = np.bincount(value, minlength=len(values))
        seen = np.bincount(value, weights=times, minlength=len(values))
        toxic = np.bincount(value, weights=times * label[text], minlength=len(values))

        def log_odds(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
            return np.log((toxic + p.smoothing * base) / (clean + p.smoothing * (1 - base))) - np.log(base / (1 - base))

        known = (texts >= p.min_texts) & (values != 0)
        place = np.cumsum(known) * known  # row of a value, 0 if it isn't known
        keys.append(values[known])
        learned = (0.05 * rng.standard_normal((known.sum() + 1, p.learned))).astype(np.float32)
        learned[0] = 0
        own = np.concatenate([[0], log_odds(toxic, seen - toxic)[known]]).astype(np.float32)
        params[f"T{i}"] = np.concatenate([own[:, None], learned], 1)
        y = label[owner]
        own_times = times[np.searchsorted(pairs, inverse.astype(np.int64) * len(rows) + owner)]  # a row's own windows are left out
        without = log_odds(toxic[inverse] - own_times * y, seen[inverse] - toxic[inverse] - own_times * (1 - y)) * (texts[inverse] > 1)
        odds[i] = np.where(known[inverse], without, 0.0)
        at[i] = place[inverse]
    del parts
    hot = np.maximum(odds, 0).mean(0) ** 2  # few words that most inputs find toxic outweigh many doubtful ones
    starts = np.concatenate([[0], np.cumsum(counts)])
    worst = np.zeros(len(rows), np.int64)  # first word of the window with the largest log-odds
    for r in range(len(rows)):
        n = counts[r]
        if n > p.window:
            sums = np.concatenate([[0.0], np.cumsum(hot[starts[r] : starts[r + 1]])])
            worst[r] = int((sums[p.window :] - sums[: -p.window]).argmax())
    positive, negative = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    fixed = {k: params[k] for k in params if k[0] != "T"} | {f"L{i}": params[f"T{i}"][:, 1:].copy() for i in range(len(INPUTS))}
    adam = bigru.Adam(fixed, p.rate)
    p_ = adam.params
    for step in range(p.steps):
        half = p.batch // 2
        chosen = np.concatenate([rng.choice(positive, half), rng.choice(negative, p.batch - half)])
        y = label[chosen].astype(np.float32)
        place = np.full((p.window, p.batch), -1)
        for b, r in enumerate(chosen):
            n = min(p.window, counts[r])
            hard = b < half or b % 2
            skip = worst[r] if hard else rng.integers(max(1, counts[r] - p.window + 1))
            # the window's frame moves by up to its half, as it does when whole texts are read
            place[:n, b] = starts[r] + skip + np.arange(n)
        real = place >= 0
        at_b = np.where(real, at[:, place], 0)  # inputs, steps, batch
        odds_b = np.where(real, odds[:, place], 0).astype(np.float32)
        grads = gradients(p_, odds_b, at_b, chars[place], real, y)[1]
        adam.rate = p.rate * (1 - 0.9 * step / p.steps)
        adam.update(grads)
    for i in range(len(INPUTS)):
        params[f"T{i}"][:, 1:] = p_.pop(f"L{i}")
    params.update(p_)
    return ToxicityModel(keys, params, p.window, float(share))


def gradients(params: bigru.Params, odds: np.ndarray, at: np.ndarray, chars: np.ndarray, real: np.ndarray, y: np.ndarray) -> tuple[float, bigru.Params]:
    """Mean cross-entropy of a batch of windows and the gradient of every parameter.

    ``odds`` and ``at`` (table rows) have the axes inputs, steps, batch; ``chars`` steps, batch, bytes; ``real`` says where words are.
    """
    learned, n = params["L0"].shape[1], len(odds)
    width, shape = 1 + learned, real.shape
    by_char, place, threes = char_features(chars.reshape(-1, chars.shape[-1]), params)
    features = np.concatenate([x for i in range(n) for x in (odds[i][..., None], params[f"L{i}"][at[i]])] + [by_char.reshape(*shape, -1)], -1)
    both = np.stack([features, features[::-1]], 1)  # steps, direction, batch, inputs
    x = both[:, :, None] @ params["W"][None] + params["b"][None]
    h, kept = bigru.forward(x, params)
    states = bigru.both_ways(h)
    u = np.tanh(states @ params["A"])
    e = np.where(real, u @ params["a"], -1e9)
    w = np.exp(e - e.max(0))
    w *= real
    w /= np.maximum(w.sum(0), 1e-9)
    pooled = (w[..., None] * states).sum(0)
    logit = pooled @ params["V"] + params["c"]
    loss = float((np.logaddexp(0, logit) - y * logit).mean())
    d = ((0.5 * np.tanh(0.5 * logit) + 0.5) - y) / len(y)
    grads = {"V": pooled.T @ d, "c": d.sum(keepdims=True)}
    dp = d[:, None] * params["V"]
    dstates = w[..., None] * dp
    dw = (states * dp).sum(-1)
    de = w * (dw - (w * dw).sum(0))
    du = de[..., None] * params["a"] * (1 - u**2)
    grads["a"] = (u * de[..., None]).sum((0, 1))
    grads["A"] = states.reshape(-1, states.shape[-1]).T @ du.reshape(-1, du.shape[-1])
    dstates += du @ params["A"].T
    dx, recurrent = bigru.backward(bigru.split_ways(dstates.astype(features.dtype)), h, kept, params)
    grads["b"] = dx.sum((0, 3))[:, :, None]
    inputs, hidden = both.shape[-1], dx.shape[-1]
    flat_x = both.transpose(1, 3, 0, 2).reshape(2, inputs, -1)
    grads["W"] = np.stack([flat_x @ dx[:, :, g].transpose(1, 0, 2, 3).reshape(2, -1, hidden) for g in range(3)], 1)
    dfeat = sum((dx[:, :, g] @ params["W"][:, g].transpose(0, 2, 1)) for g in range(3))
    dfeat = dfeat[:, 0] + dfeat[::-1, 1]
    for i in range(n):
        g = np.zeros_like(params[f"L{i}"])
        np.add.at(g, at[i].ravel(), dfeat[..., i * width + 1 : (i + 1) * width].reshape(-1, learned))
        g[0] = 0
        grads[f"L{i}"] = g
    by_bytes = char_gradients(dfeat[..., n * width :].reshape(by_char.shape), chars.reshape(-1, chars.shape[-1]), by_char, place, threes, params)
    return loss, grads | recurrent | by_bytes


def _trained(batches: Iterator[pa.RecordBatch], p: ToxicityParams) -> Iterator[pa.RecordBatch]:
    """The model of all rows, pickled."""
    rows = [(int(y), x) for batch in batches for y, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # the driver warns
        yield pa.record_batch([pa.array([pickle.dumps(train(rows, p))], pa.binary())], ["model"])


def fit(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams(), doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """The model is trained in a task, whose work is bounded by the sample, so that the driver gets the model alone: neither texts nor the arrays that training takes."""
    ship_package(docs.sparkSession)
    with temporary(docs.sparkSession) as paths:
        rows = _chosen(docs, labels, p, paths, doc_id, text, label).select("label", "text")
        found = rows.mapInArrow(lambda batches: _trained(batches, p), "model binary").collect()
    model = pickle.loads(found[0]["model"]) if found else train([], p)
    if found and not model.keys:
        warnings.warn("no training rows of both labels: every toxicity score is 0", stacklevel=2)
    return model


class Scorer:
    """Worst-window scores of texts, given as one buffer of bytes with offsets."""

    BATCH = 256

    def __init__(self, model: ToxicityModel):
        self.model, p = model, model.params
        self.w, self.b = p["W"].copy(), p["b"].copy()
        self.w[:, :2] *= 0.5
        self.b[:, :2] *= 0.5
        self.runner = bigru.Runner(p, model.window, self.BATCH)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        model, p = self.model, self.model.params
        if not model.keys:
            return np.zeros(len(offsets) - 1)
        hashes, counts = word_inputs(data, offsets)
        rows = rows_of(model.keys, hashes)
        _, first_of, word_of = np.unique(hashes[0], return_index=True, return_inverse=True)  # each distinct word's bytes once
        by_char = char_features(word_bytes(data, offsets)[first_of], p)[0][word_of]
        features = np.concatenate([*[p[f"T{i}"][rows[i]] for i in range(len(INPUTS))], by_char], 1) if rows.shape[1] else np.zeros((0, self.w.shape[2]), np.float32)
        features = np.concatenate([features, np.zeros((1, features.shape[1]), np.float32)])  # the last row stands for no word
        none = len(features) - 1
        tables = np.stack([np.stack([features @ self.w[way, gate] + self.b[way, gate] for gate in range(3)]) for way in (0, 1)])

        size, stride = model.window, model.window // 2
        windows = np.where(counts > size, -(-(counts - size) // stride) + 1, 1)
        owner = np.repeat(np.arange(len(counts)), windows)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        begin = np.concatenate([[0], np.cumsum(counts)])
        first = begin[owner] + np.minimum(nth * stride, np.maximum(counts[owner] - size, 0))
        steps = np.arange(size)[:, None]
        out = np.full(len(counts), -np.inf)
        for start in range(0, len(owner), self.BATCH):
            some = slice(start, start + self.BATCH)
            n = len(owner[some])
            place = np.full((size, self.BATCH), none)
            inside = np.zeros((size, self.BATCH), bool)
            inside[:, :n] = steps < counts[owner[some]][None, :]
            np.copyto(place[:, :n], first[some][None, :] + steps, where=inside[:, :n])
            states = bigru.both_ways(self.runner.run(tables, place))
            e = np.where(inside, np.tanh(states @ p["A"]) @ p["a"], -1e9)
            weight = np.exp(e - e.max(0)) * inside
            weight /= np.maximum(weight.sum(0), 1e-9)
            logit = (weight * (states @ p["V"])).sum(0) + p["c"][0]
            np.maximum.at(out, owner[some], logit[:n])
        return np.round(np.where(counts > 0, 1 / (1 + np.exp(-np.clip(out, -30, 30))), model.base), 5)


def score(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every row."""
    return _scored(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), model, SCHEMA, "text", keep=["doc_id"])


def keep_clean(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, all columns as they are."""
    return _scored(docs, model, docs.schema, text, keep=docs.columns, only_clean=True)


def _scored(docs: DataFrame, model: ToxicityModel, schema, text: str, keep: list[str], only_clean: bool = False) -> DataFrame:
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the training sample
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in sliced(batches, rows=512):
            column = batch.column(names.index(text)).cast(pa.large_binary()).fill_null(b"")
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            raw = column.buffers()[2]
            data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
            values = scorer.scores(data[offsets[0] : offsets[-1]], offsets - offsets[0])
            if only_clean:
                yield batch.filter(pa.array(values < 0.5))
            else:
                kept = [batch.column(names.index(c)) for c in keep]
                yield pa.record_batch([*kept, pa.array(values, pa.float64()), pa.array((values >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    return docs.mapInArrow(run, schema)
