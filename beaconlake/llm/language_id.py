"""Language identification by a bidirectional gated recurrent network over bytes.

``fit`` trains on a bounded sample of labelled rows: at most ``per_language`` rows of each language, or an equal share of ``max_rows`` where there are many (of
up to ``max_languages``, the most frequent), chosen by a hash of the id, and of each at most ``sample_chars`` characters from a place that the hash picks.
Every byte position of a window carries the label of its text. ``predict`` reads whole texts: they are cut into windows of ``window``
bytes, every position is labelled, and a document's probabilities are the mean over all its positions.

Defined results: ``und`` with score 0 for a null text, a text without a letter, or a model without languages; equal texts get equal results; the
label, the source and the id are never read for a prediction. Scores have five digits, so that they don't depend on what else is in a batch.
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

PAD = 256
UNKNOWN = "und"
SCHEMA = "doc_id long, lang_pred string, score double"


@dataclass(frozen=True)
class LanguageParams:
    per_language: int = 400
    max_rows: int = 12_800
    max_languages: int = 1024
    sample_chars: int = 1024
    hidden: int = 8
    window: int = 128
    train_window: int = 48
    batch: int = 96
    steps: int = 260
    rate: float = 0.02
    seed: int = 11


@dataclass
class LanguageModel:
    languages: list[str]
    params: bigru.Params
    window: int


def sample(docs: DataFrame, p: LanguageParams, doc_id: str, text: str, lang: str) -> list[tuple[str, str]]:
    """(language, text) of the training rows; the driver gets at most about twice ``max_rows``."""
    named = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter(F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = named.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(p.max_languages).collect()
    if not counts:
        return []
    most = max(1, min(p.per_language, p.max_rows // len(counts)))
    share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for row in counts for x in (row["lang"], min(1.0, 1.5 * most / row["count"]))]), F.col("lang")), F.lit(0.0))
    dealt = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) / (1 << 20)
    chosen = named.filter(dealt < share)
    place = F.pmod(F.xxhash64("id", F.lit("place")), F.greatest(F.length("text") - p.sample_chars, F.lit(1))) + 1
    cut = chosen.select("id", "lang", F.substring("text", place.cast("int"), F.lit(p.sample_chars)).alias("text"))
    rows = cut.orderBy(F.xxhash64("id"), "id", "lang", "text").limit(2 * most * len(counts)).collect()
    kept: dict[str, int] = {}
    out = []
    for row in rows:
        kept[row["lang"]] = kept.get(row["lang"], 0) + 1
        if kept[row["lang"]] <= most:
            out.append((row["lang"], row["text"]))
    return out


def train(rows: list[tuple[str, str]], p: LanguageParams) -> LanguageModel:
    """Fit the network by backpropagation through time on random windows, each language alike."""
    languages = sorted({lang for lang, _ in rows})
    rng = np.random.default_rng(p.seed)
    params = bigru.init_recurrent(rng, p.hidden)
    params["E"] = (0.3 * rng.standard_normal((2, 3, PAD + 1, p.hidden))).astype(np.float32)
    params["V"] = (0.3 * rng.standard_normal((2 * p.hidden, len(languages)))).astype(np.float32)
    params["c"] = np.zeros(len(languages), np.float32)
    model = LanguageModel(languages, params, p.window)
    if len(languages) < 2:
        return model
    by = [[np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for lang, t in rows if lang == name] for name in languages]
    adam = bigru.Adam(params, p.rate)
    for step in range(p.steps):
        labels = rng.integers(0, len(languages), p.batch)
        symbols = np.full((p.train_window, p.batch), PAD)
        for b, label in enumerate(labels):
            data = by[label][rng.integers(len(by[label]))]
            at = rng.integers(max(1, len(data) - p.train_window + 1))
            part = data[at : at + p.train_window]
            symbols[: len(part), b] = part
        adam.rate = p.rate * (1 - 0.9 * step / p.steps)
        adam.update(gradients(params, symbols, labels)[1])
    return model


def gradients(params: bigru.Params, symbols: np.ndarray, labels: np.ndarray) -> tuple[float, bigru.Params]:
    """Mean cross-entropy over all real positions of a batch (steps, batch), and the gradient of every parameter."""
    both = np.stack([symbols, symbols[::-1]], 1)  # steps, direction, batch
    x = np.stack([params["E"][way][:, both[:, way]] for way in (0, 1)], 0).transpose(2, 0, 1, 3, 4)
    h, kept = bigru.forward(x, params)
    states = bigru.both_ways(h)
    logits = states @ params["V"] + params["c"]
    prob = np.exp(logits - logits.max(-1, keepdims=True))
    prob /= prob.sum(-1, keepdims=True)
    columns, real = np.arange(symbols.shape[1]), symbols != PAD
    share = (real / max(1, real.sum())).astype(prob.dtype)
    loss = float(-(np.log(prob[:, columns, labels]) * share).sum())
    d = prob
    d[:, columns, labels] -= 1
    d *= share[..., None]
    grads = {"V": states.reshape(-1, states.shape[-1]).T @ d.reshape(-1, d.shape[-1]), "c": d.sum((0, 1))}
    dx, recurrent = bigru.backward(bigru.split_ways(d @ params["V"].T), h, kept, params)
    de = np.zeros_like(params["E"])
    for way in (0, 1):
        for gate in range(3):
            np.add.at(de[way, gate], both[:, way].ravel(), dx[:, way, gate].reshape(-1, de.shape[-1]))
    return loss, grads | recurrent | {"E": de}


def fit(docs: DataFrame, p: LanguageParams = LanguageParams(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    return train(sample(docs, p, doc_id, text, lang), p)


class Scorer:
    """Pooled language probabilities of texts, given as one buffer of bytes with offsets."""

    BATCH = 512

    def __init__(self, model: LanguageModel):
        p = model.params
        self.window = model.window
        self.tables = p["E"].copy()
        self.tables[:, :2] *= 0.5
        self.v, self.c = p["V"], p["c"]
        self.runner = bigru.Runner(p, self.window, self.BATCH)

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities (texts, languages); zeros for an empty text."""
        lengths = np.diff(offsets)
        windows = -(-lengths // self.window)
        owner = np.repeat(np.arange(len(lengths)), windows)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        first = offsets[owner] + nth * self.window
        size = np.minimum(self.window, offsets[owner + 1] - first)
        sums = np.zeros((len(lengths), len(self.c)))
        padded = np.concatenate([data, np.zeros(self.window, np.uint8)])
        steps = np.arange(self.window)[:, None]
        for start in range(0, len(owner), self.BATCH):
            some = slice(start, start + self.BATCH)
            n = len(owner[some])
            rows = np.full((self.window, self.BATCH), PAD)
            rows[:, :n] = padded[first[some][None, :] + steps]
            inside = steps < size[some][None, :]
            rows[:, :n][~inside] = PAD
            states = self.runner.run(self.tables, rows)
            hidden = states.shape[-1]
            logits = states[1:, 0] @ self.v[:hidden] + states[:0:-1, 1] @ self.v[hidden:] + self.c
            prob = np.exp(logits, out=logits)
            prob /= prob.sum(-1, keepdims=True)
            prob[:, :n] *= inside[..., None]
            np.add.at(sums, owner[some], prob[:, :n].sum(0))
        return sums / np.maximum(lengths, 1)[:, None]


def predict(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every row."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # some tens of kilobytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = shared.value.languages
        scorer = Scorer(shared.value)
        for batch in sliced(batches, rows=512):
            column = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            raw = column.buffers()[2]
            data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
            readable = np.array(batch.column(2)) & bool(languages)
            if languages:
                pooled = scorer.pooled(data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - offsets[0])
                pooled = np.round(pooled, 5)
                best, score = pooled.argmax(1), np.clip(pooled.max(1), 0.0, 1.0)
                names = [languages[b] if ok else UNKNOWN for b, ok in zip(best, readable, strict=True)]
                score = np.where(readable, score, 0.0)
            else:
                names, score = [UNKNOWN] * len(batch), np.zeros(len(batch))
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    letters = F.coalesce(F.regexp_like(F.col(text), F.lit(r"\p{L}")), F.lit(False))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), letters.alias("letters")).mapInArrow(run, SCHEMA)
