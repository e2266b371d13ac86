"""Quality rules: base counts, and divergence from language references by Jensen-Shannon distance.

All with built-in functions. ``candidate_words`` reads every text and finds each language's words that stand in most documents, by a mergeable
sketch of fixed size. ``quality_features`` takes one pass over the whole texts and gives each document's base
counts and two histograms: characters by class, and candidate words. ``fit_references`` puts the histograms of
the documents that pass the base rule together into one reference for every language that has ``min_reference_docs`` of them; its common words are the ``common_words``
candidates with the largest exact share of these documents. ``judge`` rejects a document that
fails the base rule, or whose distance to the nearest reference is over the limit; a histogram under its minimum
length says too little and isn't compared.

A document of a language without a reference is compared with the pool of all languages: the shares of letters of any script, digits, punctuation and symbols among
the characters of words, as means over all documents that have a language and pass the base rule. A language whose own documents are, in the mean, farther from the pool than the limit is not
trusted as a reference (its documents are mostly junk), and so its documents are compared with the pool, too. Signs that are none of these symbols count as letters there. The word limit widens for texts under ``full_limit_words``, as the squared distance of a
sample of n words to its own distribution is about (cells - 1) / (8 ln 2 n): 1.44 / n for eight common words and the rest.

Words are maximal runs of characters other than space and U+0009 to U+000D. Defined results: a null text has no words and no
characters and so fails the base rule; repeated rows are judged alike; a document without a language is compared with all references, or the pool if there are none; without
``min_reference_docs`` good documents in all, the base rule alone decides.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .packing import BREAKS, WORD_BREAK
from .scratch import written

#: Counted among the characters that are neither a-z nor the plain space; those two are counted by difference.
RARE_CLASSES = {"upper": r"[^A-Z]+", "digit": r"[^0-9]+", "punctuation": r"[^.,;:!?'\"()\-]+", "other space": r"[^\x09-\x0D]+"}
CLASSES = ["lower", "space", "upper", "digit", "punctuation", "rest"]
SYMBOLS = r"[^#*$%&|<>]+"


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 50
    repeat_percent: int = 50
    min_chars_for_classes: int = 200
    min_words_for_lexicon: int = 50
    max_class_distance: float = 0.22
    max_word_distance: float = 0.25
    full_limit_words: int = 100
    word_spread: float = 1.44
    common_words: int = 8
    candidates: int = 16
    tracked_words: int = 20_000
    min_reference_docs: int = 20
    long_text_words: int = 8192


@dataclass(frozen=True)
class Reference:
    """Mean histograms of a language: characters by class, and its common words with all others last."""

    classes: tuple[float, ...]
    words: tuple[str, ...]
    shares: tuple[float, ...]


class References(dict):
    """A Reference by language, and the pool's shares (FOLDED), or None where too few documents are good."""

    pool: tuple[float, ...] | None = None


#: The pool's cells.
FOLDED = ["letters", "digits", "punctuation", "symbols"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _removed(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def words_of(text: Column) -> Column:
    """The words of a text; one empty string where it has none."""
    return F.split(F.trim(F.coalesce(text, F.lit("")), F.lit(BREAKS)), WORD_BREAK)


def candidate_words(docs: DataFrame, params: QualityParams, text: str = "text", lang: str = "lang") -> list[str]:
    """Lower-case words that may be among the common ones of a language: ``candidates`` a language, by the number of documents that hold them.

    Every document of ``min_words`` words or more counts. A task's state is a sketch a language of ``tracked_words`` words; only the found words come
    to the driver.
    """
    split = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), words_of(F.lower(F.col(text))).alias("words")).filter(F.size("words") >= params.min_words)
    each = split.select("lang", F.explode(F.array_distinct("words")).alias("word"))
    top = F.expr(f"approx_top_k(word, {params.candidates}, {params.tracked_words})")
    found = each.groupBy("lang").agg(top.alias("top")).select(F.explode("top.item").alias("word")).distinct().collect()
    return sorted(r["word"] for r in found)


def with_quality(docs: DataFrame, lexicon: list[str], params: QualityParams = QualityParams(), text: str = "text", name: str = "quality") -> DataFrame:
    """``docs`` with a struct ``name`` of base counts and histograms; ``docs`` must have no column of that name.

    The steps are projections of their own, so that the word list, the window codes and their sorted form are made once a text.
    A window's code holds its hash in the high bits and its position in as few low bits as the text's length takes; sorting the codes brings
    equal windows together. Over ``long_text_words`` words, pairs of a 64-bit hash and a position are sorted instead.
    """
    names = docs.columns
    kept = [f"_own{i}" for i in range(len(names))]  # no column of the caller's can clash with a step's
    own = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(names, kept, strict=True)], F.coalesce(F.col(text), F.lit("")).alias("text"))
    split = own.select(
        *kept,
        "text",
        words_of(F.col("text")).alias("words"),
        F.regexp_replace("text", "[a-z ]+", "").alias("rare"),
        (F.octet_length("text") - F.octet_length(F.replace("text", F.lit(" "), F.lit("")))).cast("long").alias("blanks"),
        F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(BREAKS)) != "").alias("lines"),
    )
    # splitting a text without words gives one empty string
    n = F.when(F.get("words", F.lit(0)) == "", F.lit(0)).otherwise(F.size("words"))
    counted = split.select(
        *kept,
        "words",
        n.alias("n"),
        F.ceil(F.log2(F.size("words") + 1)).cast("int").alias("place_bits"),
        F.filter(F.transform("words", F.lower), lambda w: w.isin(*lexicon)).alias("common"),
        *[_removed(F.col("rare"), outside).alias(name) for name, outside in RARE_CLASSES.items()],
        _removed(F.col("rare"), SYMBOLS).alias("n_symbols"),
        F.length("text").cast("long").alias("n_chars"),
        F.length("rare").cast("long").alias("n_rare"),
        "blanks",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )

    def code(word: Column, i: Column) -> Column:
        hashed = F.xxhash64(word, F.get("words", i + 1), F.get("words", i + 2))
        return F.call_function("shiftleft", hashed, F.col("place_bits")).bitwiseOR(i.cast("long"))

    def windows(each: Callable[[Column, Column], Column]) -> Column:
        return F.sort_array(F.slice(F.transform("words", each), F.lit(1), F.greatest(F.col("n") - 2, F.lit(0))))

    def window(x: Column) -> Column:
        return F.call_function("shiftright", x, F.col("place_bits"))

    def twice(codes: str, of: Callable[[Column], Column]) -> Column:
        return F.filter(codes, lambda x, i: of(x).eqNullSafe(of(F.get(codes, i - 1))) | of(x).eqNullSafe(of(F.get(codes, i + 1))))

    def pair(word: Column, i: Column) -> Column:
        return F.struct(F.xxhash64(word, F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.cast("long").alias("at"))

    long_text = F.col("n") > params.long_text_words
    coded = counted.withColumns({"codes": F.when(~long_text, windows(code)), "pairs": F.when(long_text, windows(pair))})
    low_bits = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place_bits")) - 1
    starts = F.when(long_text, F.transform(twice("pairs", lambda x: x["h"]), lambda x: x["at"])).otherwise(F.transform(twice("codes", window), lambda x: x.bitwiseAND(low_bits)))
    placed = coded.withColumn("starts", F.sort_array(starts))
    # windows of three overlap: each start adds the words since the start before it, three at most
    added = F.transform("starts", lambda x, i: F.least(F.lit(3).cast("long"), x - F.get("starts", i - 1)))
    lower = F.col("n_chars") - F.col("n_rare") - F.col("blanks")
    space = F.col("blanks") + F.col("other space")
    rest = F.col("n_rare") - F.col("upper") - F.col("digit") - F.col("punctuation") - F.col("other space")
    counts = F.transform(F.array_distinct("common"), lambda w: F.struct(w, (F.size("common") - F.size(F.array_remove("common", w))).cast("long")))
    quality = F.struct(
        F.col("n").cast("long").alias("n_words"),
        (F.col("n_chars") - space).alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        F.aggregate(added, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
        F.array(lower, space, F.col("upper"), F.col("digit"), F.col("punctuation"), rest).alias("class_counts"),
        F.map_from_entries(counts).alias("word_counts"),
    )
    return placed.select(*[F.col(k).alias(c) for c, k in zip(names, kept, strict=True)], quality.alias(name))


def quality_features(docs: DataFrame, params: QualityParams = QualityParams(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_counts, word_counts`` (a map of the candidate words that occur)."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    return with_quality(named, candidate_words(named, params), params).select("doc_id", "lang", "quality.*")


def base_failed(params: QualityParams) -> Column:
    return (F.col("n_words") < params.min_words) | (100 * F.col("n_repeat_words") > params.repeat_percent * F.col("n_words"))


def fit_references(features: DataFrame, params: QualityParams) -> References:
    """A reference for every trusted language with ``min_reference_docs`` documents that pass the base rule, and the pool of all; each document weighs alike.

    The driver gets ``common_words`` words and two histograms of each such language, and a histogram of all.
    """
    good = features.filter(~base_failed(params) & F.col("lang").isNotNull())
    shares = good.select("lang", _normalised(F.col("class_counts")).alias("c"), _folded().alias("f"))
    means = [F.avg(F.col(x)[i]).alias(f"{x}{i}") for x, n in (("c", len(CLASSES)), ("f", len(FOLDED))) for i in range(n)]
    found = shares.rollup("lang").agg(F.grouping("lang").alias("all"), F.count("*").alias("docs"), *means).filter(F.col("docs") >= params.min_reference_docs).collect()
    out = References()
    folded = {row["lang"]: tuple(row[f"f{i}"] or 0.0 for i in range(len(FOLDED))) for row in found if not row["all"]}
    out.pool = next((tuple(row[f"f{i}"] or 0.0 for i in range(len(FOLDED))) for row in found if row["all"] and row["docs"]), None)
    trusted = [name for name, own in folded.items() if _distance(own, out.pool) <= params.max_class_distance]
    held = good.filter(F.col("lang").isin(trusted)).select("lang", "n_words", F.explode("word_counts").alias("word", "times"))
    # integer parts of a billion add up alike in any order
    weights = held.groupBy("lang", "word").agg(F.count("*").alias("holders"), F.sum(F.expr("times * 1000000000 div n_words")).alias("weight"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("holders"), "word"))
    words = weights.withColumn("place", place).filter(F.col("place") <= params.common_words).collect() if trusted else []
    for row in found:
        if row["all"] or row["lang"] not in trusted:
            continue
        common = sorted((w for w in words if w["lang"] == row["lang"]), key=lambda w: w["place"])
        part = [w["weight"] / 1e9 / row["docs"] for w in common]
        out[row["lang"]] = Reference(tuple(row[f"c{i}"] or 0.0 for i in range(len(CLASSES))), tuple(w["word"] for w in common), (*part, max(0.0, 1.0 - sum(part))))
    return out


def _folded() -> Column:
    """Shares of FOLDED among the characters of words."""
    _, _, _, digits, punctuation, _ = (F.col("class_counts")[i] for i in range(len(CLASSES)))
    return _normalised(F.array(F.col("word_chars") - digits - punctuation - F.col("n_symbols"), digits, punctuation, F.col("n_symbols")))


def _distance(p: tuple[float, ...], q: tuple[float, ...]) -> float:
    """Jensen-Shannon distance of two known histograms."""
    total = sum(x * math.log2(2 * x / (a + b)) for a, b in zip(p, q, strict=True) for x in (a, b) if x > 0)
    return math.sqrt(max(total / 2, 0.0))


def _normalised(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return let(total, lambda t: F.transform(counts, lambda x: F.when(t > 0, x / t).otherwise(F.lit(0.0))))


def js_distance(p: Column, q: Column | list[float]) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two normalised histograms."""
    q = F.array(*[F.lit(float(x)) for x in q]) if isinstance(q, list) else q

    def part(a: Column, b: Column) -> Column:
        m = (a + b) / 2
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0)) + F.when(b > 0, b * F.log2(b / m)).otherwise(F.lit(0.0))

    total = F.aggregate(F.zip_with(p, q, part), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def word_limit(n_words: Column, params: QualityParams) -> Column:
    """The largest word distance of a text that is kept; wider for short texts by their sampling spread."""
    spread = params.word_spread * F.greatest(1 / n_words - 1 / params.full_limit_words, F.lit(0.0))
    return F.sqrt(params.max_word_distance**2 + spread)


def judge(features: DataFrame, references: References, params: QualityParams) -> DataFrame:
    """The features with ``base_failed``, ``class_distance``, ``word_distance``, ``nearest`` and ``kept``.

    The nearest reference is the one with the least sum of both distances, in billionths (the first by name among equals). A document whose
    language has no reference has the distance to the pool as its ``class_distance`` and nulls in the two others. A distance is null where its histogram is too short.
    """
    out = features.withColumns({"base_failed": base_failed(params), "c": _normalised(F.col("class_counts"))})
    if references:
        def numbers(values) -> Column:
            return F.array(*[F.lit(float(x)) for x in values])

        known = F.array(*[
            F.struct(F.lit(name).alias("name"), numbers(r.classes).alias("c"), F.array(*[F.lit(w) for w in r.words]).cast("array<string>").alias("words"), numbers(r.shares).alias("w"))
            for name, r in sorted(references.items())
        ])

        def words(r: Column) -> Column:
            """The document's shares of the reference's words, and of all others."""
            own = F.transform(r["words"], lambda w: F.coalesce(F.col("word_counts")[w], F.lit(0)) / F.col("n_words"))
            return let(own, lambda p: F.concat(p, F.array(1.0 - F.aggregate(p, F.lit(0.0), lambda s, x: s + x))))

        each = F.transform(known, lambda r: F.struct(js_distance(F.col("c"), r["c"]).alias("c"), js_distance(words(r), r["w"]).alias("w"), r["name"].alias("name")))
        summed = F.transform(each, lambda x: F.struct(F.round((x["c"] + x["w"]) * 1e9).cast("long").alias("total"), x["name"].alias("name"), x["c"].alias("c"), x["w"].alias("w")))
        compared = (F.col("n_words") > 0) & (F.col("lang").isNull() | F.col("lang").isin(*references))
        out = out.withColumn("near", F.when(compared, F.array_min(summed)))
    else:
        out = out.withColumn("near", F.lit(None).cast("struct<total:bigint,name:string,c:double,w:double>"))
    pool = F.lit(None).cast("double")
    if references.pool:
        pool = F.when(F.col("near").isNull() & (F.col("word_chars") >= params.min_chars_for_classes), js_distance(_folded(), list(references.pool)))
    n_chars = F.aggregate("class_counts", F.lit(0).cast("long"), lambda a, x: a + x)
    out = out.withColumns({
        "class_distance": F.coalesce(F.when(n_chars >= params.min_chars_for_classes, F.col("near")["c"]), pool),
        "word_distance": F.when(F.col("n_words") >= params.min_words_for_lexicon, F.col("near")["w"]),
        "nearest": F.col("near")["name"],
    })
    far = F.coalesce(F.col("class_distance") > params.max_class_distance, F.lit(False)) | F.coalesce(F.col("word_distance") > word_limit(F.col("n_words"), params), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~far).drop("c", "near")


def quality_rules(docs: DataFrame, params: QualityParams = QualityParams(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Features and verdict of every document; the features are written once and read for the references and the verdicts."""
    features = written(quality_features(docs, params, doc_id, text, lang), "quality")
    return judge(features, fit_references(features, params), params)


def keep_good(docs: DataFrame, params: QualityParams = QualityParams(), text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they are.

    The rows are written once together with their features, so that neither the references nor the verdicts need a join.
    """
    name = "quality"
    while name in docs.columns:
        name += "_"
    rated = written(with_quality(docs, candidate_words(docs, params, text, lang), params, text, name), "rated")
    features = rated.select(F.col(lang).alias("lang"), f"{name}.*")
    references = fit_references(features, params)
    own = rated.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{lang}`").alias("lang"), f"{name}.*")
    return judge(own, references, params).filter("kept").select(*[F.col("row")[c].alias(c) for c in docs.columns])
