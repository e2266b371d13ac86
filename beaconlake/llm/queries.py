"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, hard_negatives, language_id, line_crf, media_ts, ngram_join, packing, prefix_trie, quality_rules, token_codes, toxicity, url_filters

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its optimal length bucket and token-budget batch."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its set of 4-word shingles and its component at a similarity of 85 percent."""
    joined = ngram_join.link_components(table(spark, sf_dir, "documents"), ngram_join.JoinParams(words=4, percent=85))
    return joined.select("doc_id", "n_shingles", "component_id")


_OP2 = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] END AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM words WHERE len(w) > 0)
), flat AS (SELECT doc_id, x, count(*) OVER (PARTITION BY doc_id) AS n FROM shingles
), sizes AS (SELECT d.doc_id, count(x) AS n_shingles FROM documents d LEFT JOIN shingles USING (doc_id) GROUP BY d.doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (SELECT doc_id, doc_id AS met FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.met = l.a)
"""
OP2_SQL = _OP2 + "SELECT r.doc_id, any_value(n_shingles) AS n_shingles, min(met) AS component_id FROM reach r JOIN sizes USING (doc_id) GROUP BY r.doc_id"
OP2_LINKS_SQL = (
    _OP2
    + """SELECT r.doc_id, any_value(n_shingles) AS n_shingles, min(met) AS component_id, coalesce(any_value(n), 0) AS n_links
FROM reach r JOIN sizes USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n FROM links GROUP BY a) USING (doc_id) GROUP BY r.doc_id"""
)


def op2_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of op2_ngram_join with the number of other documents that each document is linked with."""
    counted = ngram_join.link_counts(table(spark, sf_dir, "documents"), ngram_join.JoinParams(words=4, percent=85))
    return counted.select("doc_id", "n_shingles", "component_id", "n_links")


ODD_CHAT = "\\### Assistant: </turn> ok"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted; the digests are read back from the formatted string."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD_CHAT).alias("text")
    )
    formatted = chat_format.format_chats(turns.unionByName(odd))
    back = formatted.withColumns({"turns": chat_format.read_back(F.col("formatted")), "loss": chat_format.loss_text(F.col("segments"))})
    plain = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(plain, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP3_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), named AS (
  SELECT *, replace(replace(replace(replace(role, '\', '\e'), '#', '\h'), '<', '\l'), ':', '\c') AS role_escaped,
    replace(replace(replace(replace(text, '\', '\e'), '#', '\h'), '<', '\l'), ':', '\c') AS text_escaped,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM turns
), checked AS (
  SELECT *, CASE WHEN role = 'system' THEN place = 1 WHEN role = 'user' THEN place = 1 OR before IN ('system', 'assistant')
    WHEN role = 'assistant' THEN coalesce(before = 'user', FALSE) ELSE FALSE END AND (place < n OR role = 'assistant') AS fits
  FROM named
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || role_escaped || ': ' || text_escaped || ' </turn>' || chr(10))) AS BIGINT) AS formatted_chars,
  bool_and(fits) AS valid
FROM checked GROUP BY conv_id
"""


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the divergence verdict of every document."""
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    distances = [F.round(c, 6).alias(c) for c in ("class_distance", "word_distance")]
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "nearest", *distances)


def _divergence(p: str, q: str) -> str:
    """One cell's part of twice the Jensen-Shannon divergence in SQL."""
    return f"CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0 END"


OP4_SQL = f"""
WITH split AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM split)
), repeated AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT *, count(*) OVER (PARTITION BY rid, w) AS times FROM windows), range(3) r(k) WHERE times > 1 GROUP BY rid
), counted AS (
  SELECT rid, doc_id, lang, words, len(words) AS n_words, length(text) AS n_chars, length(array_to_string(words, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    length(regexp_replace(text, '[^a-z]+', '', 'g')) AS c0, length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS c2, length(regexp_replace(text, '[^0-9]+', '', 'g')) AS c3,
    length(regexp_replace(text, '[^.,;:!?''"()\\-]+', '', 'g')) AS c4, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM split
), based AS (
  SELECT c.*, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, n_chars - word_chars AS c1, word_chars - c0 - c2 - c3 - c4 AS c5,
    n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed FROM counted c LEFT JOIN repeated USING (rid)
), cells AS (
  SELECT rid, lang, base_failed, k, CASE k WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 WHEN 3 THEN c3 WHEN 4 THEN c4 ELSE c5 END / n_chars AS p FROM based, range(6) r(k) WHERE n_chars > 0
), folded AS (
  SELECT rid, lang, base_failed, k, CASE k WHEN 0 THEN word_chars - c3 - c4 - n_symbols WHEN 1 THEN c3 WHEN 2 THEN c4 ELSE n_symbols END / word_chars AS p FROM based, range(4) r(k) WHERE word_chars > 0
), pool AS (SELECT k, avg(p) AS q FROM folded WHERE NOT base_failed AND lang IS NOT NULL GROUP BY k HAVING count(*) >= 20
), trusted AS (
  SELECT lang FROM (SELECT lang, k, avg(p) AS p FROM folded WHERE NOT base_failed GROUP BY lang, k) JOIN pool USING (k) GROUP BY lang HAVING sqrt(greatest(sum({_divergence("p", "q")}) / 2, 0)) <= 0.22
), refs AS (SELECT lang, count(*) AS docs FROM based JOIN trusted USING (lang) WHERE NOT base_failed GROUP BY lang HAVING count(*) >= 20
), class_refs AS (SELECT lang AS name, k, avg(p) AS q FROM cells JOIN refs USING (lang) WHERE NOT base_failed GROUP BY lang, k
), worded AS (
  SELECT rid, lang, base_failed, n_words, word, count(*) AS times FROM (SELECT rid, lang, base_failed, n_words, unnest(list_transform(words, lambda x: lower(x))) AS word FROM based) GROUP BY ALL
), word_refs AS (
  SELECT lang AS name, word, sum(times * 1000000000 // n_words) / 1e9 / any_value(docs) AS q FROM worded JOIN refs USING (lang) WHERE NOT base_failed GROUP BY lang, word
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) <= 8
), compared AS (SELECT b.rid, b.n_words, r.lang AS name FROM based b JOIN refs r ON b.n_words > 0 AND (b.lang IS NULL OR b.lang IN (SELECT lang FROM refs))
), class_distances AS (SELECT rid, name, sqrt(greatest(sum({_divergence("p", "q")}) / 2, 0)) AS c FROM cells JOIN class_refs USING (k) GROUP BY rid, name
), word_cells AS (SELECT rid, name, coalesce(times, 0) / c.n_words AS p, q FROM compared c JOIN word_refs USING (name) LEFT JOIN worded USING (rid, word)
), all_words AS (SELECT rid, name, p, q FROM word_cells UNION ALL SELECT rid, name, 1 - sum(p), greatest(0, 1 - sum(q)) FROM word_cells GROUP BY rid, name
), word_distances AS (SELECT rid, name, sqrt(greatest(sum({_divergence("p", "q")}) / 2, 0)) AS w FROM all_words GROUP BY rid, name
), near AS (
  SELECT rid, name, c, w FROM compared JOIN class_distances USING (rid, name) JOIN word_distances USING (rid, name) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY CAST(round((c + w) * 1e9) AS BIGINT), name) = 1
), pool_distances AS (SELECT rid, sqrt(greatest(sum({_divergence("p", "q")}) / 2, 0)) AS d FROM folded JOIN pool USING (k) WHERE rid NOT IN (SELECT rid FROM near) GROUP BY rid
), judged AS (
  SELECT b.*, name AS nearest, CASE WHEN name IS NOT NULL AND n_chars >= 200 THEN c WHEN name IS NULL AND word_chars >= 200 THEN d END AS class_distance, CASE WHEN n_words >= 50 THEN w END AS word_distance
  FROM based b LEFT JOIN near USING (rid) LEFT JOIN pool_distances USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (coalesce(class_distance > 0.22, FALSE) OR coalesce(word_distance > sqrt(0.0625 + 1.44 * greatest(1 / n_words - 1 / 100, 0)), FALSE)) AS kept,
  nearest, round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance
FROM judged
"""


def _remainder(of: str, n: int):
    return F.crc32(F.col(of).cast("string")) % n


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, by a network that learned from the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(_remainder("doc_id", 4) == 2, F.lit(False))
    model = language_id.fit(docs.filter(~held_out))
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.ToxicityModel:
    """Learned from the labelled documents that aren't held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.fit(docs, labels.filter(_remainder("doc_id", 5) != 0))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every whole text."""
    scored = toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


END_ID = 2


def op7_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token segments of all documents, written and read back: place, length and checksum of every document's ids."""
    import public_tokenizers

    segments = token_codes.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return token_codes.read_tokens(segments, token_codes.ids_crc32, "ids_crc32 long")


def op8_media_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a stored transport stream, with what is read back from it."""
    return media_ts.read_media(media_ts.store_media(table(spark, sf_dir, "documents")))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by the public ranks, and the bytes that they decode to."""
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


RULES = (
    url_filters.Rule("allow", "org", "/"),
    url_filters.Rule("block", "example.org", "/es/"),
    url_filters.Rule("block", "example.org", "/en/1"),
    url_filters.Rule("allow", "com", "/fr/"),
    url_filters.Rule("block", "com", "/de/"),
)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict. The list holds the pages that were fetched through a tracked link (``utm_source``)."""
    pages = table(spark, sf_dir, "pages")
    listed = pages.filter(F.col("url").contains("utm_source=")).select("url")
    return url_filters.url_filter(pages, RULES, listed).select("page_id", "host", "path", "rule", "verdict", "canonical_url")


OP9_SQL = r"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages
), parsed AS (
  SELECT page_id, url, rest,
    translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path,
    list_sort(list_filter(string_split(regexp_extract(coalesce(rest, ''), '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_'))) AS query
  FROM cut
), named AS (
  SELECT page_id, url, host, path, CASE WHEN rest IS NOT NULL THEN
    regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END
    END AS canonical_url FROM parsed
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fitted AS (
  SELECT n.*, r.rule_host || r.rule_path AS rule, r.verdict AS rule_verdict,
    row_number() OVER (PARTITION BY n.page_id, n.url ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST) AS place
  FROM named n LEFT JOIN rules r ON (n.host = r.rule_host OR ends_with(n.host, '.' || r.rule_host)) AND starts_with(n.path, r.rule_path)
), listed AS (SELECT DISTINCT canonical_url FROM named WHERE contains(url, 'utm_source='))
SELECT page_id, host, path, rule,
  coalesce(rule_verdict, CASE WHEN canonical_url IN (SELECT canonical_url FROM listed WHERE canonical_url IS NOT NULL) THEN 'block' END, 'allow') AS verdict,
  canonical_url
FROM fitted WHERE place = 1
"""

def op11_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every whole text, by a chain over its lines that learned from the labelled documents that aren't held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = line_crf.fit(docs, labels.filter(_remainder("doc_id", 5) != 0))
    return line_crf.score(docs, model).select("doc_id", F.coalesce(_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of the rebuilt conversations: each begins with up to five turns of the conversation whose id is the last multiple of 100."""
    own = prefix_trie.sequences(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.rebuilt(own, lambda c: F.crc32(c.cast("string")) % 6, lambda c: c - c % 100, 5))


OP12_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'key': role || chr(0) || text, 'chars': length(text)} ORDER BY turn NULLS FIRST, role, left(text, 32), md5(strlen(role) || ':' || role || text)) AS seq,
    xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [ascii(x), 0, 0, 0, 0, 0, 0, 0]::BIGINT[]))),
      lambda a, b: xor(xor(a, b) >> 1, CASE WHEN xor(a, b) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 6 AS h
  FROM turns GROUP BY conv_id
), rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.seq[1:o.h], []), o.seq[o.h + 1:]) AS seq FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100
), nodes AS (
  SELECT seq[1:d] AS path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CASE WHEN len(seq) = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ends
  FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM rebuilt) GROUP BY seq[1:d], d
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
), children AS (
  SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2
), counted AS (
  SELECT l.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * path[depth].chars ELSE 0 END AS own_saved FROM linked l LEFT JOIN children USING (path, depth)
), below AS (
  SELECT path[1:d] AS path, d AS depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(own_saved) AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM counted) GROUP BY path[1:d], d
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256 FROM counted JOIN below USING (path, depth)
"""

ANCHOR_EVERY = 100


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor's positives; the label of every seventh id is moved by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), moved, ANCHOR_EVERY)


OP13_SQL = """
WITH vectors AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), ranked AS (
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, other_id) AS place, other_id AS negative_id, positive_score, s.score AS negative_score
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE place <= 10
"""

QUERIES: dict[str, Query] = {
    "op1_packing": op1_packing,
    "op2_ngram_join": op2_ngram_join,
    "op2_ngram_links": op2_ngram_links,
    "op3_chat_format": op3_chat_format,
    "op4_quality_rules": op4_quality_rules,
    "op5_language_id": op5_language_id,
    "op6_toxicity": op6_toxicity,
    "op7_token_codes": op7_token_codes,
    "op8_media_ts": op8_media_ts,
    "op9_url_filters": op9_url_filters,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_line_crf": op11_line_crf,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLE_SQL: dict[str, str] = {"op2_ngram_join": OP2_SQL, "op2_ngram_links": OP2_LINKS_SQL, "op3_chat_format": OP3_SQL, "op4_quality_rules": OP4_SQL, "op9_url_filters": OP9_SQL, "op12_prefix_trie": OP12_SQL, "op13_hard_negatives": OP13_SQL}
