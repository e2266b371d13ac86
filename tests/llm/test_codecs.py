"""Token codes, byte-level BPE and transport streams: exact round trips and the public libraries as references."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from beaconlake.llm import bpe, media_ts, queries, token_codes

R = random.Random(1)
ODD = ["", " ", "  ", "a  b", "a \n b", "\n\n  x", "foo  ", "x" * 300, "aaaa" * 50, "é" * 100, " lead", "trail ", "a\tb  c", "don't I'll 12345 ...!!! ", "😀😀 漢字" * 20, "ab" * 3000, "<|endoftext|> a<|endoftext|> b", "a\nb, c\n"]
ODD += ["".join(R.choice(["a", "b", " ", "  ", "\n", "the", "'s", "1", "é", "!", "　", "x\ty", "word,"]) for _ in range(R.randint(0, 40))) for _ in range(300)]
DOCS = "doc_id long, text string, ids string"


def odd_docs(spark):
    rows = [(i, t, "clash") for i, t in enumerate(ODD[:60])]
    return spark.createDataFrame([*rows, (1000, None, ""), (None, "no id", ""), rows[7], rows[7]], DOCS)


# ---- byte-level BPE


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(reference):
    codec = bpe.loaded(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for text in ODD:
        ids = codec.encode(text)
        assert ids == reference.encode_ordinary(text), text[:50]
        assert codec.decode(codec.ids_text(text)) == text.encode()


def fuzz(seed, n):
    """Strings of what tokenizers treat apart: white space of all kinds, added tokens, marks, words."""
    r = random.Random(seed)
    white = [chr(c) for c in (0x20, 0x20, 0x20, 0x0A, 0x0A, 0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1F, 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x2029, 0x202F, 0x3000, 0x200B)] + ["  ", "\n\n", "\r\n"]
    other = ["a", "b", "the", "word,", "x.", "'s", "1", "é", "!", "漢", "😀", "Foo", "\0", "<|endoftext|>", "<|endof", "e\u0301"]
    return ["".join(r.choices(white, k=1)[0] if r.random() < 0.5 else r.choice(other) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_words_with_marks_share_chunks(reference):
    """A word is one chunk whatever mark follows it, so its ids are made once."""
    import pyarrow as pa

    from beaconlake.llm.chunks import chunk_lists

    words = ["cat, cat. cat", "cat! (cat) cat;", "", "it's café, x9, a\tb, <s>, c"]
    chunks, at, ends = chunk_lists(pa.array(words), ("<s>",))
    assert chunks[:4] == ["cat", ",", " cat", "."] and len(chunks) == 9 and "".join(chunks[i] for i in at) == "".join(words)
    assert ["".join(chunks[i] for i in at[a:b]) for a, b in zip([0, *ends], ends)] == words
    encoder = token_codes.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode([*words, *words])] == [reference.encode_ordinary(t) for t in [*words, *words]]


def test_fuzzed_texts_equal_libraries(reference):
    import pyarrow as pa

    codec = bpe.loaded(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    encoder = token_codes.loaded(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for seed in range(50):
        texts = fuzz(seed, 2000)
        for got, want in ((codec.chunks.ids(pa.array(texts)), [reference.encode_ordinary(t) for t in texts]), (encoder.ids(pa.array(texts)), [e.ids for e in library.encode_batch(texts, add_special_tokens=False)])):
            parts = np.split(got[0], got[1][:-1])
            assert [(t, p.tolist()) for t, p, w in zip(texts, parts, want, strict=True) if p.tolist() != w] == []


def test_other_patterns_and_tokenizers():
    """Texts are only cut for the pattern that the rule was made for."""
    import pyarrow as pa

    words = r"\S+|\s+"
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("other", pat_str=words, mergeable_ranks=ranks, special_tokens={})
    codec, texts = bpe.RankBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), words), [*ODD, *fuzz(1, 200)]
    assert [codec.encode(t) for t in texts] == [own.encode_ordinary(t) for t in texts]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encoder = token_codes.ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"))
    got = encoder.ids(pa.array(texts))
    assert [p.tolist() for p in np.split(got[0], got[1][:-1])] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_decodes_unknown_ids(spark):
    rows = spark.createDataFrame([(1, [220, 50257]), (2, [-1]), (3, None), (4, []), (5, [None]), (6, [464])], "doc_id long, ids array<int>")
    got = {r.doc_id: None if r.bytes is None else bytes(r.bytes) for r in bpe.decode_ids(rows, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()}
    assert got == {1: None, 2: None, 3: b"", 4: b"", 5: None, 6: b"The"}


def test_bpe_cache_turns_over(reference):
    codec = bpe.RankBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, cache_size=3)
    assert [codec.encode(t) for t in ODD[:80]] == [reference.encode_ordinary(t) for t in ODD[:80]]


def test_rank_queue_is_ordered():
    queue, want = bpe.RankQueue(70000), []
    for _ in range(3000):
        entry = (R.randrange(70000) if R.random() < 0.5 else R.randrange(5), R.randrange(1000))
        queue.push(*entry)
        want.append(entry)
    got = []
    while queue.top:
        got.append(queue.pop())
    assert got == sorted(want)


def test_bpe_frames(spark, reference):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = odd_docs(spark)
    rows = bpe.round_trip(docs, path, public_tokenizers.PATTERN).collect()
    want = sorted((str(d.doc_id), hashlib.sha256(" ".join(map(str, reference.encode_ordinary(d.text or ""))).encode()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest()) for d in docs.collect())
    assert sorted((str(r.doc_id), r.ids_sha256, r.decoded_sha256) for r in rows) == want
    back = bpe.decode_ids(bpe.encode_ids(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert sorted((str(r.doc_id), bytes(r.bytes)) for r in back.collect()) == sorted((str(d.doc_id), (d.text or "").encode()) for d in docs.collect())
    assert bpe.round_trip(spark.createDataFrame([], DOCS), path, public_tokenizers.PATTERN).count() == 0


# ---- token codes


@pytest.mark.parametrize("n", [0, 1, 5, 511, 512, 513, 5000])
@pytest.mark.parametrize("high", [200, 300, 60000, 2**20, 2**32 - 1])
def test_codes_random_access(n, high):
    ids = np.array([R.randint(0, high) for _ in range(n)], np.uint32)
    codes = token_codes.Codes(token_codes.encode_codes(ids))
    assert len(codes) == n and (codes.slice(0, n) == ids).all()
    for _ in range(15 if n else 0):
        i = R.randrange(n)
        j = R.randint(i, n)
        assert codes[i] == ids[i] and (codes.slice(i, j) == ids[i:j]).all()


def test_codes_reject_other_bytes():
    with pytest.raises(ValueError):
        token_codes.Codes(b"nothing of the kind")


def test_chunk_encoder_equals_library():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for size in (1 << 20, 10):
        encoder = token_codes.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"), cache_size=size)
        for at in range(0, len(ODD), 50):
            assert encoder.encode(ODD[at : at + 50]) == [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(ODD[at : at + 50], add_special_tokens=False)]


def test_tokens_written_and_read(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = odd_docs(spark)
    segments = token_codes.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, segment_tokens=500)
    rows = sorted(token_codes.read_tokens(segments, token_codes.ids_crc32, "ids_crc32 long").collect(), key=lambda r: r.start)
    assert segments.count() > 3
    ids = {d.doc_id: [*library.encode(d.text or "", add_special_tokens=False).ids, 2] for d in docs.collect()}
    keys = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert keys == sorted(keys) and len(rows) == docs.count()
    at = 0
    for r in rows:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[r.doc_id]), zlib.crc32(np.array(ids[r.doc_id], "<u4").tobytes()))
        at += r.n_tokens


def test_tokens_empty(spark):
    segments = token_codes.write_tokens(spark.createDataFrame([], DOCS), public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert token_codes.read_tokens(segments, token_codes.ids_crc32, "ids_crc32 long").count() == 0


# ---- transport streams


@pytest.mark.parametrize("size", [0, 1, 161, 162, 163, 575, 576, 577, 36864, 36865, 120000])
def test_stream_round_trip(size):
    payload = media_ts.payload_of(bytes(R.randrange(256) for _ in range(size)))
    stream = media_ts.demux(media_ts.mux(payload))
    units = -(-len(payload) // (media_ts.FRAME * media_ts.FRAMES_PER_PES))
    assert stream.payload == payload and stream.continuity_errors == 0
    assert stream.timestamps == [media_ts.TICKS_PER_FRAME * media_ts.FRAMES_PER_PES * i for i in range(units)]
    assert [t for t, _ in stream.access_points] == stream.timestamps


def test_reader_starts_at_any_access_point():
    payload = media_ts.payload_of(bytes(R.randrange(256) for _ in range(90000)))
    media = media_ts.mux(payload)
    unit = media_ts.FRAME * media_ts.FRAMES_PER_PES
    points = media_ts.demux(media).access_points
    assert len(points) == 3
    for k, (ticks, offset) in enumerate(points):
        rest = media_ts.demux(media[offset:])
        assert rest.payload == payload[k * unit :] and rest.timestamps[0] == ticks and rest.continuity_errors == 0


def test_stream_damage_is_found():
    media = bytearray(media_ts.mux(media_ts.payload_of(b"x" * 100000)))
    lost = bytes(media[: 188 * 50] + media[188 * 51 :])
    assert media_ts.demux(lost).continuity_errors == 1
    with pytest.raises(ValueError):
        media_ts.demux(bytes(media[:-1]))
    media[20] ^= 1
    with pytest.raises(ValueError):
        media_ts.demux(bytes(media))


def test_damaged_streams_give_nulls(spark):
    good = media_ts.mux(media_ts.payload_of(b"x"))
    stored = spark.createDataFrame([(1, 1, None), (2, 1, b""), (3, 1, b"junk"), (4, 1, good[:-1]), (5, 1, good)], "doc_id long, n_bytes long, media binary")
    rows = {r.doc_id: r for r in media_ts.read_media(stored).collect()}
    assert [rows[i].feature for i in (1, 2, 3, 4)] == [None] * 4 and rows[5].payload_bytes == 576


@pytest.mark.parametrize("damage", ["lost", "doubled", "swapped", "tail"])
def test_lost_and_moved_packets_give_nulls(spark, damage):
    media = media_ts.mux(media_ts.payload_of(bytes(range(256)) * 200))
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    at = len(packets) // 2
    changed = {"lost": packets[:at] + packets[at + 1 :], "doubled": packets[:at] + packets[at - 1 :], "swapped": [*packets[:at], packets[at + 1], packets[at], *packets[at + 2 :]], "tail": packets[:-1]}[damage]
    stored = spark.createDataFrame([(1, 51200, b"".join(changed)), (2, 51200, media)], "doc_id long, n_bytes long, media binary")
    rows = {r.doc_id: r for r in media_ts.read_media(stored).collect()}
    assert rows[1].payload_sha256 is None and rows[1].feature is None and rows[2].payload_bytes == 51264


def test_feature_equals_plain_parse():
    """The feature of a stream from its packets one by one, without the module's reader."""
    for text in (b"", b"abc", bytes(range(200)) * 400):
        payload = media_ts.payload_of(text)
        media = media_ts.mux(payload)
        packets = [media[i : i + 188] for i in range(0, len(media), 188)]
        es = [p for p in packets if (p[1] & 0x1F) << 8 | p[2] == 0x100]
        data, stamps, access = b"", [], 0
        for p in es:
            body = p[5 + p[4] :] if p[3] & 0x20 else p[4:]
            access += bool(p[3] & 0x20 and p[4] and p[5] & 0x40)
            if p[1] & 0x40:
                s = body[9:14]
                stamps.append((s[0] >> 1 & 7) << 30 | s[1] << 22 | s[2] >> 1 << 15 | s[3] << 7 | s[4] >> 1)
                body = body[9 + body[8] :]
            data += body
        assert data == payload and [p[3] & 15 for p in es] == [i % 16 for i in range(len(es))]
        stream = media_ts.demux(media)
        assert (stream.timestamps, len(stream.access_points), stream.continuity_errors) == (stamps, access, 0)


def test_section_checksum():
    assert media_ts.section_crc(b"123456789") == 0x0376E6E7


def test_media_table(spark):
    docs = odd_docs(spark)
    rows = media_ts.read_media(media_ts.store_media(docs)).collect()
    want = []
    for d in docs.collect():
        payload = media_ts.payload_of((d.text or "").encode())
        want.append((str(d.doc_id), len((d.text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == sorted(want)
    by_payload = {}
    for r in rows:
        assert by_payload.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert media_ts.read_media(media_ts.store_media(spark.createDataFrame([], DOCS))).count() == 0


def test_registered_queries_have_contract_columns(spark):
    sf = "/root/testdata/sf0.001"
    columns = {"op7_token_codes": {"doc_id", "start", "n_tokens", "ids_crc32"}, "op10_byte_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}, "op8_media_ts": {"doc_id", "media_sha256", "feature"}}
    for name, wanted in columns.items():
        out = queries.QUERIES[name](spark, sf)
        assert wanted <= set(out.columns) and out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
