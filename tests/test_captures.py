"""Captures scanned in splits against one scan from the first byte to the last."""

import binascii
import datetime
import random

from beaconlake.sources import frames
from beaconlake.sources.frames import CHUNKS, HEADER, SYNC, ingest_frames, scan

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def frame(sequence, payload, version=1, damaged=False):
    body = HEADER.pack(version, 1, sequence & 0xFFFF, sequence, len(payload)) + payload
    return SYNC + body + ((binascii.crc_hqx(body, 0xFFFF) ^ damaged).to_bytes(2, "little"))


def made(seed, size, longest=60):
    """Frames with sync bytes and whole frames inside payloads, damaged ones, unknown versions, noise, and lengths that reach far beyond."""
    r = random.Random(seed)
    out = b""
    while len(out) < size:
        kind = r.random()
        payload = r.choice([bytes(r.choices(range(256), k=r.randint(0, longest))), SYNC * r.randint(1, 9), frame(r.randint(0, 9), b"inner" * r.randint(0, 3)) * r.randint(1, 2), b"\xaa" * r.randint(1, 30)])
        if kind < 0.75:
            out += frame(len(out), payload)
        elif kind < 0.85:
            out += frame(len(out), payload, damaged=True)
        elif kind < 0.9:
            out += frame(len(out), payload, version=r.randint(2, 255))
        elif kind < 0.97:
            out += bytes(r.choices([0xAA, 0x55, 1, 0], k=r.randint(1, 12)))
        else:
            out += SYNC + HEADER.pack(1, 1, 0, 0, r.randint(0, 3 * longest))  # the length is wrong and hides what follows
    return out


def chunked(data, seed, most):
    r, at, out = random.Random(seed), 0, []
    while at < len(data):
        n = r.randint(0, most)
        out.append(data[at : at + n])
        at += n
    return out


def one_scan(chunks):
    """(frame_no, chunk_no, status, sequence, payload) by a scan that takes chunk after chunk."""
    rest, out = b"", []
    for i, data in enumerate(chunks):
        found, rest = scan(rest + (data or b""))
        out += [(i, f.status, f.sequence_num, f.payload) for f in found]
    if rest:
        out.append((len(chunks) - 1, "truncated", None, rest))
    return [(n + 1, *x) for n, x in enumerate(out)]


def decoded(spark, captures, split_bytes):
    rows = [(d, c, i, T0 + datetime.timedelta(seconds=i), data) for (d, c), chunks in captures.items() for i, data in enumerate(chunks)]
    random.Random(0).shuffle(rows)
    table = spark.createDataFrame(rows, CHUNKS).repartition(4)
    got = {key: [] for key in captures}
    for r in ingest_frames(table, split_bytes).collect():
        assert r.arrival_ts.replace(tzinfo=datetime.UTC) == T0 + datetime.timedelta(seconds=r.chunk_no)
        got[(r.device_id, r.capture_id)].append((r.frame_no, r.chunk_no, r.status, r.sequence_num, None if r.payload is None else bytes(r.payload)))
    return {k: sorted(x) for k, x in got.items()}


def test_64_splits_equal_one_scan(spark):
    captures = {(None, "x"): chunked(made(73, 700), 1, 700), ("e", "whole"): [made(2, 6400)]}
    for seed in (1, 2, 3):
        captures |= {("d", f"long{seed}"): chunked(made(seed, 6400), seed, 90), ("d", f"short{seed}"): chunked(made(seed + 50, 150), seed, 40)}
    want = {k: one_scan(x) for k, x in captures.items()}
    assert {x[2] for x in want[("d", "long1")]} >= {"ok", "crc", "version"}
    assert decoded(spark, captures, 100) == want
    assert decoded(spark, captures, frames.SPLIT) == want


def test_a_frame_over_many_splits(spark):
    """A frame of the greatest length hides frames in its payload from every split in it."""
    inner = (frame(7, b"hidden" * 5) * 2000)[:65535]
    data = frame(1, b"a") + frame(2, inner) + frame(3, b"b") + frame(4, b"c" * 50)
    captures = {("d", "c"): chunked(data, 3, 5000)}
    want = one_scan(captures[("d", "c")])
    assert [x[3] for x in want] == [1, 2, 3, 4]
    assert decoded(spark, captures, 1024)[("d", "c")] == want


def test_guesses_are_mended(spark):
    """Sync bytes before each border begin false frames that reach over it, so that many splits are scanned again."""
    false = SYNC + HEADER.pack(1, 1, 0, 0, 60)
    data = b"".join(frame(i, false * 3 + bytes(10)) for i in range(200))
    captures = {("d", "c"): chunked(data, 5, 64)}
    assert decoded(spark, captures, 61)[("d", "c")] == one_scan(captures[("d", "c")])


def test_ends_of_captures(spark):
    tails = [b"", b"\xaa", SYNC, SYNC + b"\x01\x01", frame(9, b"cut off")[:-1], b"\xaa\xaa", frame(9, b"x") + b"\xaa"]
    data = b"".join(frame(i, b"p" * (i % 7)) for i in range(20))
    captures = {("d", f"c{i}"): [*chunked(data + tail, 2, 30), b"", None] for i, tail in enumerate(tails)}
    want = {k: one_scan(x) for k, x in captures.items()}
    for split in (40, len(data), len(data) + 1, 1 << 20):
        assert decoded(spark, captures, split) == want


def test_no_bytes(spark):
    assert decoded(spark, {("d", "c"): [b"", None]}, 10) == {("d", "c"): []}
    assert ingest_frames(spark.createDataFrame([], CHUNKS)).count() == 0
