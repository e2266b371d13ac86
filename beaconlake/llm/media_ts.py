"""Media columns as MPEG transport streams.

``mux`` stores a payload of 8-bit samples as a transport stream of packetised elementary packets of at most ``FRAMES_PER_PES`` frames of 576 samples. Before
each stand a program association table and a program map table, and its first transport packet carries a presentation timestamp, a clock reference and the random-access
mark, so that a reader can start at any access point (``demux`` of the bytes from there on). Clock references are as far apart as elementary packets, 4.6 seconds: the
streams are for storage, not for broadcast. ``demux`` reads a stream back from its bytes
alone: it parses and checks the program tables, follows the continuity counters, reassembles the elementary packets, and lists timestamps
and random-access points. ``store_media`` writes the streams as a binary column with their timestamps and access points;
``read_media`` recomputes everything from the stored bytes.

Payload of a text: its UTF-8 bytes and then bytes 255 up to a positive multiple of 576. Defined results: a null or empty text is one
frame of 255; equal texts give equal streams, as nothing else goes into them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from beaconlake.session import ship_package

from .chunks import sliced
from .scratch import written

FRAME = 576
FRAMES_PER_PES = 64
TICKS_PER_FRAME = 6480  # 576 samples at 8 kHz, in ticks of the 90 kHz clock
# Fixed values of the transport stream format.
PACKET, SYNC, NULL_PID, PAT_PID = 188, 0x47, 0x1FFF, 0x0000
PMT_PID, ES_PID, PROGRAM, PRIVATE_DATA, STREAM_ID = 0x1000, 0x0100, 1, 0x06, 0xBD


def payload_of(text: bytes) -> bytes:
    return text + b"\xff" * (max(1, -(-len(text) // FRAME)) * FRAME - len(text))


def section_crc(data: bytes) -> int:
    """CRC-32 of program tables: polynomial 0x04C11DB7, from all ones, not reflected."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def _section_packet(pid: int, table_id: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + PROGRAM.to_bytes(2, "big") + b"\xc1\x00\x00"
    section = head + body
    section += section_crc(section).to_bytes(4, "big")
    packet = bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section
    return packet + b"\xff" * (PACKET - len(packet))


TABLES = _section_packet(PAT_PID, 0x00, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")) + _section_packet(
    PMT_PID, 0x02, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"
)


def _stamp(ticks: int) -> bytes:
    """A 33-bit presentation timestamp with its marker bits."""
    t = ticks & (1 << 33) - 1
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1])


def _clock(ticks: int) -> bytes:
    """Adaptation field with the random-access mark and a clock reference."""
    base = ticks & (1 << 33) - 1
    return b"\x07\x50" + (base << 15 | 0x7E00).to_bytes(6, "big")


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload whose length is a positive multiple of 576."""
    out, counter = [], 0
    for nth, first in enumerate(range(0, len(payload), FRAME * FRAMES_PER_PES)):
        tables = bytearray(TABLES)
        tables[3] = tables[PACKET + 3] = 0x10 | nth & 15
        out.append(bytes(tables))
        data = payload[first : first + FRAME * FRAMES_PER_PES]
        ticks = first // FRAME * TICKS_PER_FRAME
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(ticks) + data
        rest = max(0, len(pes) - 176)
        full, tail = divmod(rest, PACKET - 4)
        n = 1 + full + (tail > 0)
        packets = np.empty((n, PACKET), np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
        packets[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter += n
        bytes_of = np.frombuffer(pes, np.uint8)
        packets[0, 1] |= 0x40
        packets[0, 3] |= 0x20
        packets[0, 4:12] = np.frombuffer(_clock(ticks), np.uint8)
        packets[0, 12:] = bytes_of[:176]
        packets[1 : 1 + full, 4:] = bytes_of[176 : 176 + full * 184].reshape(full, 184)
        if tail:
            gap = 184 - tail  # at least 1: a length byte, then flags, then stuffing
            packets[n - 1, 3] |= 0x20
            packets[n - 1, 4] = gap - 1
            if gap > 1:
                packets[n - 1, 5] = 0
                packets[n - 1, 6 : 4 + gap] = 255
            packets[n - 1, 4 + gap :] = bytes_of[176 + full * 184 :]
        out.append(packets.tobytes())
    return b"".join(out)


@dataclass
class Stream:
    """What ``demux`` finds: the payload, a timestamp an elementary packet, access points as (timestamp, byte offset of its program tables), and errors."""

    payload: bytes
    timestamps: list[int] = field(default_factory=list)
    access_points: list[tuple[int, int]] = field(default_factory=list)
    continuity_errors: int = 0
    broken_packets: int = 0  # elementary packets that aren't as long as they say


def _section(packets: np.ndarray, pid: int, table_id: int, pids: np.ndarray) -> bytes:
    """The body of a program table, its checksum verified."""
    found = packets[pids == pid]
    if not len(found):
        raise ValueError(f"no table on pid {pid}")
    packet = found[0].tobytes()
    at = 5 + packet[4]
    length = (packet[at + 1] & 0x0F) << 8 | packet[at + 2]
    section = packet[at : at + 3 + length]
    if len(section) < 12 or section[0] != table_id or _checked(section[:-4]) != int.from_bytes(section[-4:], "big"):
        raise ValueError(f"damaged table on pid {pid}")
    return section[8:-4]


_crcs: dict[bytes, int] = {}


def _checked(section: bytes) -> int:
    if section not in _crcs:
        if len(_crcs) > 256:
            _crcs.clear()
        _crcs[section] = section_crc(section)
    return _crcs[section]


def demux(media: bytes) -> Stream:
    """Read the first elementary stream of the first program."""
    if not media or len(media) % PACKET:
        raise ValueError("not a whole number of transport packets")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("lost synchronisation")
    pids = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    programs = _section(packets, PAT_PID, 0x00, pids)
    pmt = int.from_bytes(programs[2:4], "big") & 0x1FFF
    streams = _section(packets, pmt, 0x02, pids)
    skip = 4 + (int.from_bytes(streams[2:4], "big") & 0x0FFF)
    es = int.from_bytes(streams[skip + 1 : skip + 3], "big") & 0x1FFF

    at = np.flatnonzero(pids == es)
    own = packets[at]
    control = own[:, 3]
    adapted, loaded = (control & 0x20) > 0, (control & 0x10) > 0
    counters = control & 15
    errors = int(((counters[1:].astype(np.int16) - counters[:-1] - loaded[1:]) % 16 != 0).sum())
    first = 4 + np.where(adapted, own[:, 4].astype(np.int32) + 1, 0)
    data = own[np.arange(PACKET)[None, :] >= first[:, None]].tobytes()
    ends = np.cumsum(PACKET - first)
    begins = np.flatnonzero(own[:, 1] & 0x40)
    if not len(begins):
        raise ValueError("no elementary stream")
    cuts = [0 if b == 0 else int(ends[b - 1]) for b in begins] + [len(data)]
    stream, parts = Stream(b"", continuity_errors=errors), []
    for k, b in enumerate(begins.tolist()):
        pes = data[cuts[k] : cuts[k + 1]]
        if pes[:3] != b"\x00\x00\x01" or len(pes) < 14:
            raise ValueError("no elementary packet where one begins")
        s = pes[9:14]
        ticks = (s[0] & 0x0E) << 29 | s[1] << 22 | (s[2] & 0xFE) << 14 | s[3] << 7 | s[4] >> 1
        stream.timestamps.append(ticks)
        if adapted[b] and own[b, 4] and own[b, 5] & 0x40:
            place = int(at[b])
            has_tables = place >= 2 and pids[place - 2] == PAT_PID and pids[place - 1] == pmt
            stream.access_points.append((ticks, (place - 2 * has_tables) * PACKET))
        length = 6 + int.from_bytes(pes[4:6], "big")
        stream.broken_packets += len(pes) != length
        parts.append(pes[9 + pes[8] : length])
    stream.payload = b"".join(parts)
    return stream


def store_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``doc_id, n_bytes, media, timestamps, access_offsets`` for every row and return the table."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, rows=512):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            media = [mux(payload_of(t)) for t in texts]
            found = [demux(m) for m in media]
            yield pa.record_batch(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary()), pa.array([s.timestamps for s in found], pa.list_(pa.int64())), pa.array([[o for _, o in s.access_points] for s in found], pa.list_(pa.int64()))],
                ["doc_id", "n_bytes", "media", "timestamps", "access_offsets"],
            )

    named = docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"`{text}` as text")
    return written(named.mapInArrow(run, "doc_id long, n_bytes long, media binary, timestamps array<long>, access_offsets array<long>"), "media")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_media(stored: DataFrame) -> DataFrame:
    """Digests and features of every stored stream, computed from the bytes read back (columns of FEATURES).

    Of a null or damaged stream all of them are null: one that can't be parsed, whose counters don't follow each other, or of whose elementary packets one isn't as long as it says,
    as where a transport packet was lost, doubled or moved.
    """
    ship_package(stored.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, rows=512):
            columns: list[list] = [[] for _ in range(6)]
            for media in batch.column(2).to_pylist():
                try:
                    stream = demux(media or b"")
                    if stream.continuity_errors or stream.broken_packets:
                        raise ValueError("lost, doubled or moved packets")
                except ValueError:
                    for column in columns:
                        column.append(None)
                    continue
                samples = np.frombuffer(stream.payload, np.uint8)
                feature = (
                    f"frames={len(samples) // FRAME};packets={len(media) // PACKET};access_points={len(stream.access_points)};"
                    f"last_pts={stream.timestamps[-1]};continuity_errors={stream.continuity_errors};"
                    f"mean={int(samples.sum(dtype=np.int64)) // len(samples)};peak={int(samples[samples < 255].max(initial=0))}"
                )
                values = (len(samples), hashlib.sha256(stream.payload).hexdigest(), zlib.crc32(stream.payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature)
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [c.strip().split()[0] for c in FEATURES.split(",")]
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)
