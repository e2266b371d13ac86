"""Binary columns as one buffer in numpy: numbers at computed places, and checksums as a linear map."""

from __future__ import annotations

import binascii
from functools import cache

import numpy as np
import pyarrow as pa

#: Longer messages are left to the library's loop, as a table of places would outgrow them.
LONGEST = 1024


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of binaries; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def numbers(data: np.ndarray, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
    """Unsigned little-endian numbers of ``width`` bytes (4 at most) at the places; what is beyond the buffer is 0."""
    out = np.zeros(len(at), np.int64)
    if len(data) and len(at):
        for k in range(4):
            inside = (k < np.asarray(width)) & (at + k < len(data))
            out += np.where(inside, data[np.where(inside, at + k, 0)].astype(np.int64) << (8 * k), 0)
    return out


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """What each byte adds to the checksum with k bytes behind it (k, byte), and what the start value has become after n bytes."""
    table = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        table = np.where(table & 0x8000, table << 1 ^ 0x1021, table << 1) & 0xFFFF
    places, starts = [table], [np.uint32(0xFFFF)]
    for _ in range(LONGEST - 1):
        places.append((places[-1] << 8 & 0xFFFF) ^ table[places[-1] >> 8])
    for _ in range(LONGEST):
        starts.append((starts[-1] << 8 & 0xFFFF) ^ table[starts[-1] >> 8])
    return np.array(places, np.uint16), np.array(starts, np.uint16)


def crc16(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """CRC-16 (polynomial 0x1021, from all ones, not reflected) of the slices of a buffer.

    The register is a linear map of its bits, so a message's checksum is the XOR of what its bytes add at their places: one look-up a byte for all messages at once.
    """
    places, starts = _tables()
    size = stop - start
    out = starts[np.minimum(np.maximum(size, 0), LONGEST)].astype(np.int64)
    some = np.flatnonzero((size > 0) & (size <= LONGEST))
    if len(some):
        n = size[some]
        first = np.cumsum(n) - n
        inside = np.arange(int(n.sum())) - np.repeat(first, n)
        added = places[np.repeat(n, n) - 1 - inside, data[np.repeat(start[some], n) + inside]]
        out[some] ^= np.bitwise_xor.reduceat(added, first)
    for i in np.flatnonzero(size > LONGEST):
        out[i] = binascii.crc_hqx(data[start[i] : stop[i]].tobytes(), 0xFFFF)
    return out
