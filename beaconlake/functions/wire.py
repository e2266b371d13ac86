"""Column functions over binary packets.

Bytes are read from an array of numbers that is made once a packet; ``let`` binds such a value, so that no step of a fold computes it anew.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from beaconlake.functions import buffers
from beaconlake.session import ship_package

CRC_INIT, CRC_POLY = 0xFFFF, 0x1021


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def byte_values(data: Column) -> Column:
    """The bytes of a binary as array<int>, 0 to 255."""
    # the digits are cut in one pass, as a substring walks its string from the front
    digits = F.regexp_extract_all(F.hex(data), F.lit(".."), F.lit(0))
    return F.transform(digits, lambda x: F.conv(x, 16, 10).cast("int"))


def number_at(values: Column, at: Column | int, width: int) -> Column:
    """An unsigned little-endian number of ``width`` bytes at a 0-based place; null beyond the end."""
    at = F.lit(at) if isinstance(at, int) else at
    total = F.get(values, at).cast("long")
    for k in range(1, width):
        total = total + F.get(values, at + k).cast("long") * (1 << (8 * k))
    return total


def to_little_endian(value: Column, width: int) -> Column:
    """The number as ``width`` little-endian bytes, modulo their range."""
    parts = [F.unhex(F.lpad(F.hex(F.call_function("shiftright", value.cast("long"), F.lit(8 * k)).bitwiseAND(F.lit(255))), 2, "0")) for k in range(width)]
    return F.concat(*parts)


def _after_byte(high: int) -> int:
    """What the register becomes after eight steps with this byte on top and nothing below."""
    crc = high << 8
    for _ in range(8):
        crc = (crc << 1 ^ (CRC_POLY if crc & 0x8000 else 0)) & 0xFFFF
    return crc


def crc16(data: Column) -> Column:
    """CRC-16 (polynomial 0x1021, from all ones, not reflected) with built-in functions: a fold over the bytes with a table made from the rule."""
    table = F.array(*[F.lit(_after_byte(b)) for b in range(256)])

    def step(crc: Column, byte: Column) -> Column:
        top = F.call_function("shiftright", crc, F.lit(8)).bitwiseXOR(byte)
        return F.get(table, top).bitwiseXOR(crc.bitwiseAND(F.lit(255)) * 256)

    return let(byte_values(data), lambda values: F.aggregate(values, F.lit(CRC_INIT), step))


def _checksums(messages: pd.Series) -> pd.Series:
    data, offsets = buffers.buffer_of(pa.array(messages, pa.large_binary()))
    return pd.Series(buffers.crc16(data, offsets[:-1], offsets[1:])).where(messages.notna(), None).astype("Int32")


def checksum(data: Column) -> Column:
    """``crc16`` of whole batches in numpy; null for null."""
    ship_package(SparkSession.active())
    return F.pandas_udf(_checksums, IntegerType())(data)
