"""A bitmap of fixed size over ids, to hold most rows back before a join; false hits only cost work."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 25
#: Bits in a row of a bitmap's table.
_ROW = 32768


def spot(column: str | Column, bits: int = BITS) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(bits)).cast("long")


def table(ids: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """k, bits: the rows of a column's bitmap, ``bits`` / 8 bytes in all."""
    return ids.select((spot(column, bits) + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))


def build(ids: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """The packed bitmap of a column's values; what reaches the driver is at most ``bits`` / 8 bytes."""
    out = np.zeros(bits // 8, np.uint8)
    for k, row in table(ids, column, bits).collect():
        out[(k - 1) * _ROW // 8 : k * _ROW // 8] = np.frombuffer(bytes(row), np.uint8)
    return out


def hit(packed: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """Whether each spot is set."""
    return (packed[spots >> 3] >> (spots & 7).astype(np.uint8) & 1).astype(bool)


def parted(rows: DataFrame, column: str, ids: DataFrame, of: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``column`` is (but for false hits) among the ids, and the others; in the JVM, by a broadcast of BITS / 8 bytes."""
    at = F.pmod(F.col("p"), F.lit(_ROW))
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.select(F.struct(*[rows[c] for c in rows.columns]).alias("row"), spot(rows[column]).alias("p")).join(
        F.broadcast(table(ids, of)), (F.col("p") / _ROW).cast("long") + 1 == F.col("k"), "left"
    )
    held = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, CAST(pmod(p, 8) AS INT))")) != 0, F.lit(False))
    back = [F.col("row")[c].alias(c) for c in rows.columns]
    return met.filter(held).select(*back), met.filter(~held).select(*back)
