"""Bloom filters as Spark bitmaps: pages of 32768 bits, made and asked by DataFrame operations only.

A filter is a small table (page, bitmap) that is broadcast. Its size has a fixed bound, `max_bits` / 8 bytes (16 MB by
default). With far more keys than bits more rows than needed seem to be in it; what uses a filter stays exact then and
moves more rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

PAGE = 32768
PROBES = 2
MAX_BITS = 1 << 27


def slots(key: str, bits: int, probes: int = PROBES) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), F.col(key)), F.lit(bits)) for i in range(probes)]


def bits_for(rows: int, max_bits: int = MAX_BITS) -> int:
    """16 bits a row, as a power of 2 within [PAGE, max_bits]."""
    bits = PAGE
    while bits < min(max_bits, 16 * rows):
        bits *= 2
    return bits


def pages(hit: DataFrame) -> DataFrame:
    """page, bitmap of the column `slot`, to be broadcast."""
    made = hit.select((F.col("slot") / PAGE).cast("int").alias("page"), F.pmod("slot", F.lit(PAGE)).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    return F.broadcast(materialise(made, "bitmaps"))


def _bit(bitmap: Column, slot: Column) -> Column:
    """1 if slot's bit is set. Bitmaps have no trailing zero bytes cut off, so the byte is always there."""
    at = F.pmod(slot, F.lit(PAGE))
    byte = F.conv(F.hex(F.substring(bitmap, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(at, F.lit(8)).cast("int"))


def with_maybe(rows: DataFrame, filter: DataFrame, key: str, bits: int, probes: int = PROBES) -> DataFrame:
    """rows with `maybe`: false where no key of the filter is this row's for certain."""
    probed, maybe = rows, F.lit(True)
    for i, slot in enumerate(slots(key, bits, probes)):
        page = filter.select(F.col("page").alias(f"__page{i}"), F.col("bitmap").alias(f"__bitmap{i}"))
        probed = probed.withColumn(f"__slot{i}", slot).join(page, (F.col(f"__slot{i}") / PAGE).cast("int") == F.col(f"__page{i}"), "left")
        maybe = maybe & F.coalesce(_bit(F.col(f"__bitmap{i}"), F.col(f"__slot{i}")) == 1, F.lit(False))
    return probed.select(*[rows[c] for c in rows.columns], maybe.alias("maybe"))


def split_by(rows: DataFrame, few: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """rows whose key may be among those of `few`, and the rows whose key is not. A join need only move the former."""
    bits = bits_for(few.count())
    found = few.select(F.explode(F.array(*slots(key, bits))).alias("slot"))
    probed = with_maybe(rows, pages(found), key, bits)
    return probed.filter("maybe").drop("maybe"), probed.filter(~F.col("maybe")).drop("maybe")
