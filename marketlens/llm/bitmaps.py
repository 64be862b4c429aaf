"""Lookups of keys cut down by a bitmap of fixed size, before the join that decides.

A large table that is to be joined with some keys is first rid of most rows without one, so that they are not shuffled.
However many keys there are, the bitmap has ``BITS`` bits, 8 MB; with very many it lets everything pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.store import written

BITS = 1 << 26
_MAP = 1 << 15  # bits of one bitmap of Spark's bitmap functions


def _place(key: str) -> tuple[Column, Column]:
    """The bitmap of a key, and its bit there."""
    bit = F.pmod(F.col(key), F.lit(BITS))
    return F.shiftright(bit, 15).cast("int"), bit.bitwiseAND(_MAP - 1)


def bitmaps(keys: DataFrame, key: str) -> DataFrame:
    """(map, words): which of BITS residues the keys have; BITS // _MAP rows of 4 kB at most."""
    number, bit = _place(key)
    rows = keys.select(number.alias("map"), bit.alias("bit")).repartition(min(BITS // _MAP, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "map")
    bits = rows.groupBy("map").agg(F.bitmap_construct_agg("bit").alias("bits"))
    # numbers once a map, so that a lookup takes an item and need not cut and read bytes
    words = F.expr(f"transform(sequence(0, {_MAP // 64 - 1}), i -> cast(conv(hex(substring(bits, 8 * i + 1, 8)), 16, -10) as bigint))")
    return F.broadcast(written(bits.select("map", words.alias("words"))))


def likely(frame: DataFrame, key: str, maps: DataFrame, absent: bool = False) -> DataFrame:
    """The rows whose key may be among those of the bitmaps; with ``absent``, the others."""
    number, bit = _place(key)
    read = frame.withColumns({"map": number, "bit": bit}).join(maps, "map", "left" if absent else "inner")
    # the first of a word's eight bytes holds its highest bits
    held = F.expr(f"coalesce(getbit(words[cast(shiftright(bit, 6) as int)], cast(bit & 63 ^ 56 as int)), 0) = {0 if absent else 1}")
    return read.where(held).drop("map", "bit", "words")
