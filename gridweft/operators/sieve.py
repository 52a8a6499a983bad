"""Rows thinned out before a join, by a broadcast bitmap of the keys that the other side has.

A join of a large table with few of its keys shuffles the large table whole. Here a key's hash names a bit; rows whose
bit is not set can't join and are left out where they are read. What passes is joined exactly afterwards. The bitmap has
16 bits a key, 32 MB at most; with more keys it lets more rows through, and results stay the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of keys that are sent whole instead.
FEW = 50_000
#: Bits of a row of the bitmap, and the most of such rows, by powers of two.
ROW_BITS, MOST_ROWS_BITS = 20, 8


def sieved(rows: DataFrame, keys: DataFrame, on: Sequence[str], count: int) -> DataFrame:
    """The rows that may have a key of the ``count`` rows of ``keys`` in the columns ``on``; all that have one are there."""
    if count <= FEW:
        return rows.join(F.broadcast(keys.select(*on)), list(on), "left_semi")
    rows_bits = min(MOST_ROWS_BITS, max(0, (16 * count - 1).bit_length() - ROW_BITS))
    bit = F.shiftrightunsigned(F.xxhash64(*on), 64 - ROW_BITS - rows_bits)
    part, word, at = F.shiftrightunsigned(bit, ROW_BITS), F.shiftrightunsigned(bit, 6).bitwiseAND((1 << (ROW_BITS - 6)) - 1), bit.bitwiseAND(63).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at"))
    said = keys.select(part.alias("part"), word.alias("word"), at.alias("at")).select("part", "word", one.alias("bits"))
    none = rows.sparkSession.range(1 << (ROW_BITS - 6 + rows_bits)).select(F.shiftright("id", ROW_BITS - 6).alias("part"), F.col("id").bitwiseAND((1 << (ROW_BITS - 6)) - 1).alias("word"), F.lit(0).cast("long").alias("bits"))
    words = said.unionByName(none).groupBy("part", "word").agg(F.bit_or("bits").alias("bits"))
    bitmap = words.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words")).withColumnRenamed("part", "_part")
    there = F.getbit(F.element_at("words", (word + 1).cast("int")), at) == 1
    return rows.join(F.broadcast(bitmap), (part == F.col("_part")) & there, "left_semi")
