"""Keeping rows in place when only a few rows of a table are touched.

A decision table names rows by ``(id, hash of the text)``.  Joining it with the documents would move every text.  Instead a
bit map over hashed keys, of fixed size and so safe to broadcast, tells rows that are surely not named from those that may
be; only the latter are moved and joined exactly.  When the map fills up (some 10^8 named rows) more rows are moved, and the
results stay the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 8 MB at most, in pieces of 4 kB.
BITS = 1 << 26


def _place(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BITS)) + 1


def map_of(named: DataFrame, *keys: Column) -> DataFrame:
    """``(_piece, _map)``: the bit map of the keys."""
    return named.select(_place(*keys).alias("k")).groupBy(F.bitmap_bucket_number("k").alias("_piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("k")).alias("_map"))


def in_map(df: DataFrame, key: Column | tuple[Column, ...], bits: DataFrame) -> DataFrame:
    """``df`` with ``_maybe``: false where the map surely lacks the key."""
    d = df.withColumn("_k", _place(*(key if isinstance(key, tuple) else (key,)))).withColumn("_p", F.bitmap_bucket_number("_k"))
    d = d.join(F.broadcast(bits), F.col("_p") == F.col("_piece"), "left")
    at = F.bitmap_bit_position("_k")
    byte = F.conv(F.hex(F.substring("_map", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1, F.lit(False))
    return d.withColumn("_maybe", maybe).drop("_k", "_p", "_piece", "_map")


def split(docs: DataFrame, id_col: str, text_col: str, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sealed ``docs`` with ``_h``, the text's hash, as (rows that ``named(_id, _th)`` surely lacks, all others)."""
    d = docs.withColumn("_h", F.xxhash64(text_col))
    d = in_map(d, (F.col(id_col), F.col("_h")), map_of(named, F.col("_id"), F.col("_th")))
    return d.filter(~F.col("_maybe")).drop("_maybe"), d.filter("_maybe").drop("_maybe")


def without(docs: DataFrame, id_col: str, text_col: str, gone: DataFrame) -> DataFrame:
    """Rows of sealed ``docs`` that ``gone(_id, _th)`` does not name, with ``_h``."""
    free, held = split(docs, id_col, text_col, gone)
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_th"))
    return free.unionByName(held.join(gone.select("_id", "_th"), same, "left_anti"))
