"""What the text operators share.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; on UTF-8 bytes that is what ``bytes.split()`` yields, and
``bytes.lower()`` lower-cases A-Z only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def text_bytes(column: str) -> Column:
    """The text as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(bytearray()))


def word_count(column: Column) -> Column:
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def fold(column: Column, modulus: int) -> Column:
    """crc32 of an id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(dict of columns as Python lists) -> list of tuples`` for each Arrow batch, in batches of bounded bytes."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in fn(batches):
            if rows:
                yield record_batch(rows, kind)

    return df.mapInArrow(run, schema)


def record_batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), kind)], schema=kind)


def sealed(df: DataFrame) -> DataFrame:
    """The columns under the names u0, u1, ..., which no operator uses for its own, so any name and any repeated name may come in."""
    return df.toDF(*(f"u{i}" for i in range(len(df.columns))))


def seal(df: DataFrame, name: str) -> str:
    """A column's name in ``sealed(df)``."""
    return f"u{df.columns.index(name)}"


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as make it new to ``df``."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def field_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()
