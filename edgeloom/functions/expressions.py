"""Column expressions shared by sources and operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The column by whose days a journal may be partitioned.
VERSION_DATE = "ver_date"
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def delete_flag(df: DataFrame, op: str | None) -> Column:
    """True for a delete: a true boolean, or a negative integer; null means add."""
    if op is None:
        return F.lit(False)
    kind = df.schema[op].dataType
    if isinstance(kind, T.BooleanType):
        return F.coalesce(F.col(op), F.lit(False))
    if isinstance(kind, INTEGRAL):
        return F.coalesce(F.col(op), F.lit(1)) < 0
    raise ValueError(f"column {op} must be BOOLEAN or INT")


def version_number(df: DataFrame, ver: str | None) -> Column:
    """Versions as one integer scale: microseconds since the epoch (UTC) for timestamps; null is 0."""
    if ver is None:
        return F.lit(0).cast("long")
    kind = df.schema[ver].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(F.unix_micros(F.col(ver).cast("timestamp")), F.lit(0).cast("long"))
    if isinstance(kind, INTEGRAL):
        return F.coalesce(F.col(ver).cast("long"), F.lit(0).cast("long"))
    raise ValueError(f"column {ver} must be TIMESTAMP, TIMESTAMPTZ or INT")


def newer_rows(df: DataFrame, ver: str, boundary: int) -> DataFrame:
    """Rows of a raw journal with a version above ``boundary``, as a condition on the column itself, so that the scan of the
    files can use it.  Null versions are 0.  A journal partitioned by version date is pruned to the days from the boundary's on,
    and one day before, as session time zones may differ."""
    c = F.col(ver)
    kind = df.schema[ver].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        at = F.timestamp_micros(F.lit(boundary))
        above = c > at.cast(kind)
        dated = [f for f in df.schema.fields if f.name == VERSION_DATE and isinstance(f.dataType, T.DateType)]
        if dated and boundary >= 0:
            above = above & (F.col(VERSION_DATE) >= F.date_sub(F.to_date(at), 1))
    else:
        above = c > F.lit(boundary)
    return df.filter(above | c.isNull() if boundary < 0 else above)


def is_timestamp(df: DataFrame, ver: str) -> bool:
    return isinstance(df.schema[ver].dataType, (T.TimestampType, T.TimestampNTZType))
