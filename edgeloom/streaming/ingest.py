"""Structured Streaming into an edge journal, and refreshes driven by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from edgeloom.engine import GraphEngine
from edgeloom.functions.expressions import VERSION_DATE


def append_journal(stream: DataFrame, path: str, checkpoint: str, version: str | None = None, **trigger) -> StreamingQuery:
    """Appends a stream of edge rows to a Parquet journal; with ``version`` it is partitioned by the version's UTC date, so
    reads of recent rows prune to a few folders.  The sink is exactly-once through the checkpoint."""
    rows = stream
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    if version:
        rows = stream.withColumn(VERSION_DATE, F.to_date(version))
        writer = rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).partitionBy(VERSION_DATE)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def refresh_on_stream(stream: DataFrame, engine: GraphEngine, graph: str, checkpoint: str, min_delta_rows: int = 1, **trigger) -> StreamingQuery:
    """Refreshes a graph when a micro-batch arrives and its delta holds at least ``min_delta_rows`` rows."""

    def act(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty() and engine.status(graph).first()["delta_rows"] >= min_delta_rows:
            engine.refresh_graph(graph)

    return stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
