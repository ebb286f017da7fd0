"""Graphs written out for other programs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from edgeloom.operators.graph import Graph


def sorted_stream(df: DataFrame, *keys: str) -> DataFrame:
    """Rows in order over the partitions: each holds a range of the keys, sorted, so files read one after the other are one
    sorted stream and no task sorts all rows."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def export_csv(graph: Graph, path: str) -> None:
    """Two folders of CSV files with headers: ``edges`` (src, dst, and w of a weighted graph) and ``nodes`` (id), both in order."""
    cols = ["src", "dst", "w"] if graph.weighted else ["src", "dst"]
    sorted_stream(graph.edges.select(*cols), "src", "dst").write.option("header", True).csv(f"{path}/edges")
    sorted_stream(graph.nodes.select("id"), "id").write.option("header", True).csv(f"{path}/nodes")
