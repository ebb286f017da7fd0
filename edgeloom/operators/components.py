"""Connected components by alternating star contraction (large-star, small-star), O(log^2 n) rounds.

Each half round is one grouped minimum (with map-side partial aggregation) and one equi-join, so a node with very many
neighbours is never gathered in one task: Spark splits the skewed side of the join.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators import small
from edgeloom.operators.graph import Graph
from edgeloom.storage import Scratch

#: Links that a task contracts at once.
CHUNK = 1_000_000


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Edges run from the larger to the smaller end here."""
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    down = e.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def component_labels(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every end of a link that is not itself the least of its component.

    Nodes missing from the result are the least of theirs (or have no link), so callers left-join and coalesce.
    """
    scratch = Scratch(links.sparkSession)
    e = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()
    e, before = scratch.save(e), None
    while True:
        n = scratch.save(_small_star(_large_star(e)))
        scratch.drop(e)
        e = n
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == before or now[0] == 0:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now


def _forest(batches):
    """Links of a task, some at a time, as ``(a, b)``: node and least node of its component among these links."""
    held, size = [], 0

    def solved():
        u, v = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        g = small.Links.build(u, v)
        low = g.ids[g.components()]
        apart = low != g.ids
        return pa.RecordBatch.from_arrays([pa.array(g.ids[apart]), pa.array(low[apart])], names=["a", "b"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= CHUNK:
            yield solved()
            held, size = [], 0
    if held:
        yield solved()


def near_labels(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """As ``component_labels``, for long ids.  Links that lie together are contracted where they lie first; only what ties these
    parts to one another goes through rounds, so components that lie together need none."""
    scratch = Scratch(links.sparkSession)
    e = scratch.save(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").mapInArrow(_forest, "a long, b long"))
    both = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("b"), F.lit(False).alias("up")), F.struct(F.col("b").alias("node"), F.lit(None).cast("long").alias("b"), F.lit(True).alias("up")))
    ends = e.select(F.explode(both).alias("x")).select("x.*").groupBy("node").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.max("up").alias("up"))
    ends = scratch.save(ends)
    torn = ends.filter("low < high").select(F.col("node").alias("a"), "low")
    ties = e.join(torn, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    ties = scratch.save(ties.unionByName(ends.filter("up and low is not null").select(F.col("node").alias("a"), F.col("low").alias("b"))))
    scratch.drop(e)
    if ties.isEmpty():
        return ends.filter("low is not null").select("node", F.col("low").alias("component"))
    names = component_labels(ties).withColumnRenamed("node", "_name")
    named = ends.select("node", F.coalesce("low", "node").alias("_own")).join(names, F.col("_own") == F.col("_name"), "left")
    return named.select("node", F.coalesce("component", "_own").alias("component")).filter("node <> component")


def components(graph: Graph) -> DataFrame:
    """``(node, component)``: weakly connected, labelled by the least node id; isolated nodes label themselves."""
    scratch = Scratch(graph.edges.sparkSession)
    if graph.rows is not None:
        # repeated links change no component, so they need not be found
        graph = replace(graph, edges=graph.rows, rows=None)
    found, adj = small.links(graph, "out", scratch, nodes=True)
    if found:
        return small.component_rows(graph, found)
    if graph.base is not None:
        adj = scratch.save(adj)
    labels = near_labels(adj, "u", "v")
    if not graph.closed:
        nodes = graph.nodes.select(F.col("id").alias("node"))
        return nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    labels = scratch.save(labels)
    least = labels.select(F.col("component").alias("node")).distinct()
    loops = adj.filter("u = v").select(F.col("u").alias("node"))
    if not loops.isEmpty():
        least = least.unionByName(loops).distinct().join(labels, "node", "left_anti")
    return labels.unionByName(least.withColumn("component", F.col("node")))


def component_counts(graph: Graph) -> DataFrame:
    return components(graph).groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))
