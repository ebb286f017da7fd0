"""Links of a large graph, laid out once so that no level or round of a search shuffles them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.graph import Graph
from edgeloom.storage import Scratch

#: Links of one node in one slice.
HUB = 1_000_000


class Plain:
    """A small adjacency as it is: Spark broadcasts it, or moves little."""

    def __init__(self, adj: DataFrame):
        self.links = adj

    def step(self, front: DataFrame) -> DataFrame:
        return front.join(self.links, front["node"] == self.links["u"])

    def drop(self) -> None:
        pass


def laid_out(adj: DataFrame, scratch: Scratch, small: int) -> Plain | Layout:
    return Plain(adj) if adj.count() <= small else Layout(adj, scratch)


class Overlaid:
    """The layout of a snapshot with later changes: its links are read where they lie, those of changed pairs are taken out of
    what a frontier reaches, and the added links are joined as they are."""

    def __init__(self, base: Layout, changed: DataFrame, added: DataFrame):
        self.base, self.changed, self.added = base, changed, added

    def step(self, front: DataFrame) -> DataFrame:
        old = self.base.step(front)
        old = old.join(self.changed, (old["u"] == self.changed["cu"]) & (old["v"] == self.changed["cv"]), "left_anti")
        return old.unionByName(front.join(self.added, front["node"] == self.added["u"]))

    def drop(self) -> None:
        pass


def layout_of(graph: Graph, direction: str, adj: DataFrame, scratch: Scratch) -> Layout | Overlaid:
    """The links ``(u, v)`` of a large graph.  Those of a snapshot are laid out once and kept with it, so later searches write no
    link, and an overlay reads the layout of its snapshot; other graphs are laid out for one search."""
    if graph.fixed:
        key = ("layout", direction)
        if key not in graph.checks:
            kept = Layout(adj.select("u", "v"), Scratch(scratch.spark))
            kept.keep = True
            graph.checks[key] = kept
        return graph.checks[key]
    if graph.base is not None and graph.base.fixed and (direction != "both" or graph.leads_back(direction)):
        turned = direction == "in" and not graph.leads_back("out")
        u, v = ("dst", "src") if turned else ("src", "dst")
        changed = scratch.save(graph.changed.select(F.col(u).alias("cu"), F.col(v).alias("cv")))
        added = scratch.save(graph.added.select(F.col(u).alias("u"), F.col(v).alias("v")))
        base = layout_of(graph.base, direction, graph.base.adjacency(direction), scratch)
        return Overlaid(base, changed, added)
    return Layout(scratch.save(adj) if graph.base is not None else adj, scratch)


def drop_layouts(graph: Graph) -> None:
    """Deletes the layouts kept with a snapshot."""
    for key in [k for k in graph.checks if k[0] == "layout"]:
        kept = graph.checks.pop(key)
        kept.keep = False
        kept.drop()


class Layout:
    """Rows ``(u, slice, ...)`` in buckets of node and slice.  The links of a node with more than ``hub`` of them are cut into
    slices, which fall into different buckets; there are at most links / hub such nodes."""

    def __init__(self, adj: DataFrame, scratch: Scratch, hub: int = HUB):
        self.scratch = scratch
        big = adj.groupBy("u").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hub)
        self.hubs = scratch.save(big.select(F.col("u").alias("_hub"), F.ceil(F.col("_n") / hub).cast("int").alias("_slices")))
        self.sliced = not self.hubs.isEmpty()
        if self.sliced:
            adj = adj.join(self.hubs, F.col("u") == F.col("_hub"), "left").withColumn("slice", F.pmod(F.xxhash64("v"), F.coalesce("_slices", F.lit(1))).cast("int")).drop("_hub", "_slices")
        else:
            adj = adj.withColumn("slice", F.lit(0))
        self.links = scratch.bucketed(adj, "u", "slice")

    def step(self, front: DataFrame) -> DataFrame:
        """``front`` with the links of its ``node``; only ``front`` is moved."""
        one = F.lit(0)
        if self.sliced:
            front = front.join(self.hubs, F.col("node") == F.col("_hub"), "left").withColumn("_slice", F.explode(F.sequence(one, F.coalesce("_slices", F.lit(1)) - 1))).drop("_hub", "_slices")
        else:
            front = front.withColumn("_slice", one)
        return front.join(self.links, (front["node"] == self.links["u"]) & (front["_slice"] == self.links["slice"])).drop("_slice", "slice")

    keep = False

    def drop(self) -> None:
        if not self.keep:
            self.scratch.drop(self.links, self.hubs)
