"""Graph as two DataFrames: ``edges(src, dst, w)`` and ``nodes(id)``."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIRECTIONS = ("out", "in", "both")


def check_direction(direction: str) -> str:
    if direction not in DIRECTIONS:
        raise ValueError("direction must be out, in or both")
    return direction


def as_weight(column: Column) -> Column:
    """Weights are stored in single precision, summed in double; a missing weight is 1."""
    return F.coalesce(column.cast("float").cast("double"), F.lit(1.0))


@dataclass
class Graph:
    """Distinct directed edges with a node table.

    ``undirected`` graphs hold every edge in both orientations, so all three directions read the same edges.
    ``in_equals_out`` says the same of a directed graph whose table stores both orientations.  In a ``closed`` graph every
    node is an end of an edge; the tables of a ``fixed`` one (a snapshot) never change.  An overlaid graph knows its ``base``,
    the ``changed`` pairs whose edges of the base no longer count, and the ``added`` edges.  ``rows`` are the edges before
    repeats were dropped and before they were mirrored, where they lie as the table has them.
    """

    edges: DataFrame
    nodes: DataFrame
    directed: bool = True
    weighted: bool = False
    in_equals_out: bool = False
    checks: dict = field(default_factory=dict)
    closed: bool = False
    fixed: bool = False
    base: Graph | None = None
    changed: DataFrame | None = None
    added: DataFrame | None = None
    rows: DataFrame | None = None

    @classmethod
    def from_edges(cls, df: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = None, directed: bool = True, distinct: bool = False) -> Graph:
        """Rows with a null endpoint are dropped, repeated edges kept once with their least weight, self loops kept.  ``distinct``
        says that no directed edge is repeated, so repeats are not looked for.  Undirected edges are made distinct first and
        mirrored then, so the search for repeats holds each once."""
        w = as_weight(F.col(weight)) if weight else F.lit(1.0)
        raw = df.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"), w.alias("w")).dropna(subset=["src", "dst"])
        rows = raw
        if not directed:
            raw = raw.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w")
        if not (distinct and directed):
            raw = raw.groupBy("src", "dst").agg(F.min("w").alias("w")) if weight else raw.dropDuplicates(["src", "dst"])
        edges = raw if directed else mirrored(raw)
        return cls(edges, endpoints(edges), directed, bool(weight), not directed, closed=True, rows=rows)

    def leads_back(self, direction: str) -> bool:
        """Whether the adjacency holds the reverse of each of its links."""
        return direction == "both" or self.in_equals_out or not self.directed

    def adjacency(self, direction: str = "out") -> DataFrame:
        """``(u, v, w)``: from u one step leads to v."""
        check_direction(direction)
        out = self.edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), "w")
        if direction == "out" or self.leads_back("out"):
            return out
        back = self.edges.select(F.col("dst").alias("u"), F.col("src").alias("v"), "w")
        if direction == "in":
            return back
        return out.unionByName(back).groupBy("u", "v").agg(F.min("w").alias("w"))


def mirrored(edges: DataFrame) -> DataFrame:
    """Each edge in both orientations; a self loop once."""
    both = F.array(F.struct("src", "dst", "w"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    one = F.array(F.struct("src", "dst", "w"))
    return edges.select(F.explode(F.when(F.col("src") == F.col("dst"), one).otherwise(both)).alias("e")).select("e.*")


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def degrees(edges: DataFrame, side: str = "src") -> DataFrame:
    return edges.groupBy(F.col(side).alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def edge_checksum(edges: DataFrame, a: str = "src", b: str = "dst") -> Column:
    """Order-independent, combinable over partitions."""
    return F.bit_xor(F.xxhash64(a, b, "w"))


def is_symmetric(graph: Graph) -> bool:
    """A cheap hash comparison decides most cases; only equal hashes are proved by an anti join."""
    sums = graph.edges.agg(edge_checksum(graph.edges).alias("f"), edge_checksum(graph.edges, "dst", "src").alias("r")).first()
    if sums["f"] != sums["r"]:
        return False
    return asymmetric_edges(graph.edges).limit(1).count() == 0


def asymmetric_edges(edges: DataFrame) -> DataFrame:
    """Edges whose reverse, with the same weight, is missing."""
    swapped = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return edges.join(swapped, ["src", "dst", "w"], "left_anti")
