"""Insert-only edge journals: normal form, latest version wins, overlay on a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.functions.expressions import delete_flag, version_number
from edgeloom.operators.graph import Graph, as_weight, endpoints, mirrored


def normalise_journal(df: DataFrame, src: str, dst: str, op: str | None = None, weight: str | None = None, ver: str | None = None, directed: bool = True, strict: bool = False) -> DataFrame:
    """``(src, dst, del, w, ver)``.  Rows with a null endpoint are dropped (``strict``: refused).

    Undirected edges are turned to (least, greatest) first, so a delete written the other way round meets its edge.
    """
    raw = df.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"), delete_flag(df, op).alias("del"), (as_weight(F.col(weight)) if weight else F.lit(1.0)).alias("w"), version_number(df, ver).alias("ver"))
    if strict and raw.filter("src is not null and dst is null").limit(1).count():
        raise ValueError("an edge row has no dst")
    raw = raw.dropna(subset=["src", "dst"])
    if not directed:
        raw = raw.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "del", "w", "ver")
    return raw


def latest_wins(journal: DataFrame) -> DataFrame:
    """The last version of every edge; on an exact tie a delete wins, then the larger weight.  One aggregation, no window."""
    last = journal.groupBy("src", "dst").agg(F.max(F.struct("ver", "del", "w")).alias("m"))
    return last.select("src", "dst", "m.del", "m.w", "m.ver")


def latest_wins_ranked(journal: DataFrame) -> DataFrame:
    """The same by ROW_NUMBER, kept to cross-check ``latest_wins``."""
    w = Window.partitionBy("src", "dst").orderBy(F.desc("ver"), F.desc("del"), F.desc("w"))
    return journal.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def consolidate(journal: DataFrame, has_op: bool, has_weight: bool, has_ver: bool) -> DataFrame:
    """Live edges ``(src, dst, w)``, one of three plans.

    Without an op column or version nothing is ever deleted and repeated rows collapse.  With weights, the latest version
    decides.  Without weights only edges that were ever deleted need ranking; all others are plain distinct adds.
    """
    if not has_ver:
        return journal.groupBy("src", "dst").agg(F.min("w").alias("w"))
    if has_weight or not has_op:
        return latest_wins(journal).filter("not del").select("src", "dst", "w")
    gone = journal.filter("del").select("src", "dst").distinct()
    dead = latest_wins(journal.join(gone, ["src", "dst"], "left_semi")).filter("del")
    adds = journal.filter("not del").select("src", "dst").distinct()
    return adds.join(dead.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("w", F.lit(1.0))


def overlay(base: Graph, delta: DataFrame) -> Graph:
    """The snapshot with later journal rows applied.

    Latest version wins for every edge the delta names.  Nodes: those of the snapshot and the ends of every added row, even
    if a later row deletes the edge again; a delete of an unknown edge makes no node.
    """
    last = latest_wins(delta)
    changed, live = last.select("src", "dst"), last.filter("not del").select("src", "dst", "w")
    if not base.directed:
        changed = mirrored(changed.withColumn("w", F.lit(1.0))).select("src", "dst")
        live = mirrored(live)
    edges = base.edges.join(changed, ["src", "dst"], "left_anti").unionByName(live)
    nodes = base.nodes.unionByName(endpoints(delta.filter("not del"))).distinct()
    return Graph(edges, nodes, base.directed, base.weighted, not base.directed, base=base, changed=changed, added=live)


def delta_view(journal: DataFrame, boundary: int | None, snapshot_id: int) -> DataFrame:
    """The eight-column relation: rows newer than the boundary and one sentinel row, all null but the snapshot id."""
    long = lambda x=None: F.lit(x).cast("long")
    rows = journal if boundary is None else journal.filter(F.col("ver") > F.lit(boundary))
    cols = [long().alias("start"), long().alias("target"), "src", "dst", "del", F.col("w").alias("weight"), "ver", long(snapshot_id).alias("snapshot_id")]
    sentinel = journal.sparkSession.range(1).select(long().alias("start"), long().alias("target"), long().alias("src"), long().alias("dst"), F.lit(None).cast("boolean").alias("del"), F.lit(None).cast("double").alias("weight"), long().alias("ver"), long(snapshot_id).alias("snapshot_id"))
    return rows.select(*cols).unionByName(sentinel)


def classify(view: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edge rows ``(src, dst, del, w, ver)`` and request rows ``(start, target)`` of an eight-column relation."""
    if view.filter("src is not null and dst is null").limit(1).count():
        raise ValueError("an edge row has no dst")
    edges = view.filter("src is not null").select("src", "dst", F.coalesce("del", F.lit(False)).alias("del"), as_weight(F.col("weight")).alias("w"), F.coalesce("ver", F.lit(0)).cast("long").alias("ver"))
    return edges, view.filter("src is null and start is not null").select("start", "target")


def inline_graph(view: DataFrame, directed: bool = True) -> tuple[Graph, DataFrame]:
    """A graph without registration: edges and requests in one relation; any weight turns weights on."""
    edges, requests = classify(view)
    if edges.filter("del").limit(1).count():
        raise ValueError("deleted edges need a snapshot")
    weighted = view.filter("src is not null and weight is not null").limit(1).count() > 0
    return Graph.from_edges(edges, weight="w" if weighted else None, directed=directed), requests
