"""PageRank by power iteration with uniform redistribution of dangling mass."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators import small
from edgeloom.operators.blocks import LINKS, Blocks
from edgeloom.operators.graph import Graph
from edgeloom.operators.khop import check_threads
from edgeloom.operators.layout import HUB
from edgeloom.storage import Scratch


def pagerank(graph: Graph, iterations: int = 20, damping: float = 0.85, top: int = 0, threads: int | None = None, hub: int = HUB) -> DataFrame:
    """``(node, rank)``; ``top`` keeps the best ranks, equal ranks by node id.

    Links are laid out once as arrays of blocks of nodes, so a round moves arrays of shares and partial sums but never the links.
    Links of a block with far more than ``hub`` of them are cut into slices, each of which is sent the block's shares.
    Only the dangling mass of a round goes to the driver.
    """
    if top < 0:
        raise ValueError("top must not be negative")
    if not 1 <= iterations <= 1000:
        raise ValueError("iterations must be between 1 and 1000")
    if math.isnan(damping) or not 0 <= damping <= 1:
        raise ValueError("damping must be between 0 and 1")
    check_threads(threads)
    spark = graph.edges.sparkSession
    scratch = Scratch(spark)
    found, adj = small.links(graph, "out", scratch, nodes=True)
    if found:
        return best(small.rank_rows(graph, found, iterations, damping), top)
    if graph.base is not None:
        adj = scratch.save(adj)
    nodes = adj.select(F.explode(F.array("u", "v")).alias("id")).distinct() if graph.closed else graph.nodes
    held = Blocks(adj, nodes, scratch, min(hub, LINKS))
    if not held.n:
        return graph.nodes.select(F.col("id").alias("node"), F.lit(0.0).alias("rank")).filter("false")
    rank = held.ranks(iterations, damping)
    return best(rank, top)


def best(rank: DataFrame, top: int) -> DataFrame:
    return rank.orderBy(F.desc("rank"), "node").limit(top) if top else rank
