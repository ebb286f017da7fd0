"""Neighbourhood search: level-synchronous BFS over DataFrames for any number of starts at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.operators import small
from edgeloom.operators.graph import Graph, check_direction
from edgeloom.operators.layout import laid_out, layout_of
from edgeloom.storage import Scratch


def _validate(depth, max_results) -> None:
    if depth is None:
        raise ValueError("parameter depth is required")
    if depth < 0:
        raise ValueError("depth must be 0 or more")
    if max_results < 0:
        raise ValueError("max_results must be 0 or more")


def check_threads(threads: int | None) -> None:
    """Accepted for compatibility; Spark's own parallelism applies."""
    if threads is not None and not 1 <= threads <= 64:
        raise ValueError("threads must be between 1 and 64")


def start_requests(graph: Graph, starts) -> DataFrame:
    """``start`` rows from a DataFrame, an int or a list of ints; nulls are no requests, repeats stay."""
    if isinstance(starts, DataFrame):
        out = starts.select(F.col(starts.columns[0]).cast("long").alias("start"))
    else:
        ids = [starts] if isinstance(starts, int) else list(starts or [])
        if not ids:
            raise ValueError("no start node")
        out = graph.edges.sparkSession.createDataFrame([(i,) for i in ids], "start long")
    return out.dropna()


def _levels(graph: Graph, seeds: DataFrame, depth: int, direction: str, one: bool = False) -> DataFrame:
    """``(start, node, hops)`` for distinct starts."""
    first = seeds.select("start", F.col("start").alias("node"), F.lit(0).cast("long").alias("hops"))
    if depth == 0:
        return first
    scratch = Scratch(seeds.sparkSession)
    if depth == 1:
        adj = graph.adjacency(direction).select("u", "v")
    else:
        found, adj = small.links(graph, direction, scratch)
        if found:
            return small.level_rows(found, seeds, depth, False, False, one)
        adj = layout_of(graph, direction, adj, scratch)
    frontier = all_rows = scratch.save(first)
    before = None
    for hop in range(1, depth + 1):
        step = frontier.join(adj, frontier.node == adj.u) if depth == 1 else adj.step(frontier)
        step = step.select("start", F.col("v").alias("node")).distinct()
        # where every link also leads back, only the last two levels can be met again
        seen = all_rows if not graph.leads_back(direction) else frontier if before is None else frontier.unionByName(before)
        new = scratch.save(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(hop).cast("long")))
        if new.isEmpty():
            break
        all_rows, frontier, before = all_rows.unionByName(new), new, frontier
    if depth > 1:
        adj.drop()
    return all_rows


def _limited(graph: Graph, seeds: DataFrame, depth: int, direction: str, k: int, exact: bool) -> DataFrame:
    """The first k rows of each request in discovery order: by parent's place, outgoing before incoming, neighbour id.

    A node's place is the way it was first reached, as an array: arrays of one level compare as discovery goes, so no level is
    ranked in one task.  A request that has its k rows is not searched on.
    """
    adj = graph.adjacency("out").select("u", "v", F.lit(0).alias("side")) if direction != "in" else graph.adjacency("in").select("u", "v", F.lit(1).alias("side"))
    if direction == "both" and graph.directed and not graph.in_equals_out:
        adj = adj.unionByName(graph.adjacency("in").select("u", "v", F.lit(1).alias("side")))
    scratch = Scratch(seeds.sparkSession)
    adj = laid_out(scratch.save(adj), scratch, small.limit(graph))
    root = F.array(F.struct(F.lit(0).alias("side"), F.col("start").alias("node")))
    way = F.concat("ord", F.array(F.struct("side", F.col("v").alias("node"))))
    seen = frontier = scratch.save(seeds.select("start", F.col("start").alias("node"), F.lit(0).cast("long").alias("hops"), root.alias("ord")))
    for hop in range(1, depth + 1):
        step = adj.step(frontier.select("start", "node", "ord")).select("start", "v", way.alias("ord")).groupBy("start", F.col("v").alias("node")).agg(F.min("ord").alias("ord"))
        fresh = step.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        new = scratch.save(fresh.select("start", "node", F.lit(hop).cast("long").alias("hops"), "ord"))
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
        full = seen.groupBy("start").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
        frontier = new if exact else new.join(full, "start", "left_anti")
    adj.drop()
    kept = seen.filter(F.col("hops") == depth) if exact else seen
    place = F.row_number().over(Window.partitionBy("start").orderBy("hops", "ord"))
    return kept.withColumn("_r", place).filter(F.col("_r") <= k).select("start", "node", "hops")


def khop(graph: Graph, starts, depth: int, *, exact: bool = False, direction: str = "out", max_results: int = 0, threads: int | None = None) -> DataFrame:
    """``(start, node, hops)``: every node within ``depth`` hops, once per request, at its least hop count.

    A start that is no node of the graph reaches itself.  Repeated requests give repeated rows.
    """
    _validate(depth, max_results)
    check_threads(threads)
    graph.adjacency(direction)
    requests = start_requests(graph, starts)
    seeds = requests.distinct()
    rows = _limited(graph, seeds, depth, direction, max_results, exact) if max_results else _levels(graph, seeds, depth, direction, isinstance(starts, int))
    if exact and not max_results:
        rows = rows.filter(F.col("hops") == depth)
    return _per_request(rows, requests, starts)


def _per_request(rows: DataFrame, requests: DataFrame, starts) -> DataFrame:
    if isinstance(starts, int) or (not isinstance(starts, DataFrame) and len(set(starts)) == len(list(starts))):
        return rows
    times = requests.groupBy("start").agg(F.count(F.lit(1)).alias("_n"))
    many = rows.join(times, "start").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    return many.select(*rows.columns)


def khop_count(graph: Graph, starts, depth: int, *, exact: bool = False, direction: str = "out", max_results: int = 0, threads: int | None = None) -> DataFrame:
    """``(start, hops, nodes)``: one row for each request and level that is not empty."""
    _validate(depth, max_results)
    check_threads(threads)
    check_direction(direction)
    requests = start_requests(graph, starts)
    if depth > 1 and not max_results:
        found, _ = small.links(graph, direction, Scratch(graph.edges.sparkSession))
        if found:
            return _per_request(small.level_rows(found, requests.distinct(), depth, exact, True, isinstance(starts, int)), requests, starts)
    rows = khop(graph, requests.distinct(), depth, exact=exact, direction=direction, max_results=max_results, threads=threads)
    counts = rows.groupBy("start", "hops").agg(F.count(F.lit(1)).alias("nodes"))
    return _per_request(counts, requests, starts)
