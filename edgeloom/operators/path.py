"""Shortest paths by hops and by weight for any number of (start, target) requests at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators import small
from edgeloom.operators.graph import Graph
from edgeloom.operators.khop import check_threads
from edgeloom.operators.layout import laid_out, layout_of
from edgeloom.storage import Scratch

KEY = ["start", "target"]
#: Rows of a frontier that every task may hold.
SENT = 100_000


def path_requests(graph: Graph, start=None, target=None, pairs: DataFrame | None = None) -> DataFrame:
    spark = graph.edges.sparkSession
    if (start is None) != (target is None):
        raise ValueError("start and target must be given together")
    out = None
    if pairs is not None:
        out = pairs.select(F.col(pairs.columns[0]).cast("long").alias("start"), F.col(pairs.columns[1]).cast("long").alias("target")).dropna(subset=["start"])
        bad = out.filter("target is null").select("start").first()
        if bad:
            raise ValueError(f"request for start {bad[0]} has no target")
    if start is not None:
        one = spark.createDataFrame([(start, target)], "start long, target long")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no start node")
    return out


def shortest_path(graph: Graph, start=None, target=None, *, pairs: DataFrame | None = None, max_depth: int = 0, direction: str = "out", weighted: bool = False, threads: int | None = None) -> DataFrame:
    """``(start, target, hop_no, node)``, hop_no 0 is the start; no rows where the target cannot be reached.

    Equal paths: the walk back from the target always takes the least predecessor id (by weight: least distance, then
    fewest hops, then least predecessor), so results do not depend on partitioning.  An unknown endpoint gives no rows
    unless start equals target.
    """
    if max_depth < 0:
        raise ValueError("max_depth must be 0 or more")
    check_threads(threads)
    if weighted and not graph.weighted:
        raise ValueError("the graph has no weights")
    graph.adjacency(direction)
    requests = path_requests(graph, start, target, pairs)
    wanted = requests.distinct()
    same = wanted.filter("start = target").select(*KEY, F.lit(0).cast("long").alias("hop_no"), F.col("start").alias("node"))
    others = wanted.filter("start <> target")
    rows = _by_weight(graph, others, direction) if weighted else _by_hops(graph, others, direction, max_depth, pairs is None)
    rows = same.unionByName(rows)
    if pairs is None:
        return rows
    times = requests.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    return rows.join(times, KEY).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select(*rows.columns)


class Steps:
    """Links ``(u, v, ...)`` read where they lie while a frontier is small enough to be sent to them; ``lay`` lays them out for the
    first larger one.  With no ``links`` they are laid out at once."""

    def __init__(self, links: DataFrame | None, lay: Callable):
        self.links, self.lay, self.laid = links, lay, None

    def step(self, front: DataFrame, size: int) -> DataFrame:
        if self.links is not None and size <= SENT:
            return F.broadcast(front).join(self.links, front["node"] == self.links["u"])
        if self.laid is None:
            self.laid = self.lay()
        return self.laid.step(front)

    def drop(self) -> None:
        if self.laid is not None:
            self.laid.drop()


def _both_ways(graph: Graph, direction: str, adj: DataFrame, scratch: Scratch) -> tuple[Steps, Steps]:
    """The links of a search from the start and from the target."""
    # an overlay of a snapshot is written nowhere, nor are a snapshot's links in both directions
    unwritten = graph.base is not None and graph.base.fixed or graph.fixed and direction == "both" and not graph.leads_back("out")
    ahead = Steps(None if unwritten else adj, lambda: layout_of(graph, direction, adj, scratch))
    if graph.leads_back(direction):
        return ahead, ahead
    against = {"out": "in", "in": "out"}[direction]
    turned = adj.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return ahead, Steps(None if unwritten else turned, lambda: layout_of(graph, against, turned, scratch))


def _by_hops(graph: Graph, requests: DataFrame, direction: str, max_depth: int, one: bool = False) -> DataFrame:
    """Levels from both ends, those of the end with the smaller frontier first, until they meet or one end has none left."""
    scratch = Scratch(requests.sparkSession)
    found, adj = small.links(graph, direction, scratch)
    if found:
        return small.path_rows(found, requests, max_depth, one)
    steps = _both_ways(graph, direction, adj, scratch)
    asked = scratch.save(requests.select(*KEY))
    levels = [[asked.select(*KEY, F.col(end).alias("node"), F.lit(None).cast("long").alias("parent"))] for end in KEY]
    live = asked.withColumns({"n0": F.lit(1).cast("long"), "n1": F.lit(1).cast("long")})
    sizes = [asked.count()] * 2
    back = graph.leads_back(direction)
    hop, found = 0, []
    while all(sizes) and not (max_depth and hop >= max_depth):
        hop += 1
        k = int(sizes[1] < sizes[0])
        mine, other = levels[k], levels[1 - k][-1]
        front = mine[-1].join(live.select(*KEY), KEY, "left_semi").select(*KEY, "node")
        step = steps[k].step(front, sizes[k]).groupBy(*KEY, F.col("v").alias("node")).agg(F.min("u").alias("parent"))
        # where every link also leads back, only the last two levels can be met again
        seen = reduce(DataFrame.unionByName, (x.select(*KEY, "node") for x in (mine[-2:] if back else mine)))
        new = scratch.save(step.join(seen, [*KEY, "node"], "left_anti"))
        mine.append(new)
        size = new.groupBy(*KEY).agg(F.count(F.lit(1)).alias(f"n{k}"))
        met = new.join(other.select(*KEY, "node"), [*KEY, "node"], "left_semi").groupBy(*KEY).agg(F.count(F.lit(1)).alias("met"))
        now = scratch.save(live.drop(f"n{k}").join(size, KEY).join(met, KEY, "left"))
        open_ = [F.coalesce(F.sum(F.when(F.col("met").isNull(), F.col(n))), F.lit(0)).alias(n) for n in ("n0", "n1")]
        facts = now.agg(*open_, F.count("met").alias("hit")).first()
        sizes = [facts["n0"], facts["n1"]]
        if facts["hit"]:
            found.append((len(levels[0]) - 1, len(levels[1]) - 1, now.filter("met is not null").select(*KEY)))
        live = now.filter("met is null").drop("met")
    rows = _walk(levels, found, steps[0], scratch) if found else _empty(requests)
    for s in set(steps):
        s.drop()
    return rows


def _walk(levels: list[list[DataFrame]], found: list[tuple[int, int, DataFrame]], ahead: Steps, scratch: Scratch) -> DataFrame:
    """The ways of the requests ``hits`` whose levels ``a`` from the start and ``b`` from the target met, all of them at once."""
    least, last = min(a for a, _, _ in found), max(a + b for a, b, _ in found)
    against = reduce(DataFrame.unionByName, (x.select(*KEY, "node", F.lit(d).alias("left")) for d, x in enumerate(levels[1][: max(b for _, b, _ in found)])), levels[1][0].select(*KEY, "node", F.lit(0).alias("left")).limit(0))
    # (node, parent) of all shortest ways by hop, each with its least predecessor, from where the levels met on
    beyond, at, size = {}, None, 0
    for h in range(least, last + 1):
        parts = [levels[0][a].join(hits, KEY, "left_semi").join(levels[1][b].select(*KEY, "node"), [*KEY, "node"], "left_semi").withColumn("left", F.lit(b)) for a, b, hits in found if a == h]
        if size:
            step = ahead.step(at.filter("left > 0").select(*KEY, "node", "left"), size).groupBy(*KEY, F.col("v").alias("node"), (F.col("left") - 1).alias("left")).agg(F.min("u").alias("parent"))
            beyond[h] = scratch.save(step.join(against, [*KEY, "node", "left"], "left_semi"))
            parts.append(beyond[h])
        at = reduce(DataFrame.unionByName, parts) if parts else None
        size = at.count() if parts else 0
    rows = at = None
    for h in range(last, -1, -1):
        parts = [x.select(*KEY, "node", "parent") for x in (*levels[0][h : h + 1], *([beyond[h]] if h in beyond else []))]
        level = reduce(DataFrame.unionByName, parts)
        here = level.filter("node = target")
        if at is not None:
            here = here.unionByName(level.join(at.select(*KEY, F.col("parent").alias("node")), [*KEY, "node"], "left_semi"))
        at = scratch.save(here)
        here = at.select(*KEY, F.lit(h).cast("long").alias("hop_no"), "node")
        rows = here if rows is None else rows.unionByName(here)
    return rows


def _empty(requests: DataFrame) -> DataFrame:
    return requests.filter("false").select(*KEY, F.lit(0).cast("long").alias("hop_no"), F.col("start").alias("node"))


def distances(graph: Graph, requests: DataFrame, direction: str = "out", scratch: Scratch | None = None) -> DataFrame:
    """Labels ``(start, target, node, l)``, ``l`` of ``(dist, hops, parent)``: relaxation until no label improves.

    The hop count breaks ties in distance, so a parent always has a strictly smaller label and zero weights form no loop.
    """
    labels = _labels(graph, requests, direction, scratch or Scratch(requests.sparkSession))
    return requests.select(*KEY).distinct().join(labels, "start").select(*KEY, "node", "l")


def _labels(graph: Graph, requests: DataFrame, direction: str, scratch: Scratch) -> DataFrame:
    """Labels ``(start, node, l)``, which all targets of a start share.  Those dearer than its dearest target's best known one are
    not expanded, once all its targets have one."""
    table = scratch.save(graph.adjacency(direction))
    steps = Steps(table, lambda: laid_out(table, scratch, small.limit(graph)))
    asked = scratch.save(requests.select(*KEY).distinct())
    zero = F.struct(F.lit(0.0).alias("dist"), F.lit(0).cast("long").alias("hops"), F.lit(None).cast("long").alias("parent"))
    labels = scratch.save(asked.select("start").distinct().select("start", F.col("start").alias("node"), zero.alias("l"), F.lit(True).alias("fresh")))
    none = F.lit(None).cast(labels.schema["l"].dataType)
    size = labels.count()
    while size:
        ends = asked.join(labels.select("start", F.col("node").alias("target"), F.col("l.dist").alias("dist")), KEY, "left")
        # the targets with the greatest and the least id among the dearest: the same one is not expanded, since it helps no other
        dearest = [F.when(F.count("dist") == F.count(F.lit(1)), F.max(F.struct("dist", t.alias("t")))).alias(n) for n, t in (("most", F.col("target")), ("least", F.bitwise_not("target")))]
        bound = ends.groupBy("start").agg(*dearest)
        live = labels.filter("fresh").join(bound, "start").filter("most is null or l.dist < most.dist or (l.dist = most.dist and (node <> most.t or most.t <> ~least.t))")
        reached = steps.step(live.select("start", "node", "l"), size)
        step = reached.select("start", F.col("v").alias("node"), F.struct((F.col("l.dist") + F.col("w")).alias("dist"), (F.col("l.hops") + 1).alias("hops"), F.col("u").alias("parent")).alias("n"), "w")
        if graph.checks.get("negative") is None:
            graph.checks["negative"] = table.filter("w < 0").limit(1).count() > 0
        if graph.checks["negative"] and step.filter("w < 0").limit(1).count():
            steps.drop()
            raise ValueError("negative edge weight")
        both = labels.select("start", "node", "l", none.alias("n")).unionByName(step.select("start", "node", none.alias("l"), "n"))
        best = both.groupBy("start", "node").agg(F.min("l").alias("l"), F.min("n").alias("n"))
        # a lesser parent alone changes no other label
        fresh = F.expr("n is not null and (l is null or n.dist < l.dist or (n.dist = l.dist and n.hops < l.hops))")
        after = scratch.save(best.select("start", "node", F.least("l", "n").alias("l"), fresh.alias("fresh")))
        scratch.drop(labels)
        labels, size = after, after.filter("fresh").count()
    steps.drop()
    return labels.drop("fresh")


def _by_weight(graph: Graph, requests: DataFrame, direction: str) -> DataFrame:
    scratch = Scratch(requests.sparkSession)
    labels = _labels(graph, requests, direction, scratch)
    ends = requests.select(*KEY, F.col("target").alias("node")).join(labels, ["start", "node"])
    at = scratch.save(ends.select(*KEY, "node", F.col("l.parent").alias("parent"), F.col("l.hops").alias("hop_no")))
    rows = at.select(*KEY, "hop_no", "node")
    back = labels.select("start", F.col("node").alias("_n"), F.col("l.parent").alias("_p"))
    while True:
        at = scratch.save(at.filter("parent is not null").select(*KEY, F.col("parent").alias("_n"), (F.col("hop_no") - 1).alias("hop_no")).join(back, ["start", "_n"]).select(*KEY, F.col("_n").alias("node"), F.col("_p").alias("parent"), "hop_no"))
        if at.isEmpty():
            return rows
        rows = rows.unionByName(at.select(*KEY, "hop_no", "node"))
