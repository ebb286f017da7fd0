"""Plans for graphs whose checked size fits every task.

The distributed operators pay one or two Spark jobs for each level or round, whatever the graph's size.  A graph of at most
``spark.edgeloom.localEdges`` edges (counted, not guessed) is instead laid out as sorted arrays and broadcast; one Arrow task
then answers a request in a single job, and many requests spread over tasks.  Larger graphs, and all graphs where the
setting is 0, take the distributed plan; both give the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from edgeloom.operators.graph import Graph
from edgeloom.storage import Scratch

CONF = "spark.edgeloom.localEdges"
#: With at most twice as many nodes the arrays take 160 MB.
LOCAL_EDGES = 4_000_000
BATCH = 1 << 16


@dataclass
class Links:
    """Node ids in order; the links of the node at position p lead to the positions ``to[begin[p]:begin[p + 1]]``, ascending."""

    ids: np.ndarray
    begin: np.ndarray
    to: np.ndarray

    @classmethod
    def build(cls, u: np.ndarray, v: np.ndarray, more: np.ndarray | None = None) -> Links:
        ids = np.unique(np.concatenate([u, v] if more is None else [u, v, more]))
        a, b = np.searchsorted(ids, u), np.searchsorted(ids, v)
        order = np.lexsort((b, a))
        begin = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=len(ids)))])
        return cls(ids, begin, b[order])

    def position(self, node: int) -> int | None:
        p = int(np.searchsorted(self.ids, node))
        return p if p < len(self.ids) and self.ids[p] == node else None

    def step(self, front: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All links out of ``front`` as (from, to), in the order of ``front``."""
        size = self.begin[front + 1] - self.begin[front]
        at = np.arange(size.sum()) + np.repeat(self.begin[front] - np.cumsum(size) + size, size)
        return np.repeat(front, size), self.to[at]

    def search(self, start: int, seen: np.ndarray, depth: int | None = None):
        """(new positions, their least predecessors) for each level after the start; ``seen`` is all false, and again at the end."""
        front, reached = np.array([start]), [np.array([start])]
        seen[start] = True
        try:
            while depth is None or len(reached) <= depth:
                a, b = self.step(front)
                fresh = ~seen[b]
                # the front ascends, so the first link to a node comes from its least predecessor
                front, first = np.unique(b[fresh], return_index=True)
                if not len(front):
                    return
                seen[front] = True
                reached.append(front)
                yield front, a[fresh][first]
        finally:
            seen[np.concatenate(reached)] = False

    def components(self) -> np.ndarray:
        """Least position of each node's component: roots hook onto lesser roots, then all paths are shortened."""
        a, b = np.repeat(np.arange(len(self.ids)), np.diff(self.begin)), self.to
        label = np.arange(len(self.ids))
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return label
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up

    def pagerank(self, iterations: int, damping: float) -> np.ndarray:
        n, degree = len(self.ids), np.diff(self.begin)
        source, loose = np.repeat(np.arange(n), degree), degree == 0
        rank = np.full(n, 1.0 / n)
        for _ in range(iterations):
            gathered = np.bincount(self.to, weights=(rank / np.maximum(degree, 1))[source], minlength=n)
            rank = (1.0 - damping) / n + damping * rank[loose].sum() / n + damping * gathered
        return rank


def limit(graph: Graph) -> int:
    return int(graph.edges.sparkSession.conf.get(CONF, str(LOCAL_EDGES)))


def links(graph: Graph, direction: str, scratch: Scratch, nodes: bool = False) -> tuple[Links | None, DataFrame]:
    """``(links, adjacency)``: the adjacency written once, and its links if it is small enough.  With ``nodes`` the graph's
    nodes without an edge are positions too.  A snapshot never changes, so its links are kept.  An overlay of a large snapshot
    is large: nothing of it is written."""
    most = limit(graph)
    key = ("links", direction, nodes, most)
    if key in graph.checks:
        return graph.checks[key]
    if graph.base is not None and graph.base.fixed and links(graph.base, direction, scratch, nodes)[0] is None:
        return None, graph.adjacency(direction).select("u", "v")
    if graph.fixed and not most:
        graph.checks[key] = None, graph.adjacency(direction).select("u", "v")
        return graph.checks[key]
    adj, found = scratch.save(graph.adjacency(direction).select("u", "v")), None
    if most and adj.count() <= most:
        more = None
        if nodes and not graph.closed:
            apart = scratch.save(graph.nodes.select("id"))
            more = apart.toArrow()["id"].to_numpy() if apart.count() <= 2 * most else False
        if more is not False:
            got = adj.toArrow()
            found = Links.build(got["u"].to_numpy(), got["v"].to_numpy(), more)
    if graph.fixed:
        graph.checks[key] = found, adj
    return found, adj


def _spread(requests: DataFrame, one: bool) -> DataFrame:
    """Requests are few bytes but much work, so they are dealt out by number."""
    return requests.coalesce(1) if one else requests.repartition(2 * requests.sparkSession.sparkContext.defaultParallelism, requests.columns[0])


def _table(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in columns], names=[f"c{i}" for i in range(len(columns))])


def level_rows(found: Links, seeds: DataFrame, depth: int, exact: bool, counts: bool, one: bool) -> DataFrame:
    """``(start, node, hops)``, or ``(start, hops, nodes)`` with ``counts``."""
    held = seeds.sparkSession.sparkContext.broadcast(found)

    def run(batches):
        g = held.value
        seen = np.zeros(len(g.ids), bool)
        for batch in batches:
            for start in batch.column(0).to_pylist():
                p = g.position(start)
                levels = (x for x, _ in g.search(p, seen, depth)) if p is not None else ()
                if counts:
                    sizes = [1, *(len(x) for x in levels)]
                    rows = [(start, h, s) for h, s in enumerate(sizes) if not exact or h == depth]
                    if rows:
                        yield _table(*zip(*rows))
                    continue
                if not exact or depth == 0:
                    yield _table([start], [start], [0])
                for hop, level in enumerate(levels, 1):
                    if not exact or hop == depth:
                        for i in range(0, len(level), BATCH):
                            part = g.ids[level[i : i + BATCH]]
                            yield _table(np.full(len(part), start), part, np.full(len(part), hop))

    names = ("start", "hops", "nodes") if counts else ("start", "node", "hops")

    def named(batches):
        for b in run(batches):
            yield b.rename_columns(list(names))

    return _spread(seeds.select("start"), one).mapInArrow(named, ", ".join(f"{n} long" for n in names))


def path_rows(found: Links, requests: DataFrame, max_depth: int, one: bool) -> DataFrame:
    """``(start, target, hop_no, node)`` of requests whose ends differ."""
    held = requests.sparkSession.sparkContext.broadcast(found)

    def run(batches):
        g = held.value
        seen, parent = np.zeros(len(g.ids), bool), np.zeros(len(g.ids), np.int64)
        for batch in batches:
            for start, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p, t = g.position(start), g.position(target)
                if p is None or t is None:
                    continue
                for hop, (level, before) in enumerate(g.search(p, seen, max_depth or None), 1):
                    parent[level] = before
                    i = int(np.searchsorted(level, t))
                    if i < len(level) and level[i] == t:
                        way = [t]
                        while len(way) <= hop:
                            way.append(int(parent[way[-1]]))
                        out = _table(np.full(hop + 1, start), np.full(hop + 1, target), np.arange(hop + 1), g.ids[way[::-1]])
                        yield out.rename_columns(["start", "target", "hop_no", "node"])
                        break

    return _spread(requests.select("start", "target"), one).mapInArrow(run, "start long, target long, hop_no long, node long")


def whole_graph(graph: Graph, found: Links, name: str, kind: str, work) -> DataFrame:
    """``(node, name)`` where ``work(links)`` gives the second column, in one task."""
    spark = graph.edges.sparkSession
    held = spark.sparkContext.broadcast(found)
    width = pa.float64() if kind == "double" else pa.int64()

    def run(batches):
        for _ in batches:
            pass
        g = held.value
        values = work(g) if len(g.ids) else np.array([])
        for i in range(0, len(g.ids), BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(g.ids[i : i + BATCH]), pa.array(values[i : i + BATCH], width)], names=["node", name])

    return spark.range(0, 1, 1, 1).mapInArrow(run, f"node long, {name} {kind}")


def component_rows(graph: Graph, found: Links) -> DataFrame:
    return whole_graph(graph, found, "component", "long", lambda g: g.ids[g.components()])


def rank_rows(graph: Graph, found: Links, iterations: int, damping: float) -> DataFrame:
    return whole_graph(graph, found, "rank", "double", lambda g: g.pagerank(iterations, damping))
