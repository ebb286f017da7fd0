"""Path searches of the distributed plan: what they visit and write, and that both ways to step give the same rows."""

import random

import pytest

from edgeloom.operators import path
from edgeloom.operators.graph import Graph
from edgeloom.operators.path import shortest_path
from edgeloom.operators.small import CONF, LOCAL_EDGES
from edgeloom.storage import Scratch


@pytest.fixture
def written(spark, monkeypatch):
    """Columns and rows of all tables written, by the distributed plan; None for links laid out."""
    out = []
    save, lay = Scratch.save, Scratch.bucketed

    def saved(self, df):
        got = save(self, df)
        out.append((set(got.columns), got.count()))
        return got

    monkeypatch.setattr(Scratch, "save", saved)
    monkeypatch.setattr(Scratch, "bucketed", lambda self, *a: out.append(None) or lay(self, *a))
    spark.conf.set(CONF, "0")
    yield out
    spark.conf.unset(CONF)


def test_hops_are_searched_from_both_ends(spark, written):
    """A tree of 1,885 nodes: a leaf is found, and a node without links given up, without visiting the tree; no links are laid out."""
    edges = [(n, 12 * n + k) for n in range(157) for k in range(1, 13)]
    asked = spark.createDataFrame([(0, 1884), (0, -1), (7, 0)], "start long, target long")
    got = shortest_path(Graph.from_edges(spark.createDataFrame(edges, "src long, dst long"), distinct=True), pairs=asked)
    assert sorted(map(tuple, got.collect())) == [(0, 1884, 0, 0), (0, 1884, 1, 12), (0, 1884, 2, 156), (0, 1884, 3, 1884)]
    assert None not in written and sum(n for c, n in written if {"node", "parent"} <= c) < 100


def test_targets_of_a_start_share_labels(spark, written):
    """One label for each node and start however many targets are asked for, in one table a round; no links are laid out."""
    rows = [(1, 2, 1.0), (1, 4, 0.0), (4, 5, 0.0), (5, 3, 1.0), (2, 3, 0.0), (3, 6, 1.0), (2, 6, 2.0), (6, 7, 1.0)]
    g = Graph.from_edges(spark.createDataFrame(rows, "src long, dst long, w double"), weight="w")
    asked = spark.createDataFrame([(1, 2), (1, 3), (1, 7), (1, 3)], "start long, target long")
    got = sorted(map(tuple, shortest_path(g, pairs=asked, weighted=True).collect()))
    way = lambda *nodes: [(1, nodes[-1], i, n) for i, n in enumerate(nodes)]
    assert got == sorted(way(1, 2) + 2 * way(1, 2, 3) + way(1, 2, 3, 6, 7))
    labels = [n for c, n in written if "l" in c]
    assert None not in written and labels and max(labels) <= 7
    # of two dearest targets one may lie on the other's way
    two = spark.createDataFrame([(1, 2), (1, 3)], "start long, target long")
    assert sorted(map(tuple, shortest_path(g, pairs=two, weighted=True).collect())) == sorted(way(1, 2) + way(1, 2, 3))
    # a link beyond the only target's distance is not looked at, one that is reached is refused
    less = Graph.from_edges(spark.createDataFrame([(1, 2, 1.0), (2, 3, -1.0)], "src long, dst long, w double"), weight="w")
    assert shortest_path(less, 1, 2, weighted=True).count() == 2
    with pytest.raises(ValueError, match="negative edge weight"):
        shortest_path(less, pairs=spark.createDataFrame([(1, 2), (1, 3)], "start long, target long"), weighted=True)


def test_large_frontiers_step_over_laid_out_links(spark, monkeypatch):
    rnd = random.Random(11)
    edges = [(rnd.randrange(20) * 3, rnd.randrange(20) * 3, float(rnd.choice([0, 1, 1, 2]))) for _ in range(60)]
    asked = spark.createDataFrame([(rnd.randrange(21) * 3, rnd.randrange(21) * 3) for _ in range(6)], "start long, target long")
    got = []
    for sent, limit in ((path.SENT, LOCAL_EDGES), (4, 0)):
        monkeypatch.setattr(path, "SENT", sent)
        spark.conf.set(CONF, str(limit))
        try:
            g = Graph.from_edges(spark.createDataFrame(edges, "src long, dst long, w double"), weight="w")
            frames = [shortest_path(g, pairs=asked, direction="in"), shortest_path(g, pairs=asked, weighted=True)]
            got.append([sorted(map(tuple, f.collect())) for f in frames])
        finally:
            spark.conf.unset(CONF)
    assert got[0] == got[1] and all(got[0])
