"""Hand-made graphs, random graphs against plain Python, errors."""

import random
from collections import defaultdict, deque

import pytest

from edgeloom.operators.components import components
from edgeloom.operators.graph import Graph, is_symmetric
from edgeloom.operators.khop import khop, khop_count
from edgeloom.operators.pagerank import pagerank
from edgeloom.operators.path import shortest_path
from edgeloom.operators.small import CONF
from edgeloom.sources import journal as jr

pytestmark = pytest.mark.usefixtures("plan")


def graph(spark, edges, directed=True, weighted=False):
    if weighted:
        return Graph.from_edges(spark.createDataFrame(edges, "src long, dst long, w float"), weight="w", directed=directed)
    return Graph.from_edges(spark.createDataFrame(edges, "src long, dst long"), directed=directed)


RING = [(1, 2), (1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (7, 8), (None, 3), (3, None)]


def hops(df):
    return {r["node"]: r["hops"] for r in df.collect()}


def test_hand_made(spark):
    g = graph(spark, RING)
    assert g.edges.count() == 6
    assert hops(khop(g, 1, 9)) == {1: 0, 2: 1, 3: 2, 4: 3}
    assert hops(khop(g, 1, 1, direction="in")) == {1: 0, 3: 1}
    assert hops(khop(g, 4, 2, direction="both")) == {4: 0, 3: 1, 1: 2, 2: 2}
    assert hops(khop(g, 5, 3)) == {5: 0}
    assert hops(khop(g, 99, 3)) == {99: 0}
    assert hops(khop(g, 99, 3, exact=True)) == {}
    assert hops(khop(g, 1, 0, exact=True)) == {1: 0}
    assert [tuple(r) for r in khop(g, 1, 9, max_results=2).orderBy("hops").collect()] == [(1, 1, 0), (1, 2, 1)]
    assert {r["component"] for r in components(g).collect()} == {1, 5, 7}
    assert not is_symmetric(g) and is_symmetric(graph(spark, [(1, 2), (2, 1)]))
    ranks = [r["rank"] for r in pagerank(g).collect()]
    assert abs(sum(ranks) - 1) < 1e-9 and min(ranks) > 0


def test_weighted_detour(spark):
    g = graph(spark, [(1, 4, 10.0), (1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (4, 5, 0.0)], weighted=True)
    rows = shortest_path(g, 1, 5, weighted=True).orderBy("hop_no").collect()
    assert [r["node"] for r in rows] == [1, 2, 3, 4, 5]
    assert [r["node"] for r in shortest_path(g, 1, 5).orderBy("hop_no").collect()] == [1, 4, 5]
    with pytest.raises(ValueError, match="negative edge weight"):
        shortest_path(graph(spark, [(1, 2, -1.0), (2, 3, 1.0)], weighted=True), 1, 3, weighted=True).count()


@pytest.mark.parametrize("seed,nodes,n,directed", [(1, 50, 60, True), (2, 50, 400, True), (3, 120, 200, False)])
def test_random_graphs(spark, seed, nodes, n, directed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(nodes) * 7 - 50, rnd.randrange(nodes) * 7 - 50) for _ in range(n)]
    g = graph(spark, edges, directed)
    for direction in ("out", "both"):
        adj = defaultdict(set)
        for a, b in edges:
            adj[a].add(b)
            if not directed or direction == "both":
                adj[b].add(a)
        start = edges[0][0]
        want, queue = {start: 0}, deque([start])
        while queue:
            u = queue.popleft()
            for v in adj[u]:
                if v not in want:
                    want[v] = want[u] + 1
                    queue.append(v)
        assert hops(khop(g, start, 60, direction=direction)) == want
        far = max(want, key=want.get)
        path = [r["node"] for r in shortest_path(g, start, far, direction=direction).orderBy("hop_no").collect()]
        assert len(path) == want[far] + 1 and all(b in adj[a] for a, b in zip(path, path[1:]))


def test_overlay_replay_and_nodes(spark):
    base = graph(spark, [(1, 2), (2, 3), (3, 1)])
    rows = [(1, 2, True, 1.0, 10), (2, 9, False, 1.0, 11), (2, 9, True, 1.0, 12), (50, 60, True, 1.0, 13), (1, 2, False, 1.0, 14), (3, 1, True, 1.0, 15)]
    delta = spark.createDataFrame(rows, "src long, dst long, del boolean, w double, ver long")
    g = jr.overlay(base, delta)
    assert {(r["src"], r["dst"]) for r in g.edges.collect()} == {(1, 2), (2, 3)}
    assert {r["id"] for r in g.nodes.collect()} == {1, 2, 3, 9}
    again = jr.overlay(g, delta)
    assert {(r["src"], r["dst"]) for r in again.edges.collect()} == {(1, 2), (2, 3)}


def test_undirected_delete_either_way(spark):
    df = spark.createDataFrame([(1, 2, False, 1), (2, 1, True, 2), (3, 4, False, 3)], "s long, d long, del boolean, v long")
    j = jr.normalise_journal(df, "s", "d", "del", None, "v", directed=False)
    assert [(r["src"], r["dst"]) for r in jr.consolidate(j, True, False, True).collect()] == [(3, 4)]


@pytest.mark.parametrize(
    "call,text",
    [
        (lambda g: khop(g, 1, None), "depth is required"), (lambda g: khop(g, 1, -1), "depth must be 0 or more"),
        (lambda g: khop(g, 1, 1, direction="up"), "direction must be"), (lambda g: khop(g, 1, 1, max_results=-1), "max_results must be"),
        (lambda g: khop(g, [], 1), "no start node"), (lambda g: khop(g, 1, 1, threads=65), "threads must be"),
        (lambda g: shortest_path(g, 1), "given together"), (lambda g: shortest_path(g, 1, 2, weighted=True), "has no weights"),
        (lambda g: shortest_path(g, pairs=g.edges.sparkSession.createDataFrame([(1, None)], "a long, b long")), "has no target"),
        (lambda g: pagerank(g, 0), "between 1 and 1000"), (lambda g: pagerank(g, 5, float("nan")), "between 0 and 1"), (lambda g: pagerank(g, top=-1), "must not be negative"),
        (lambda g: khop_count(g, 1, -2), "depth must be 0 or more"),
    ],
)
def test_errors(spark, call, text):
    with pytest.raises(ValueError, match=text):
        call(graph(spark, [(1, 2)]))


def test_pagerank_of_sliced_hubs(spark):
    """A hub cut into slices gives the same ranks as whole, by either plan."""
    edges = [(0, i) for i in range(1, 40)] + [(i, i % 7) for i in range(1, 30)] + [(50, 50)]
    g = graph(spark, edges)
    whole = {r["node"]: r["rank"] for r in pagerank(g, 6).collect()}
    spark.conf.set(CONF, "0")
    cut = {r["node"]: r["rank"] for r in pagerank(g, 6, hub=4).collect()}
    assert whole.keys() == cut.keys() and max(abs(whole[k] - cut[k]) for k in whole) < 1e-12
    assert pagerank(graph(spark, [(None, 1)]), 3).count() == 0


def test_bucketed_tables_join_in_place(spark):
    from edgeloom import storage

    scratch = storage.Scratch(spark)
    held = scratch.bucketed(spark.range(1000).selectExpr("id % 10 AS k", "id AS v"), "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = held.join(spark.range(10).withColumnRenamed("id", "k"), "k")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    assert held.count() == 1000
    scratch.drop(held)
    assert not [t for t in spark.catalog.listTables("spark_catalog.default") if t.name.startswith("edgeloom_")]


def test_plans_agree_on_many_requests(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(200) * 3, rnd.randrange(200) * 3) for _ in range(500)]
    asked = spark.createDataFrame([(rnd.randrange(210) * 3, rnd.randrange(210) * 3) for _ in range(40)], "start long, target long")
    got = []
    for edges_limit in ("4000000", "0"):
        spark.conf.set(CONF, edges_limit)
        g = graph(spark, edges)
        frames = [khop(g, asked.select("start"), 3, direction="both"), khop_count(g, asked.select("start"), 4), khop_count(g, asked.select("start"), 2, exact=True), shortest_path(g, pairs=asked), shortest_path(g, pairs=asked, max_depth=2, direction="in"), components(g)]
        got.append([sorted(map(tuple, f.collect())) for f in frames])
    assert got[0] == got[1]


def test_layout_slices_hubs(spark):
    from edgeloom.operators.layout import Layout
    from edgeloom.storage import Scratch

    rows = [(0, i) for i in range(30)] + [(i, i + 1) for i in range(1, 10)]
    lay = Layout(spark.createDataFrame(rows, "u long, v long"), Scratch(spark), hub=4)
    assert lay.sliced and lay.links.select("slice").distinct().count() > 1
    front = spark.createDataFrame([(7, 0), (7, 3), (8, 77)], "start long, node long")
    assert sorted((r["start"], r["u"], r["v"]) for r in lay.step(front).collect()) == sorted([(7, 0, i) for i in range(30)] + [(7, 3, 4)])
    lay.drop()


def test_first_rows_in_discovery_order(spark):
    """Plain Python: the front in discovery order, neighbours out before in, by id; the first k rows of each request."""
    rnd = random.Random(9)
    edges = {(rnd.randrange(60), rnd.randrange(60)) for _ in range(150)}
    out, back = defaultdict(list), defaultdict(list)
    for a, b in sorted(edges):
        out[a].append(b)
    for b, a in sorted((b, a) for a, b in edges):
        back[b].append(a)
    for both, exact, k in ((False, False, 7), (True, False, 12), (True, True, 5)):
        want = []
        for start in (3, 11):
            rows, front, seen = [(start, start, 0)], [start], {start}
            for hop in (1, 2, 3):
                new = []
                for u in front:
                    for v in out[u] + (back[u] if both else []):
                        if v not in seen:
                            seen.add(v)
                            new.append(v)
                rows += [(start, v, hop) for v in new]
                front = new
            want += [r for r in rows if not exact or r[2] == 3][:k]
        got = khop(graph(spark, list(edges)), [3, 11], 3, exact=exact, direction="both" if both else "out", max_results=k)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_pagerank_moves_arrays(spark):
    """A large graph is laid out as rows of arrays, as many as blocks and slices, with the ranks of the small plan."""
    from edgeloom.operators.blocks import Blocks
    from edgeloom.storage import Scratch

    rnd = random.Random(4)
    edges = sorted({(rnd.randrange(90) * 5 - 100, rnd.randrange(90) * 5 - 100) for _ in range(300)} | {(0, i * 5) for i in range(60)})
    want = {r["node"]: r["rank"] for r in pagerank(graph(spark, edges), 7).collect()}
    adj = spark.createDataFrame(edges, "u long, v long")
    held = Blocks(adj, adj.selectExpr("explode(array(u, v)) AS id").distinct(), Scratch(spark), 50)
    assert 1 < held.links.count() <= 2 * (len(edges) // 50 + 1)
    got = {r["node"]: r["rank"] for r in held.ranks(7, 0.85).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_components_contract_where_links_lie(spark, monkeypatch):
    """Links that lie together go through no round; parts that are torn apart are tied."""
    from edgeloom.operators import components as cc

    spark.conf.set(CONF, "0")
    rounds = []
    star = cc._small_star
    monkeypatch.setattr(cc, "_small_star", lambda e: rounds.append(1) or star(e))
    lie = spark.createDataFrame([(c * 100 + i, c * 100 + i + 1) for c in range(9) for i in range(20)] + [(5000, 5000), (3, 3)], "src long, dst long").coalesce(1)
    got = {r["node"]: r["component"] for r in components(Graph.from_edges(lie)).collect()}
    assert not rounds and got == {c * 100 + i: c * 100 for c in range(9) for i in range(21)} | {5000: 5000}
    torn = lie.repartition(7)
    assert {r["node"]: r["component"] for r in components(Graph.from_edges(torn)).collect()} == got and rounds


def test_repeats_are_looked_for_once(spark):
    """One search for repeats in a task: of undirected edges before they are mirrored, none over edges known to be distinct."""
    from edgeloom.plans.catalogue import _mapped, contact

    sf = "/root/testdata/sf0.001"
    ways = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [")
    assert ways(contact(spark, sf).edges) == 1
    assert _mapped(contact(spark, sf))._jdf.queryExecution().optimizedPlan().toString().startswith("Project")
    rows = spark.createDataFrame([(1, 2, 3.0), (2, 1, 1.0), (1, 2, 2.0), (4, 4, 5.0), (None, 1, 1.0)], "src long, dst long, w double")
    g = Graph.from_edges(rows, weight="w", directed=False)
    plan = g.edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")
    assert sorted(map(tuple, g.edges.collect())) == [(1, 2, 1.0), (2, 1, 1.0), (4, 4, 5.0)]
    assert sorted(map(tuple, Graph.from_edges(rows, directed=False).edges.select("src", "dst").collect())) == [(1, 2), (2, 1), (4, 4)]
