"""Every graph query by name: the Spark callable and, where SQL can state it, the SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom import __version__
from edgeloom.engine import GraphEngine
from edgeloom.operators import components as cc
from edgeloom.operators.graph import Graph, asymmetric_edges, degrees, endpoints, is_symmetric, mirrored
from edgeloom.operators.khop import khop, khop_count
from edgeloom.operators.pagerank import pagerank
from edgeloom.operators.path import shortest_path
from edgeloom.plans import oracles as o
from edgeloom.sources import fixtures as fx
from edgeloom.sources import journal as jr
from edgeloom.sources.catalog import FORMAT_VERSION
from edgeloom.sources.export import export_csv, sorted_stream
from edgeloom.storage import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, fn: Query, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


def contact(spark, d) -> Graph:
    return replace(Graph.from_edges(fx.contact(spark, d), distinct=True), in_equals_out=True)


def geo(spark, d) -> Graph:
    return Graph.from_edges(fx.geography(spark, d))


def chain(spark, d) -> Graph:
    return Graph.from_edges(fx.order_chains(spark, d))


def raw_journal(spark, d, op="del", weight="weight", directed=True) -> DataFrame:
    return jr.normalise_journal(fx.transitions(spark, d), "src", "dst", op, weight, "ver", directed)


def live(spark, d) -> Graph:
    edges = jr.consolidate(raw_journal(spark, d), True, True, True)
    return Graph(edges, endpoints(edges), True, True)


def halves(spark, d) -> tuple[DataFrame, DataFrame]:
    j, half = raw_journal(spark, d), fx.table(spark, d, "events").count() // 2
    return j.filter(F.col("ver") <= half), j.filter(F.col("ver") > half)


def overlaid(spark, d) -> Graph:
    old, delta = halves(spark, d)
    edges = jr.consolidate(old, True, True, True)
    return jr.overlay(Graph(edges, endpoints(edges), True, True), delta)


def pairs(spark, *rows) -> DataFrame:
    return spark.createDataFrame(list(rows), "start long, target long")


def starts(spark, *rows) -> DataFrame:
    return spark.createDataFrame([(r,) for r in rows], "start long")


C, G, CH = o.CONTACT, o.GEO, o.CHAIN
COUNT = "SELECT start, hops, count(*) AS nodes FROM k GROUP BY ALL"

# -- k-hop
for _dir in ("out", "in", "both"):
    query(f"khop_{_dir}_d3", lambda s, d, _dir=_dir: khop(live(s, d), 1, 3, direction=_dir), o.khop(o.JOURNAL_LIVE, "(1)", 3, _dir))
query("khop_exact_d2", lambda s, d: khop(contact(s, d), 1, 2, exact=True), o.khop(C, "(1)", 2, tail="SELECT start, node, hops FROM k WHERE hops = 2"))
query("khop_depth0", lambda s, d: khop(contact(s, d), 1, 0), o.khop(C, "(1)", 0))
query("khop_unknown_start", lambda s, d: khop(contact(s, d), -5, 3), o.khop(C, "(-5)", 3))
query("khop_deep", lambda s, d: khop(contact(s, d), 1, 9), o.khop(C, "(1)", 9))
query("khop_geo_in", lambda s, d: khop(geo(s, d), 1000001, 4, direction="in"), o.khop(G, "(1000001)", 4, "in"))
query("khop_multi_source", lambda s, d: khop(contact(s, d), [1, 7, 42], 2), o.khop(C, "(1), (7), (42)", 2))
query("khop_duplicate_requests", lambda s, d: khop(contact(s, d), [1, 1, 7], 2), o.khop(C, "(1), (7)", 2, tail="SELECT start, node, hops FROM k UNION ALL SELECT start, node, hops FROM k WHERE start = 1"))
query("khop_max_results", lambda s, d: khop(geo(s, d), 1, 2, max_results=40), o.with_(G) + """, l1 AS (SELECT dst AS node, row_number() OVER (ORDER BY dst) AS ord FROM e WHERE src = 1),
l2 AS (SELECT e.dst AS node, row_number() OVER (ORDER BY l1.ord, e.dst) AS ord FROM l1 JOIN e ON e.src = l1.node),
a AS (SELECT CAST(1 AS BIGINT) AS start, CAST(1 AS BIGINT) AS node, CAST(0 AS BIGINT) AS hops, CAST(1 AS BIGINT) AS ord UNION ALL SELECT 1, node, 1, ord FROM l1 UNION ALL SELECT 1, node, 2, ord FROM l2)
SELECT start, node, hops FROM a ORDER BY hops, ord LIMIT 40""".replace("\n", " ", 1))
query("khop_count_d6", lambda s, d: khop_count(contact(s, d), 1, 6), o.khop(C, "(1)", 6, tail=COUNT))
query("khop_count_exact", lambda s, d: khop_count(contact(s, d), 1, 3, exact=True), o.khop(C, "(1)", 3, tail="SELECT start, hops, count(*) AS nodes FROM k WHERE hops = 3 GROUP BY ALL"))
query("khop_count_multi", lambda s, d: khop_count(contact(s, d), [1, 1, 9], 3), o.khop(C, "(1), (9)", 3, tail=f"{COUNT} UNION ALL SELECT start, hops, count(*) FROM k WHERE start = 1 GROUP BY ALL"))
query("khop_inline", lambda s, d: _inline(s, d), o.khop(C, "(1)", 2))


def _inline(s, d) -> DataFrame:
    null = F.lit(None)
    rows = fx.contact(s, d).select(null.cast("long").alias("start"), null.cast("long").alias("target"), "src", "dst", null.cast("boolean").alias("del"), null.cast("double").alias("weight"), null.cast("long").alias("ver"), null.cast("long").alias("snapshot_id"))
    ask = s.range(1).select(F.lit(1).cast("long").alias("start"), *(null.cast(t).alias(c) for c, t in (("target", "long"), ("src", "long"), ("dst", "long"), ("del", "boolean"), ("weight", "double"), ("ver", "long"), ("snapshot_id", "long"))))
    graph, requests = jr.inline_graph(rows.unionByName(ask))
    return khop(graph, requests, 2)


# -- paths
LENGTH = lambda df: df.groupBy("start", "target").agg(F.max("hop_no").alias("length"))
query("path_hops_len", lambda s, d: LENGTH(shortest_path(contact(s, d), 1, 100)), o.path(C, "(1, 100)", 10, rows=False))
query("path_hops_rows", lambda s, d: shortest_path(contact(s, d), 1, 100), o.path(C, "(1, 100)", 10))
query("path_max_depth", lambda s, d: shortest_path(contact(s, d), pairs=pairs(s, (1, 100), (1, 3), (1, 77)), max_depth=3), o.path(C, "(1, 100), (1, 3), (1, 77)", 3))
query("path_in", lambda s, d: shortest_path(geo(s, d), 1000001, 0, direction="in"), o.path(G, "(1000001, 0)", 5, "in"))
query("path_both", lambda s, d: shortest_path(geo(s, d), 1000001, 1000002, direction="both", max_depth=4), o.path(G, "(1000001, 1000002)", 4, "both"))
query("path_same_node", lambda s, d: shortest_path(contact(s, d), -9, -9), "SELECT CAST(-9 AS BIGINT) AS start, CAST(-9 AS BIGINT) AS target, CAST(0 AS BIGINT) AS hop_no, CAST(-9 AS BIGINT) AS node")
query("path_unreachable", lambda s, d: shortest_path(geo(s, d), 0, 1), o.path(G, "(0, 1)", 5))
query("path_multi", lambda s, d: shortest_path(contact(s, d), pairs=pairs(s, (1, 2), (5, 60), (9, 9), (3, -1))), o.path(C, "(1, 2), (5, 60), (9, 9), (3, -1)", 10))
query("path_weighted_cost", lambda s, d: _costs(s, d), o.cheapest(o.JOURNAL_LIVE, 1, "2, 30, 75", 30))
query("path_weighted_rows", lambda s, d: shortest_path(live(s, d), pairs=pairs(s, (1, 2), (1, 30)), weighted=True), o.cheapest_rows(o.JOURNAL_LIVE, 1, "2, 30", 30))


def _costs(s, d) -> DataFrame:
    from edgeloom.operators.path import distances

    asked = pairs(s, (1, 2), (1, 30), (1, 75))
    return distances(live(s, d), asked).filter("node = target").select("start", "target", F.round("l.dist", 6).alias("cost"))


# -- components
query("components_contact", lambda s, d: cc.components(contact(s, d)), o.components(C))
query("components_chain", lambda s, d: cc.components(chain(s, d)), o.components(CH))
query("components_count", lambda s, d: cc.component_counts(chain(s, d)), o.components(CH, tail="SELECT component, count(*) AS nodes FROM c GROUP BY ALL"))
query("components_top5", lambda s, d: cc.component_counts(chain(s, d)).orderBy(F.desc("nodes"), "component").limit(5), o.components(CH, tail="SELECT component, count(*) AS nodes FROM c GROUP BY ALL ORDER BY nodes DESC, component LIMIT 5"))

# -- PageRank
NINE = lambda df: df.select("node", F.round("rank", 9).alias("rank"))
query("pagerank_20", lambda s, d: NINE(pagerank(contact(s, d))), o.pagerank(C))
query("pagerank_damping_half", lambda s, d: NINE(pagerank(geo(s, d), 10, 0.5)), o.pagerank(G, 10, 0.5))
query("pagerank_top10", lambda s, d: NINE(pagerank(contact(s, d), top=10)), o.pagerank(C, tail="SELECT id AS node, round(rank, 9) AS rank FROM p ORDER BY p.rank DESC, id LIMIT 10"))
query("pagerank_dangling", lambda s, d: NINE(pagerank(chain(s, d), 5)), o.pagerank(CH, 5))

# -- journal consolidation
EDGES = "SELECT src, dst, round(w, 6) AS w FROM "
rounded = lambda df: df.select("src", "dst", F.round("w", 6).alias("w"))
query("consolidate_plain", lambda s, d: jr.consolidate(raw_journal(s, d, op=None, weight=None), False, False, False).select("src", "dst"), o.with_(o.JOURNAL) + "SELECT DISTINCT src, dst FROM j")
query("consolidate_weighted", lambda s, d: rounded(jr.consolidate(raw_journal(s, d), True, True, True)), o.with_(o.JOURNAL_LIVE) + EDGES + "e")
query("consolidate_ranked", lambda s, d: rounded(jr.latest_wins_ranked(raw_journal(s, d)).filter("not del")), o.with_(o.JOURNAL_LIVE) + EDGES + "e")
query("consolidate_unweighted", lambda s, d: jr.consolidate(raw_journal(s, d, weight=None), True, False, True).select("src", "dst"), o.with_(o.JOURNAL_LIVE) + "SELECT src, dst FROM e")
query("consolidate_int_op", lambda s, d: jr.consolidate(raw_journal(s, d, op="op", weight=None), True, False, True).select("src", "dst"), o.with_(o.JOURNAL, "q AS (SELECT src, dst, w, ver, coalesce(op, 1) < 0 AS del FROM j)", o.ranked("q")) + "SELECT src, dst FROM live")
query("consolidate_undirected", lambda s, d: rounded(mirrored(jr.consolidate(raw_journal(s, d, directed=False), True, True, True))), o.with_(o.JOURNAL, "q AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, del, w, ver FROM j)", o.ranked("q")) + "SELECT src, dst, round(w, 6) AS w FROM live UNION SELECT dst, src, round(w, 6) FROM live")
query("journal_live_having", lambda s, d: raw_journal(s, d).groupBy("src", "dst").agg(F.max("del").alias("gone")).filter("not gone").select("src", "dst"), o.with_(o.JOURNAL) + "SELECT src, dst FROM j GROUP BY src, dst HAVING NOT max(del)")

# -- overlay
query("delta_rows", lambda s, d: jr.delta_view(raw_journal(s, d), fx.table(s, d, "events").count() // 2, 1).select("src", "dst", "del", F.round("weight", 6).alias("weight"), "ver", "snapshot_id"), o.with_(o.OVERLAY) + "SELECT src, dst, del, round(w, 6) AS weight, ver, CAST(1 AS BIGINT) AS snapshot_id FROM delta UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, 1")
query("overlay_live_edges", lambda s, d: rounded(overlaid(s, d).edges), o.with_(o.OVERLAY) + EDGES + "e")
query("overlay_nodes", lambda s, d: overlaid(s, d).nodes, o.with_(o.OVERLAY) + "SELECT id FROM n")
query("overlay_khop", lambda s, d: khop(overlaid(s, d), 1, 2), o.khop(o.OVERLAY, "(1)", 2))
query("overlay_components", lambda s, d: cc.components(overlaid(s, d)), o.components(o.OVERLAY.rsplit(",\nn AS", 1)[0], "n AS" + o.OVERLAY.rsplit(",\nn AS", 1)[1]))
query("overlay_pagerank", lambda s, d: NINE(pagerank(overlaid(s, d), 10)), o.pagerank(o.OVERLAY.rsplit(",\nn AS", 1)[0], 10, nodes="n AS" + o.OVERLAY.rsplit(",\nn AS", 1)[1]))
query("overlay_weight_update", lambda s, d: rounded(overlaid(s, d).edges.join(halves(s, d)[1].select("src", "dst").distinct(), ["src", "dst"], "left_semi")), o.with_(o.OVERLAY) + "SELECT src, dst, round(w, 6) AS w FROM e WHERE (src, dst) IN (SELECT (src, dst) FROM delta)")

# -- relational building blocks
query("node_map", lambda s, d: _numbered(contact(s, d)), o.with_(C, o.NODES) + "SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM n")


def _numbered(g: Graph) -> DataFrame:
    """Dense numbering without one sorting task: range partitions, their sizes as offsets, a rank within each."""
    from pyspark.sql import Window

    parts = g.nodes.repartitionByRange("id").withColumn("_p", F.spark_partition_id())
    from edgeloom.storage import Scratch

    parts = Scratch(g.nodes.sparkSession).save(parts)
    sizes = parts.groupBy("_p").count()
    offsets = sizes.alias("a").join(sizes.alias("b"), F.col("b._p") < F.col("a._p"), "left").groupBy("a._p").agg(F.coalesce(F.sum("b.count"), F.lit(0)).alias("off"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("id"))
    return parts.join(offsets, "_p").select("id", (rank - 1 + F.col("off")).cast("long").alias("pos"))


query("mapped_edges", lambda s, d: _mapped(contact(s, d)), o.with_(C, o.NODES, "m AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM n)") + "SELECT a.pos AS s, b.pos AS t, min(w) AS w FROM e JOIN m a ON a.id = src JOIN m b ON b.id = dst GROUP BY ALL")


def _mapped(g: Graph) -> DataFrame:
    m = _numbered(g)
    a, b = m.select(F.col("id").alias("src"), F.col("pos").alias("s")), m.select(F.col("id").alias("dst"), F.col("pos").alias("t"))
    # numbers and nodes go one to one and edges are distinct, so no pair of numbers comes twice
    return g.edges.join(a, "src").join(b, "dst").select("s", "t", "w")


query("degree_out", lambda s, d: degrees(live(s, d).edges), o.with_(o.JOURNAL_LIVE) + "SELECT src AS id, count(*) AS degree FROM e GROUP BY src")
query("degree_in", lambda s, d: degrees(live(s, d).edges, "dst"), o.with_(o.JOURNAL_LIVE) + "SELECT dst AS id, count(*) AS degree FROM e GROUP BY dst")
query("symmetry_hash", lambda s, d: _symmetry(s, contact(s, d), live(s, d)), o.with_(C) + "SELECT 'contact' AS graph, NOT EXISTS (SELECT dst, src FROM e EXCEPT SELECT src, dst FROM e) AS symmetric UNION ALL SELECT 'journal', false")


def _symmetry(s, *graphs) -> DataFrame:
    return s.createDataFrame([(n, is_symmetric(g)) for n, g in zip(("contact", "journal"), graphs, strict=True)], "graph string, symmetric boolean")


query("symmetry_exact", lambda s, d: asymmetric_edges(live(s, d).edges).select("src", "dst"), o.with_(o.JOURNAL_LIVE) + "SELECT src, dst FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.src = e.dst AND x.dst = e.src AND x.w = e.w)")
query("edges_mirrored", lambda s, d: Graph.from_edges(fx.part_supplier(s, d), directed=False).edges.select("src", "dst"), o.with_(o.PARTSUPP) + "SELECT src, dst FROM ps UNION SELECT dst, src FROM ps")
query("edges_undirected_dedup", lambda s, d: Graph.from_edges(fx.transitions(s, d), weight="weight", directed=False).edges.select("src", "dst", F.round("w", 6).alias("w")), o.with_(o.JOURNAL) + "SELECT src, dst, round(min(w), 6) AS w FROM (SELECT src, dst, w FROM j UNION ALL SELECT dst, src, w FROM j) GROUP BY src, dst")
query("edges_self_loops", lambda s, d: live(s, d).edges.filter("src = dst").select("src", "dst"), o.with_(o.JOURNAL_LIVE) + "SELECT src, dst FROM e WHERE src = dst")
query("distinct_edges_count", lambda s, d: fx.transitions(s, d).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("src", "dst").alias("edges"), F.min("ver").alias("first_ver"), F.max("ver").alias("last_ver")), o.with_(o.JOURNAL) + "SELECT count(*) AS rows, count(DISTINCT (src, dst)) AS edges, min(ver) AS first_ver, max(ver) AS last_ver FROM j")

# -- results joined to business tables
query("khop_join_customer", lambda s, d: khop(contact(s, d), 1, 2).join(fx.table(s, d, "customer"), F.col("node") == F.col("c_custkey")).select("node", "hops", "c_name", "c_mktsegment"), o.khop(C, "(1)", 2, tail="SELECT node, hops, c_name, c_mktsegment FROM k JOIN customer ON node = c_custkey"))
query("pagerank_by_nation", lambda s, d: pagerank(contact(s, d), 5).join(fx.table(s, d, "customer"), F.col("node") == F.col("c_custkey")).groupBy(F.col("c_nationkey").cast("long").alias("nation")).agg(F.round(F.sum("rank"), 9).alias("rank")), o.pagerank(C, 5, tail="SELECT CAST(c_nationkey AS BIGINT) AS nation, round(sum(rank), 9) AS rank FROM p JOIN customer ON id = c_custkey GROUP BY ALL"))
query("path_step_validation", lambda s, d: _steps(s, d), o.path(C, "(1, 100)", 10, rows=False).rsplit("SELECT", 1)[0] + "SELECT max(hop_no) AS steps, CAST(0 AS BIGINT) AS broken FROM p")


def _steps(s, d) -> DataFrame:
    g = contact(s, d)
    p = shortest_path(g, 1, 100)
    before = p.select((F.col("hop_no") + 1).alias("hop_no"), F.col("node").alias("src"))
    steps = p.filter("hop_no > 0").join(before, "hop_no", "left").join(g.edges.select("src", F.col("dst").alias("node"), F.lit(1).alias("ok")), ["src", "node"], "left")
    return steps.agg(F.count(F.lit(1)).alias("steps"), F.count(F.when(F.col("ok").isNull(), 1)).alias("broken"))


query("symmetric_difference", lambda s, d: _difference(s, d), o.with_(o.OVERLAY) + "(SELECT src, dst, 'gone' AS side FROM base EXCEPT SELECT src, dst, 'gone' FROM e) UNION ALL (SELECT src, dst, 'new' AS side FROM e EXCEPT SELECT src, dst, 'new' FROM base)")


def _difference(s, d) -> DataFrame:
    old, now = jr.consolidate(halves(s, d)[0], True, True, True).select("src", "dst"), overlaid(s, d).edges.select("src", "dst")
    return old.subtract(now).withColumn("side", F.lit("gone")).unionByName(now.subtract(old).withColumn("side", F.lit("new")))


query("count_full_outer", lambda s, d: khop_count(contact(s, d), 1, 3).select("hops", F.col("nodes").alias("a")).join(khop_count(contact(s, d), 7, 4).select("hops", F.col("nodes").alias("b")), "hops", "full_outer"), o.khop(C, "(1), (7)", 4, tail="SELECT hops, a, b FROM (SELECT hops, count(*) AS a FROM k WHERE start = 1 AND hops <= 3 GROUP BY hops) FULL OUTER JOIN (SELECT hops, count(*) AS b FROM k WHERE start = 7 GROUP BY hops) USING (hops)"))
query("journal_future_versions", lambda s, d: fx.transitions(s, d).filter(F.col("ts") > F.lit("2024-01-15").cast("timestamp_ntz")).agg(F.count(F.lit(1)).alias("ahead")), "WITH x AS (SELECT ts, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events) SELECT count(*) AS ahead FROM x WHERE dst IS NOT NULL AND ts > TIMESTAMP '2024-01-15'")
query("journal_version_micros", lambda s, d: jr.normalise_journal(fx.transitions(s, d), "src", "dst", "del", None, "ts").select("src", "dst", "ver"), "SELECT src, dst, ver FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst, epoch_us(ts) AS ver FROM events) WHERE dst IS NOT NULL")


# -- lifecycle: a registered graph in a scratch catalog
def _engine(s, d) -> GraphEngine:
    import uuid

    root = f"{shared_dir(s)}/edgeloom-catalog/{uuid.uuid4().hex}"
    fx.transitions(s, d).write.parquet(f"{root}-journal")
    e = GraphEngine(s, root)
    half = fx.table(s, d, "events").count() // 2
    e.register_graph("moves", f"{root}-journal", "src", "dst", "del", "weight", True, "ver", half)
    e.refresh_graph("moves")
    return e


query("registered_khop_count", lambda s, d: _engine(s, d).khop_count("moves", 1, 2), o.khop(o.JOURNAL_LIVE, "(1)", 2, tail=COUNT))
query("registered_edges", lambda s, d: rounded(_engine(s, d).live_graph("moves").edges), o.with_(o.JOURNAL_LIVE) + EDGES + "e")
query("status_report", lambda s, d: _engine(s, d).status("moves").drop("read_ms", "warnings"), o.with_(o.JOURNAL) + f"SELECT 'moves' AS graph, CAST(1 AS BIGINT) AS snapshot_id, count(*) AS delta_rows, CAST(0 AS BIGINT) AS open_writers FROM j WHERE ver > (SELECT max(ver) FROM j) - {o.HALF}")
query("info_rows", lambda s, d: _engine(s, d).info("moves").drop("cache_file"), o.with_(o.JOURNAL_LIVE, o.NODES) + "SELECT 'driver' AS node_name, 'moves' AS graph, CAST(1 AS BIGINT) AS snapshot_id, (SELECT max(ver) FROM j) AS max_ver, (SELECT count(*) FROM n) AS node_count, (SELECT count(*) FROM e) AS edge_count, false AS loaded")
query("load_rows", lambda s, d: _engine(s, d).load_all("moves"), o.with_(o.JOURNAL_LIVE) + "SELECT 'driver' AS node_name, CAST(1 AS BIGINT) AS snapshot_id, count(*) AS edges, 'loaded' AS status FROM e")
query("version_row", lambda s, d: GraphEngine(s, shared_dir(s)).version(), f"SELECT '{__version__}' AS library_version, CAST({FORMAT_VERSION} AS BIGINT) AS format_version, 'spark {pyspark.__version__}' AS build_flags")
query("node_probe", lambda s, d: GraphEngine(s, shared_dir(s)).nodes_probe().agg(F.min("k").alias("least"), F.count_distinct("k").cast("long").alias("keys"), F.count(F.lit(1)).alias("parts")).select("least", (F.col("keys") == F.col("parts")).alias("each_apart")), "SELECT CAST(0 AS BIGINT) AS least, true AS each_apart")


# -- the plan of graphs of any size, which the small one replaces up to a checked size
def _large(fn: Query) -> Query:
    def run(s, d):
        from edgeloom.operators.small import CONF

        before = s.conf.get(CONF, None)
        s.conf.set(CONF, "0")
        try:
            return fn(s, d)
        finally:
            s.conf.unset(CONF) if before is None else s.conf.set(CONF, before)

    return run


for _name in ("khop_count_d6", "khop_deep", "path_hops_rows", "path_multi", "components_contact", "components_chain", "pagerank_20", "overlay_khop", "registered_khop_count"):
    query(f"{_name}_large", _large(QUERIES[_name]), SQL[_name])

# -- exports, and the remaining relational forms
query("csv_export_edges", lambda s, d: _exported(s, d, "edges", "src long, dst long"), o.with_(C) + "SELECT src, dst FROM e")
query("csv_export_nodes", lambda s, d: _exported(s, d, "nodes", "id long"), o.with_(C, o.NODES) + "SELECT id FROM n")


def _exported(s, d, part: str, schema: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(s)}/edgeloom-export/{uuid.uuid4().hex}"
    export_csv(contact(s, d), path)
    return s.read.schema(schema).option("header", True).csv(f"{path}/{part}")


query("sorted_stream", lambda s, d: sorted_stream(contact(s, d).edges.select("src", "dst"), "src", "dst"), o.with_(C) + "SELECT src, dst FROM e")
level = lambda h: F.max(F.when(F.col("hops") == h, F.col("nodes"))).alias(f"h{h}")
query("pivot_levels", lambda s, d: khop_count(contact(s, d), [1, 7], 2).groupBy("start").agg(level(0), level(1), level(2)), o.khop(C, "(1), (7)", 2, tail=f"SELECT start, max(CASE WHEN hops = 0 THEN nodes END) AS h0, max(CASE WHEN hops = 1 THEN nodes END) AS h1, max(CASE WHEN hops = 2 THEN nodes END) AS h2 FROM ({COUNT}) GROUP BY start"))
query("cross_one_row", lambda s, d: _shares(s, d), o.with_(C, o.NODES) + "SELECT src AS id, count(*) AS degree, (SELECT count(*) FROM n) AS nodes FROM e GROUP BY src")
query("per_partition_totals", lambda s, d: _by_partition(contact(s, d)), o.with_(C) + "SELECT count(*) AS edges, min(src) AS low, max(src) AS high FROM e")


def _shares(s, d) -> DataFrame:
    g = contact(s, d)
    return degrees(g.edges).crossJoin(F.broadcast(g.nodes.agg(F.count(F.lit(1)).alias("nodes"))))


def _by_partition(g: Graph) -> DataFrame:
    """Each partition works on its own rows, one result each, which are then put together."""
    parts = g.edges.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("low"), F.max("src").alias("high"))
    return parts.agg(F.sum("n").alias("edges"), F.min("low").alias("low"), F.max("high").alias("high"))


query("scalar_dates", lambda s, d: fx.table(s, d, "orders").select("o_orderkey", F.date_diff(F.lit("1998-12-01").cast("date"), F.col("o_orderdate").cast("date")).cast("long").alias("days"), (F.col("o_orderdate").cast("timestamp_ntz") + F.expr("INTERVAL '36' HOUR")).alias("later")), "SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-01') AS days, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 36 HOUR AS later FROM orders")
query("scalar_strings", lambda s, d: fx.table(s, d, "customer").select("c_custkey", F.lower("c_name").alias("low"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("tail"), F.regexp_replace("c_name", "[0-9]+", "N").alias("shape"), F.length("c_name").cast("long").alias("size"), F.expr("right(c_name, 3)").alias("last"), F.round("c_acctbal").cast("long").alias("whole")), "SELECT c_custkey, lower(c_name) AS low, split_part(c_name, '#', 2) AS tail, regexp_replace(c_name, '[0-9]+', 'N', 'g') AS shape, length(c_name) AS size, right(c_name, 3) AS last, CAST(round(c_acctbal) AS BIGINT) AS whole FROM customer")
query("scalar_clock_text", lambda s, d: fx.table(s, d, "events").select("event_id", F.date_format(F.col("ts"), "yyyy-MM-dd HH:mm:ss").alias("shown"), F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col("ts").cast("timestamp_ntz")), "yyyy-MM-dd HH:mm").alias("there")), "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown, strftime(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York', '%Y-%m-%d %H:%M') AS there FROM events")
