"""SQL text that states each graph query on the same tables, for a second engine to run."""

from __future__ import annotations

CONTACT = """picks AS (SELECT c_custkey AS a, (((c_custkey * 2654435761 + k * 40503) % 4294967296) // 7) % (SELECT count(*) FROM customer) AS b
  FROM customer CROSS JOIN (VALUES (1), (2), (3)) t(k)),
e AS (SELECT a AS src, b AS dst, 1.0::DOUBLE AS w FROM picks UNION SELECT b, a, 1.0::DOUBLE FROM picks)"""
GEO = """e AS (SELECT CAST(n_regionkey AS BIGINT) AS src, CAST(100 + n_nationkey AS BIGINT) AS dst, 1.0::DOUBLE AS w FROM nation
  UNION SELECT 100 + c_nationkey, 1000000 + c_custkey, 1.0 FROM customer UNION SELECT 100 + s_nationkey, 2000000 + s_suppkey, 1.0 FROM supplier)"""
CHAIN = """e AS (SELECT src, dst, 1.0::DOUBLE AS w FROM (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders) WHERE dst IS NOT NULL)"""
PARTSUPP = """ps AS (SELECT DISTINCT l_partkey * 2 AS src, l_suppkey * 2 + 1 AS dst FROM lineitem)"""
JOURNAL = """j AS (SELECT src, dst, del, op, CAST(CAST(weight AS FLOAT) AS DOUBLE) AS w, ver FROM (
  SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst, event_type = 'error' AS del,
    CASE WHEN event_type = 'error' THEN -1 WHEN event_type = 'view' THEN NULL ELSE 1 END AS op, value AS weight, event_id AS ver FROM events) WHERE dst IS NOT NULL)"""
HALF = "(SELECT count(*) // 2 FROM events)"


def ranked(rows: str, name: str = "live") -> str:
    return f"""{name} AS (SELECT src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY ver DESC) AS r FROM {rows}) WHERE r = 1 AND NOT del)"""


JOURNAL_LIVE = f"{JOURNAL}, {ranked('j', 'e')}"
#: Snapshot, delta, overlay edges e, overlay nodes n.
OVERLAY = f"""{JOURNAL}, snap AS (SELECT * FROM j WHERE ver <= {HALF}), delta AS (SELECT * FROM j WHERE ver > {HALF}), {ranked('j', 'e')}, {ranked('snap', 'base')},
n AS (SELECT src AS id FROM base UNION SELECT dst FROM base UNION SELECT src FROM delta WHERE NOT del UNION SELECT dst FROM delta WHERE NOT del)"""
NODES = "n AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"
BOTH = "b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def bfs(starts: str, depth: int, edges: str = "e", u: str = "src", v: str = "dst") -> str:
    return f"""r(start, node, hops) AS (SELECT s, s, CAST(0 AS BIGINT) FROM (VALUES {starts}) t(s) UNION SELECT r.start, {edges}.{v}, r.hops + 1 FROM r JOIN {edges} ON r.node = {edges}.{u} WHERE r.hops < {depth}),
k AS (SELECT CAST(start AS BIGINT) AS start, CAST(node AS BIGINT) AS node, min(hops) AS hops FROM r GROUP BY ALL)"""


def khop(graph: str, starts: str, depth: int, direction: str = "out", tail: str = "SELECT start, node, hops FROM k") -> str:
    e, u, v = {"out": ("e", "src", "dst"), "in": ("e", "dst", "src"), "both": ("b", "src", "dst")}[direction]
    return with_(graph, BOTH, bfs(starts, depth, e, u, v)) + tail


def path(graph: str, pairs: str, limit: int, direction: str = "out", rows: bool = True) -> str:
    """The walk back takes the least predecessor one hop nearer."""
    e, u, v = {"out": ("e", "src", "dst"), "in": ("e", "dst", "src"), "both": ("b", "src", "dst")}[direction]
    sql = with_(graph, BOTH, f"req AS (SELECT CAST(s AS BIGINT) AS start, CAST(t AS BIGINT) AS target FROM (VALUES {pairs}) x(s, t))",
        f"""r(start, node, hops) AS (SELECT DISTINCT start, start, CAST(0 AS BIGINT) FROM req UNION SELECT r.start, {e}.{v}, r.hops + 1 FROM r JOIN {e} ON r.node = {e}.{u} WHERE r.hops < {limit})""",
        "k AS (SELECT start, node, min(hops) AS hops FROM r GROUP BY ALL)",
        f"""p(start, target, hop_no, node) AS (SELECT q.start, q.target, k.hops, q.target FROM req q JOIN k ON k.start = q.start AND k.node = q.target
  UNION ALL SELECT p.start, p.target, p.hop_no - 1, (SELECT min(k.node) FROM k JOIN {e} ON {e}.{u} = k.node AND {e}.{v} = p.node WHERE k.start = p.start AND k.hops = p.hop_no - 1) FROM p WHERE p.hop_no > 0)""")  # fmt: skip
    return sql + ("SELECT start, target, hop_no, node FROM p" if rows else "SELECT start, target, max(hop_no) AS length FROM p GROUP BY ALL")


def component_ctes(graph: str, nodes: str = NODES) -> list[str]:
    return [graph, nodes, BOTH, """r(node, label) AS (SELECT id, id FROM n UNION SELECT b.dst, r.label FROM r JOIN b ON r.node = b.src WHERE r.label < b.dst)""", "c AS (SELECT node, min(label) AS component FROM r GROUP BY ALL)"]


def components(graph: str, nodes: str = NODES, tail: str = "SELECT node, component FROM c") -> str:
    return with_(*component_ctes(graph, nodes)) + tail


def pagerank(graph: str, iterations: int = 20, damping: float = 0.85, nodes: str = NODES, tail: str = "SELECT id AS node, round(rank, 9) AS rank FROM p") -> str:
    parts = [graph, nodes, "m AS (SELECT CAST(count(*) AS DOUBLE) AS m FROM n)", "deg AS (SELECT src, count(*) AS d FROM (SELECT DISTINCT src, dst FROM e) GROUP BY src)", "p0 AS MATERIALIZED (SELECT id, 1.0 / m AS rank FROM n, m)"]
    for k in range(iterations):
        last, name = f"p{k}", f"p{k + 1}" if k + 1 < iterations else "p"
        parts.append(f"d{k} AS MATERIALIZED (SELECT coalesce(sum(rank), 0) AS x FROM {last} LEFT JOIN deg ON deg.src = {last}.id WHERE deg.src IS NULL)")
        parts.append(f"s{k} AS MATERIALIZED (SELECT e.dst, sum({last}.rank / deg.d) AS x FROM (SELECT DISTINCT src, dst FROM e) e JOIN {last} ON {last}.id = e.src JOIN deg ON deg.src = e.src GROUP BY e.dst)")
        parts.append(f"{name} AS MATERIALIZED (SELECT n.id, (1 - {damping}) / m + {damping} * d{k}.x / m + {damping} * coalesce(s{k}.x, 0) AS rank FROM n CROSS JOIN m CROSS JOIN d{k} LEFT JOIN s{k} ON s{k}.dst = n.id)")
    return with_(*parts) + tail


def cheapest(graph: str, start: int, targets: str, rounds: int) -> str:
    parts = [graph, f"w0 AS MATERIALIZED (SELECT CAST({start} AS BIGINT) AS node, 0.0::DOUBLE AS dist)"]
    for k in range(rounds):
        parts.append(f"w{k + 1} AS MATERIALIZED (SELECT node, min(dist) AS dist FROM (SELECT * FROM w{k} UNION ALL SELECT e.dst, w{k}.dist + e.w FROM w{k} JOIN e ON e.src = w{k}.node) GROUP BY node)")
    return with_(*parts) + f"SELECT CAST({start} AS BIGINT) AS start, node AS target, round(dist, 6) AS cost FROM w{rounds} WHERE node IN ({targets})"


def cheapest_rows(graph: str, start: int, targets: str, rounds: int) -> str:
    """The walk back along parents of the least label (distance, hops, parent) of every node."""
    parts = [graph, f"w0 AS MATERIALIZED (SELECT CAST({start} AS BIGINT) AS node, {{'d': 0.0::DOUBLE, 'h': 0::BIGINT, 'p': -1::BIGINT}} AS l)"]
    for k in range(rounds):
        parts.append(f"w{k + 1} AS MATERIALIZED (SELECT node, min(l) AS l FROM (SELECT * FROM w{k} UNION ALL SELECT e.dst, {{'d': w{k}.l.d + e.w, 'h': w{k}.l.h + 1, 'p': e.src}} FROM w{k} JOIN e ON e.src = w{k}.node) GROUP BY node)")
    parts.append(f"p(target, hop_no, node) AS (SELECT node, l.h, node FROM w{rounds} WHERE node IN ({targets}) UNION ALL SELECT p.target, p.hop_no - 1, (SELECT w.l.p FROM w{rounds} w WHERE w.node = p.node) FROM p WHERE p.hop_no > 0)")
    return with_(*parts) + f"SELECT CAST({start} AS BIGINT) AS start, target, hop_no, node FROM p"
