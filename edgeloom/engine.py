"""Lifecycle of registered graphs and the query surface."""

from __future__ import annotations

import datetime as dt
import re
import time
from collections.abc import Callable

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeloom.functions.expressions import INTEGRAL, is_timestamp, newer_rows
from edgeloom.operators import components as cc
from edgeloom.operators import graph as gr
from edgeloom.operators import khop as kh
from edgeloom.operators import pagerank as pr
from edgeloom.operators import path as pa
from edgeloom.operators.graph import Graph
from edgeloom.operators.layout import drop_layouts
from edgeloom.sources import journal as jr
from edgeloom.sources.catalog import FORMAT_VERSION, MANIFEST_FIELDS, Catalog, check_graph_name

DEFAULT_MARGIN_US = 60_000_000
SLOW_MS, LARGE_ROWS = 500, 1_000_000
AHEAD_US = 5 * 60_000_000


class GraphEngine:
    """``root`` is a folder all executors can read.  ``open_writers`` returns the earliest start (microseconds) of a writer
    that has not committed yet, or None; the refresh boundary stays below it."""

    def __init__(self, spark: SparkSession, root: str, open_writers: Callable[[], int | None] = lambda: None):
        self.spark, self.catalog, self.open_writers = spark, Catalog(spark, root), open_writers
        self._loaded: dict[str, tuple[int, Graph]] = {}

    # -- registration

    def _row(self, graph: str) -> dict:
        row = self.catalog.manifest(graph)
        if row is None:
            raise ValueError(f"graph {graph} is not registered")
        return row

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(name) if "/" in name else self.spark.table(name)

    def register_graph(self, graph: str, edge_table: str, src: str, dst: str, op: str | None = None, weight: str | None = None, directed: bool = True, ver: str | None = None, margin: int | None = None) -> None:
        """``edge_table`` is a table or view name, or a Parquet folder.  ``margin`` is in units of the version (timestamps: microseconds)."""
        check_graph_name(graph)
        if "/" not in edge_table and not re.fullmatch(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)?", edge_table):
            raise ValueError("edge_table must be table, schema.table or a folder")
        for c in (src, dst, op, weight, ver):
            if c is not None and not re.fullmatch(r"[A-Za-z_]\w*", c):
                raise ValueError("column names must be plain identifiers")
        df = self._table(edge_table)
        for c in (src, dst, op, weight, ver):
            if c is not None and c not in df.columns:
                raise ValueError(f"column {c} does not exist")
        for c in (src, dst):
            if not isinstance(df.schema[c].dataType, INTEGRAL):
                raise ValueError(f"column {c} must be INT")
        if self.catalog.manifest(graph):
            raise ValueError(f"graph {graph} is already registered")
        if op is not None and ver is None:
            raise ValueError("op_col needs ver_col")
        if ver is not None:
            if is_timestamp(df, ver):
                margin = DEFAULT_MARGIN_US if margin is None else margin
            elif not isinstance(df.schema[ver].dataType, INTEGRAL):
                raise ValueError(f"column {ver} must be TIMESTAMP, TIMESTAMPTZ or INT")
            elif margin is None:
                raise ValueError("an INT version needs an explicit margin")
            if margin < 0:
                raise ValueError("margin must not be negative")
        if op is not None and not isinstance(df.schema[op].dataType, (T.BooleanType, *INTEGRAL)):
            raise ValueError(f"column {op} must be BOOLEAN or INT")
        row = dict.fromkeys(MANIFEST_FIELDS) | {"graph": graph, "edge_table": edge_table, "src_col": src, "dst_col": dst, "op_col": op, "weight_col": weight, "ver_col": ver, "ver_margin": margin, "directed": directed, "build_memory_mb": 4096, "both_directions": False, "format_version": FORMAT_VERSION}
        self.catalog.put(row)
        self.make_delta_view(graph)

    def unregister_graph(self, graph: str) -> None:
        self._row(graph)
        self._unload(graph)
        self.spark.catalog.dropTempView(f"{graph}_delta")
        self.catalog.remove(graph)

    def set_option(self, graph: str, key: str, value) -> None:
        if key not in ("build_memory_mb", "both_directions", "ver_margin"):
            raise ValueError(f"option {key} does not exist")
        self.catalog.put(self._row(graph) | {key: value})

    # -- journal

    def journal(self, graph: str, since: int | None = None) -> DataFrame:
        """The journal's normal form; with ``since`` the rows of later versions, which the scan picks by the raw column."""
        r = self._row(graph)
        rows = self._table(r["edge_table"])
        if since is not None:
            rows = newer_rows(rows, r["ver_col"], since)
        return jr.normalise_journal(rows, r["src_col"], r["dst_col"], r["op_col"], r["weight_col"], r["ver_col"], r["directed"])

    def make_delta_view(self, graph: str) -> DataFrame:
        r = self._row(graph)
        rows = self.journal(graph, r["delta_from"] if r["ver_col"] else None)
        if r["ver_col"] is None:
            rows = rows.filter("false")
        view = jr.delta_view(rows, None, r["active_snapshot"] or 0)
        view.createOrReplaceTempView(f"{graph}_delta")
        return view

    # -- refresh

    def refresh_graph(self, graph: str, now_us: int | None = None) -> dict:
        """Boundary before the build reads, consolidation, snapshot, verification, then the rename of a new manifest; nothing
        before that rename is visible to queries."""
        began, r = time.time(), self._row(graph)
        rows = self.journal(graph)
        max_ver = boundary = None
        if r["ver_col"]:
            max_ver = rows.agg(F.max("ver")).first()[0]
            if is_timestamp(self._table(r["edge_table"]), r["ver_col"]):
                top = int(time.time() * 1e6) if now_us is None else now_us
                boundary = min([top, *(x for x in [self.open_writers()] if x is not None)]) - r["ver_margin"]
            elif max_ver is not None:
                boundary = max_ver - r["ver_margin"]
        live = jr.consolidate(rows, r["op_col"] is not None, r["weight_col"] is not None, r["ver_col"] is not None)
        if not r["directed"]:
            live = gr.mirrored(live)
        sid = self.catalog.next_snapshot_id(graph)
        at = self.catalog.write_snapshot(graph, sid, live.select("src", "dst", "w"))
        edges = self.spark.read.parquet(f"{at}/edges")
        symmetric = not r["directed"]
        facts = edges.agg(F.count(F.lit(1)).alias("n"), gr.edge_checksum(edges).alias("c"), gr.edge_checksum(edges, "dst", "src").alias("r")).first()
        if not facts["n"]:
            raise ValueError(f"graph {graph} has no edges, nothing to build")
        if r["directed"]:
            symmetric = facts["c"] == facts["r"] and (r["both_directions"] or gr.asymmetric_edges(edges).limit(1).count() == 0)
            if r["both_directions"] and not symmetric:
                raise ValueError(f"both_directions is declared for {graph}, but some edges have no reverse")
        gr.endpoints(edges).write.mode("overwrite").parquet(f"{at}/nodes")
        nodes = self.spark.read.parquet(f"{at}/nodes").count()
        new = r | {"active_snapshot": sid, "active_max_ver": max_ver, "delta_from": boundary, "node_count": nodes, "edge_count": facts["n"], "checksum": facts["c"], "in_equals_out": bool(symmetric), "built_at": dt.datetime.now(dt.UTC).isoformat(), "build_seconds": round(time.time() - began, 3)}
        self.catalog.put(new)
        self.make_delta_view(graph)
        self._unload(graph)
        self.catalog.prune(graph, {sid, r["active_snapshot"] or sid})
        return new

    def schedule_refresh(self, graph: str, cron: str) -> None:
        """Keeps the cron text in the manifest, so it outlives the process; ``run_due`` is called by whatever scheduler runs an
        engine on this catalog.  A new schedule replaces the old."""
        row = self._row(graph)
        if not re.fullmatch(r"[0-9 */,\-]+", cron) or len(cron.split()) != 5:
            raise ValueError("a cron expression has five fields of digits, spaces and * / , -")
        self.catalog.put(row | {"schedule": cron})

    def run_due(self, now: dt.datetime) -> list[str]:
        plans = {g: (self.catalog.manifest(g) or {}).get("schedule") for g in self.catalog.graphs()}
        due = [g for g, cron in plans.items() if cron and _cron_matches(cron, now)]
        for g in due:
            self.refresh_graph(g)
        return due

    # -- loading

    def _unload(self, graph: str) -> None:
        old = self._loaded.pop(graph, None)
        if old:
            old[1].edges.unpersist()
            old[1].nodes.unpersist()
            drop_layouts(old[1])

    def load(self, graph: str) -> DataFrame:
        """Persists the active snapshot, which is checked against the manifest."""
        self._snapshot(graph)
        r = self._row(graph)
        return self.spark.createDataFrame([("driver", r["active_snapshot"], r["edge_count"], "loaded")], "node_name string, snapshot_id long, edges long, status string")

    def load_all(self, graph: str) -> DataFrame:
        self._row(graph)
        self._unload(graph)
        return self.load(graph)

    def _snapshot(self, graph: str, wanted: int | None = None) -> Graph:
        """The active snapshot, persisted, and checked when it is first read: rows and checksum of the edges, rows of the nodes."""
        r = self._row(graph)
        sid = r["active_snapshot"]
        if sid is None:
            raise ValueError(f"graph {graph} has no snapshot, refresh it first")
        if wanted is not None and wanted > sid:
            raise ValueError("snapshot cache stale")
        held = self._loaded.get(graph)
        if held and held[0] == sid:
            return held[1]
        self._unload(graph)
        at = self.catalog.snapshot_dir(graph, sid)
        edges, nodes = (self.spark.read.parquet(f"{at}/{t}").persist() for t in ("edges", "nodes"))
        facts = edges.agg(F.count(F.lit(1)).alias("n"), gr.edge_checksum(edges).alias("c")).first()
        if (facts["n"], facts["c"], nodes.count()) != (r["edge_count"], r["checksum"], r["node_count"]):
            edges.unpersist()
            nodes.unpersist()
            raise ValueError(f"snapshot {sid} of {graph} does not hold what its manifest says; refresh the graph")
        g = Graph(edges, nodes, r["directed"], r["weight_col"] is not None, r["in_equals_out"], closed=True, fixed=True)
        self._loaded[graph] = (sid, g)
        return g

    def live_graph(self, graph: str, wanted: int | None = None) -> Graph:
        """Snapshot and delta as one graph; a delta without rows changes nothing and is dropped."""
        base, r = self._snapshot(graph, wanted), self._row(graph)
        if r["ver_col"] is None or r["delta_from"] is None:
            return base
        delta = self.journal(graph, r["delta_from"])
        return base if delta.isEmpty() else jr.overlay(base, delta)

    # -- status

    def status(self, graph: str, now_us: int | None = None) -> DataFrame:
        r = self._row(graph)
        began = time.time()
        now = int(time.time() * 1e6) if now_us is None else now_us
        rows = self.journal(graph, r["delta_from"] if r["ver_col"] else None)
        if r["ver_col"] is None:
            rows = rows.filter("false")
        timed = r["ver_col"] is not None and is_timestamp(self._table(r["edge_table"]), r["ver_col"])
        got = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("ver") > now + AHEAD_US, 1)).alias("ahead")).first()
        ms = int((time.time() - began) * 1000)
        found = [(ms > SLOW_MS, "reading the delta is slow: refresh, or partition the journal by version date"), (got["n"] > LARGE_ROWS, "the delta is large: refresh"), (timed and got["ahead"] > 0, "some versions lie in the future")]
        out = [(graph, r["active_snapshot"], got["n"], ms, int(self.open_writers() is not None), [w for bad, w in found if bad])]
        return self.spark.createDataFrame(out, "graph string, snapshot_id long, delta_rows long, read_ms long, open_writers long, warnings array<string>")

    def info(self, graph: str | None = None) -> DataFrame:
        """One row per known graph; a graph that cannot be read gives a row that says so."""
        rows = []
        for g in [graph] if graph else self.catalog.graphs():
            r = self.catalog.manifest(g) or {}
            sid = r.get("active_snapshot")
            rows.append(("driver", g, sid, r.get("active_max_ver"), r.get("node_count"), r.get("edge_count"), self.catalog.snapshot_dir(g, sid) if sid else "no snapshot", (self._loaded.get(g) or (None,))[0] == sid and sid is not None))
        return self.spark.createDataFrame(rows, "node_name string, graph string, snapshot_id long, max_ver long, node_count long, edge_count long, cache_file string, loaded boolean")

    def version(self) -> DataFrame:
        from edgeloom import __version__

        return self.spark.createDataFrame([(__version__, FORMAT_VERSION, f"spark {pyspark.__version__}")], "library_version string, format_version long, build_flags string")

    def nodes_probe(self) -> DataFrame:
        """Least probe key of every partition, the counterpart of addressing each server."""
        return self.spark.range(1024).groupBy(F.spark_partition_id().cast("string").alias("node_name")).agg(F.min("id").alias("k"))

    # -- queries

    def _graph(self, graph: str | Graph) -> Graph:
        return graph if isinstance(graph, Graph) else self.live_graph(graph)

    def khop(self, graph, starts, depth=None, **options) -> DataFrame:
        return kh.khop(self._graph(graph), starts, depth, **options)

    def khop_count(self, graph, starts, depth=None, **options) -> DataFrame:
        return kh.khop_count(self._graph(graph), starts, depth, **options)

    def shortest_path(self, graph, start=None, target=None, **options) -> DataFrame:
        return pa.shortest_path(self._graph(graph), start, target, **options)

    def components(self, graph, threads: int | None = None) -> DataFrame:
        kh.check_threads(threads)
        return cc.components(self._graph(graph))

    def component_counts(self, graph, threads: int | None = None) -> DataFrame:
        kh.check_threads(threads)
        return cc.component_counts(self._graph(graph))

    def pagerank(self, graph, iterations: int = 20, damping: float = 0.85, top: int = 0, threads: int | None = None) -> DataFrame:
        return pr.pagerank(self._graph(graph), iterations, damping, top, threads)


def _cron_matches(cron: str, now: dt.datetime) -> bool:
    def fits(field: str, value: int, low: int) -> bool:
        for part in field.split(","):
            span, _, step = part.partition("/")
            a, _, b = span.partition("-")
            lo, hi = (low, 10**6) if span == "*" else (int(a), int(b or (10**6 if step else a)))
            if lo <= value <= hi and (value - lo) % int(step or 1) == 0:
                return True
        return False

    m, h, day, month, week = cron.split()
    return fits(m, now.minute, 0) and fits(h, now.hour, 0) and fits(day, now.day, 1) and fits(month, now.month, 1) and fits(week, now.isoweekday() % 7, 0)
