"""Register, refresh, read fresh, age out, repair, schedule, stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from edgeloom.engine import GraphEngine
from edgeloom.streaming.ingest import append_journal, refresh_on_stream

SCHEMA = "src long, dst long, gone boolean, w double, ver long"


def edges(engine, name="g"):
    return {(r["src"], r["dst"]) for r in engine.live_graph(name).edges.collect()}


@pytest.fixture
def place(spark, tmp_path):
    journal = str(tmp_path / "journal")
    spark.createDataFrame([(1, 2, False, 1.0, 1), (2, 3, False, 1.0, 2), (3, 4, False, 1.0, 3), (3, 4, True, 1.0, 4)], SCHEMA).write.parquet(journal)
    e = GraphEngine(spark, str(tmp_path / "catalog"))
    e.register_graph("g", journal, "src", "dst", "gone", "w", True, "ver", 1)
    return e, journal, tmp_path


def append(spark, journal, rows):
    spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(journal)


def test_freshness_and_retention(spark, place):
    e, journal, root = place
    first = e.refresh_graph("g")
    assert (first["active_snapshot"], first["edge_count"], first["delta_from"]) == (1, 2, 3)
    append(spark, journal, [(4, 5, False, 1.0, 5), (1, 2, True, 1.0, 6)])
    assert edges(e) == {(2, 3), (4, 5)}
    assert e.khop_count("g", 4, 3).count() == 2
    assert spark.table("g_delta").filter("src is null").count() == 1
    for _ in range(2):
        e.refresh_graph("g")
    assert edges(e) == {(2, 3), (4, 5)}
    kept = sorted(p.name for p in (root / "catalog" / "g").iterdir() if p.name.startswith("snapshot"))
    assert kept == ["snapshot_id=2", "snapshot_id=3"]
    assert e.info("g").first()["snapshot_id"] == 3
    assert e.load_all("g").first()["status"] == "loaded"
    with pytest.raises(ValueError, match="stale"):
        e.live_graph("g", wanted=9)
    s = e.status("g").first()
    assert s["delta_rows"] >= 1 and s["snapshot_id"] == 3
    e.unregister_graph("g")
    with pytest.raises(ValueError, match="not registered"):
        e.status("g")


def test_late_row_within_margin(spark, place):
    e, journal, _ = place
    e.refresh_graph("g")
    append(spark, journal, [(8, 9, False, 1.0, 4)])
    assert (8, 9) in edges(e)


def test_failed_refresh_keeps_snapshot(spark, place):
    e, journal, _ = place
    e.refresh_graph("g")
    append(spark, journal, [(1, 2, True, 1.0, 9), (2, 3, True, 1.0, 9)])
    with pytest.raises(ValueError, match="nothing to build"):
        e.refresh_graph("g")
    assert e.info("g").first()["snapshot_id"] == 1 and edges(e) == set()
    e.set_option("g", "both_directions", True)
    append(spark, journal, [(1, 2, False, 1.0, 10)])
    with pytest.raises(ValueError, match="both_directions is declared"):
        e.refresh_graph("g")


def test_manifest_survives_a_lost_driver(spark, place, monkeypatch):
    """A driver lost before the rename of a new manifest leaves the old one in force, and no id is used twice."""
    from edgeloom.sources.catalog import Catalog

    e, journal, root = place
    e.refresh_graph("g")
    append(spark, journal, [(7, 8, False, 1.0, 9)])
    real = Catalog._rename

    def lost(fs, new, at):
        if "manifest" in at.getName():
            raise OSError("driver lost")
        return real(fs, new, at)

    monkeypatch.setattr(Catalog, "_rename", staticmethod(lost))
    with pytest.raises(OSError, match="lost"):
        e.refresh_graph("g")
    monkeypatch.undo()
    again = GraphEngine(spark, str(root / "catalog"))
    assert again.info("g").first()["snapshot_id"] == 1 and (7, 8) in edges(again)
    assert again.refresh_graph("g")["active_snapshot"] == 3


def test_damaged_snapshot_is_noticed(spark, place):
    e, _, root = place
    e.refresh_graph("g")
    spark.createDataFrame([(1, 2, 5.0)], "src long, dst long, w double").write.mode("overwrite").parquet(str(root / "catalog" / "g" / "snapshot_id=1" / "edges"))
    with pytest.raises(ValueError, match="manifest"):
        GraphEngine(spark, str(root / "catalog")).live_graph("g")


def scan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_delta_reads_are_pushed_down(spark, place, tmp_path):
    e, journal, _ = place
    e.refresh_graph("g")
    assert "GreaterThan(ver,3)" in scan_of(e.journal("g", 3))
    path = str(tmp_path / "dated")
    rows = spark.range(6).select(F.col("id").alias("s"), (F.col("id") + 1).alias("d"), F.timestamp_seconds(F.col("id") * 86400).alias("ts"))
    rows.withColumn("ver_date", F.to_date("ts")).write.partitionBy("ver_date").parquet(path)
    e.register_graph("t", path, "s", "d", ver="ts", margin=0)
    plan = scan_of(e.journal("t", 3 * 86_400_000_000))
    assert "GreaterThan(ts," in plan and "ver_date" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert sorted(r["src"] for r in e.journal("t", 3 * 86_400_000_000).collect()) == [4, 5]


def test_null_versions_are_zero(spark, tmp_path):
    path = str(tmp_path / "j")
    spark.createDataFrame([(1, 2, None), (2, 3, 4)], "s long, d long, v long").write.parquet(path)
    e = GraphEngine(spark, str(tmp_path / "c"))
    e.register_graph("n", path, "s", "d", ver="v", margin=9)
    assert [e.journal("n", b).count() for b in (-1, 0, 4)] == [2, 1, 0]


def test_links_of_a_snapshot_are_laid_out_once(spark, place, monkeypatch):
    """With the plan of large graphs a second search, and one over a later delta, writes no links."""
    from edgeloom.operators.small import CONF
    from edgeloom.storage import Scratch

    e, journal, _ = place
    e.refresh_graph("g")
    spark.conf.set(CONF, "0")
    laid = []
    real = Scratch.bucketed
    monkeypatch.setattr(Scratch, "bucketed", lambda self, *a: laid.append(1) or real(self, *a))
    try:
        first = {tuple(r) for r in e.khop("g", 1, 3).collect()}
        assert first == {(1, 1, 0), (1, 2, 1), (1, 3, 2)} and len(laid) == 1
        append(spark, journal, [(3, 9, False, 1.0, 7), (2, 3, True, 1.0, 8), (2, 4, False, 1.0, 9)])
        assert {tuple(r) for r in e.khop("g", 1, 3).collect()} == {(1, 1, 0), (1, 2, 1), (1, 4, 2)}
        assert {tuple(r)[2:] for r in e.shortest_path("g", 1, 4).collect()} == {(0, 1), (1, 2), (2, 4)}
        assert {tuple(r) for r in e.khop("g", 4, 3, direction="in").collect()} == {(4, 4, 0), (4, 2, 1), (4, 1, 2)}
        assert len(laid) == 2
    finally:
        spark.conf.unset(CONF)


def test_registration_errors(spark, place):
    e, journal, root = place
    bad = [
        (("bad name!", journal, "src", "dst"), {}, "1 to 64 letters"), (("h", "a.b.c", "src", "dst"), {}, "schema.table"), (("h", journal, "src;", "dst"), {}, "plain identifiers"),
        (("h", journal, "src", "nope"), {}, "does not exist"), (("g", journal, "src", "dst"), {}, "already registered"), (("h", journal, "src", "dst", "gone"), {}, "needs ver_col"),
        (("h", journal, "src", "dst"), {"ver": "ver"}, "explicit margin"), (("h", journal, "src", "dst"), {"ver": "w", "margin": 1}, "must be TIMESTAMP"),
        (("h", journal, "src", "dst"), {"ver": "ver", "margin": -1}, "must not be negative"), (("h", journal, "src", "dst", "w"), {"ver": "ver", "margin": 1}, "must be BOOLEAN or INT"),
    ]
    for args, options, text in bad:
        with pytest.raises(ValueError, match=text):
            e.register_graph(*args, **options)


def test_schedule(spark, place):
    e, *_ = place
    with pytest.raises(ValueError, match="digits"):
        e.schedule_refresh("g", "rm -rf")
    e.schedule_refresh("g", "*/5 3 * * *")
    assert e.run_due(dt.datetime(2024, 1, 1, 4, 0)) == []
    later = GraphEngine(spark, e.catalog.root)
    assert later.run_due(dt.datetime(2024, 1, 1, 3, 10)) == ["g"]
    assert e.info("g").first()["snapshot_id"] == 1


def test_timestamp_versions(spark, tmp_path):
    path = str(tmp_path / "j")
    spark.range(4).select(F.col("id").alias("s"), (F.col("id") + 1).alias("d"), F.timestamp_seconds(F.col("id") * 100).alias("ts")).write.parquet(path)
    e = GraphEngine(spark, str(tmp_path / "c"), open_writers=lambda: 150_000_000)
    e.register_graph("t", path, "s", "d", ver="ts", margin=0)
    assert e.refresh_graph("t", now_us=400_000_000)["delta_from"] == 150_000_000
    assert e.status("t", now_us=0).first()["delta_rows"] == 2


def test_streaming(spark, place):
    e, journal, root = place
    e.refresh_graph("g")
    incoming = root / "incoming"
    spark.createDataFrame([(6, 7, False, 1.0, 20)], SCHEMA).write.parquet(str(incoming))
    stream = spark.readStream.schema(SCHEMA).parquet(str(incoming))
    append_journal(stream, str(root / "out"), str(root / "cp1")).awaitTermination()
    assert spark.read.parquet(str(root / "out")).count() == 1
    append(spark, journal, [(6, 7, False, 1.0, 20)])
    refresh_on_stream(spark.readStream.schema(SCHEMA).parquet(str(incoming)), e, "g", str(root / "cp2")).awaitTermination()
    assert e.info("g").first()["snapshot_id"] == 2


def test_cli(tmp_path, capsys):
    from edgeloom.cli import main

    assert main(["--root", str(tmp_path), "--echo_only", "refresh", "g"]) == 0
    assert "refresh" in capsys.readouterr().out
