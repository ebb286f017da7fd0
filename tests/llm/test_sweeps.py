"""Sweeps of the Pitman-Yor model over arrays."""

import random

import numpy as np
from pyspark.sql import functions as F

from edgeloom.llm import classes, lmscore
from edgeloom.llm.text import text_bytes
from edgeloom.storage import Scratch


def test_random_numbers_are_hashes_of_spark(spark):
    b = np.random.default_rng(2).integers(-(1 << 63), (1 << 63) - 1, 500)
    b[:3] = 0, -1, lmscore.START
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(b)], "i long, b long")
    got = df.select("i", F.xxhash64("b").alias("one"), F.xxhash64("b", F.lit(2)).alias("two")).orderBy("i").collect()
    assert [r["one"] for r in got] == lmscore.spark_hash(b.view(np.uint64)).view(np.int64).tolist()
    assert [r["two"] for r in got] == lmscore.spark_hash(b.view(np.uint64), 2).view(np.int64).tolist()


def test_keys_in_classes():
    k = np.array([0, 1, 7, lmscore.START, 0x9E3779B1], np.uint64)
    m = classes.spread_key(k)
    assert (classes.unspread_key(m) == k).all() and m.max() <= lmscore.LOW
    for n in (1, 7, 400):
        edges = classes.class_edges(n)
        assert edges[0] == 0 and edges[-1] == 1 << 32
        assert (np.searchsorted(edges, m, "right") - 1 == (m * np.uint64(n)) >> np.uint64(32)).all()


def test_sweeps_move_arrays(spark, monkeypatch):
    """Sweeps save and shuffle some rows for each chunk of cells and class of keys, none for each cell; how cells and keys are
    cut leaves all tables as they are."""
    rng = random.Random(5)
    texts = [" ".join(f"w{int(rng.expovariate(0.05))}" for _ in range(rng.randrange(120))) for _ in range(400)]
    training = spark.createDataFrame([(t,) for t in texts], "text string").select(text_bytes("text").alias("t")).coalesce(2)
    saved = []

    class Seen(Scratch):
        def save(self, df):
            out = super().save(df)
            saved.append((out.columns, out.count()))
            return out

    def model():
        scratch = Scratch(spark)
        table = lmscore.word_table(training, scratch)
        n, v = table.agg(F.sum("c"), F.count("*")).first()
        steps = {r["r"]: r["count"] for r in table.groupBy(lmscore.rung(F.col("c")).alias("r")).count().collect()}
        return lmscore.Restaurants(lmscore.pair_table(training, scratch), table, Seen(spark), n, v, len(texts), steps), v

    a, v = model()
    cells = sorted(map(tuple, a.cells.collect()))
    twice = sum(c > 1 for _, c, *_ in cells)
    assert twice > 1000 and any(1 < t < c for _, c, _, t, _ in cells)
    # contexts and words have rows of their own at the end
    assert max(n for columns, n in saved if not {"u", "w"} & {*columns}) < 100, saved
    prices = {r["b"]: (r["c"], r["x"], r["once"]) for r in a.priced_pairs().collect()}
    assert len(prices) == twice

    # as many as a batch of Arrow holds at most go to a chunk beyond its size
    monkeypatch.setattr(lmscore, "CHUNK", 200)
    monkeypatch.setattr(lmscore, "KEYS", 16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "150")
    try:
        b, _ = model()
        assert b.chunks.select("at").filter(F.col("kind") == lmscore.CELLS).count() >= twice // 400 and len(b.edges) - 1 == -(-v // 16) > 4
        assert sorted(map(tuple, b.cells.collect())) == cells
        other = {r["b"]: (r["c"], r["x"], r["once"]) for r in b.priced_pairs().collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert other.keys() == prices.keys() and all(np.allclose(other[k], prices[k], rtol=1e-12, atol=1e-14) for k in prices)
