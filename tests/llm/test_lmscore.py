"""The Pitman-Yor model against enumerated seatings and against its predictive rule in plain Python."""

import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from edgeloom.llm import lmscore, seating
from edgeloom.llm.text import text_bytes
from edgeloom.storage import Scratch


def seatings(n):
    """All ways to seat customers 0..n-1, as lists of table sizes."""
    if not n:
        yield []
        return
    for tables in seatings(n - 1):
        for i in range(len(tables)):
            yield [*tables[:i], tables[i] + 1, *tables[i + 1 :]]
        yield [*tables, 1]


def test_seating_is_that_of_all_seatings():
    d, weight = 0.6, 0.7
    for n in range(1, 8):
        by_tables = np.zeros(n)
        for tables in seatings(n):
            by_tables[len(tables) - 1] += weight ** len(tables) * math.prod(k - d for size in tables for k in range(1, size))
        by_tables /= by_tables.sum()
        assert np.allclose(seating._chances(n, np.array([weight]), d)[0], by_tables)
        u = (np.arange(20_000) + 0.5) / 20_000
        t = seating.draw(np.full(len(u), n), np.full(len(u), weight), u, d)
        assert np.allclose(np.bincount(t, minlength=n + 1)[1:] / len(u), by_tables, atol=1e-3)
        mean = seating.expected(np.array([n]), np.array([weight]), d)[0]
        assert math.isclose(mean, by_tables @ np.arange(1, n + 1))


def test_seating_of_many_customers():
    """Beyond the exact range: the Poisson form against the exact mean at the border, and draws against their mean."""
    c = seating.EXACT
    for d, weight in [(0.5, 0.05), (0.75, 0.5), (0.75, 3.0), (0.9, 1.0)]:
        exact = seating.expected(np.array([c]), np.array([weight]), d)[0]
        assert abs(1 + seating._mean_beyond(np.array([float(c)]), np.array([weight]), d)[0] - exact) < 0.1 * exact
        u = (np.arange(4000) + 0.5) / 4000
        t = seating.draw(np.full(len(u), 5000), np.full(len(u), weight * 30), u, d)
        assert abs(t.mean() - seating.expected(np.array([5000]), np.array([weight * 30]), d)[0]) < 0.02 * t.mean()


def corpus(spark, n=240):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words[: rng.randrange(2, 40)]) for _ in range(rng.randrange(0, 25))) for _ in range(n)]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_lm_rule(spark):
    """Scores are sums of the predictive rule over the cells, and the rule sums to one in every context."""
    df = corpus(spark)
    scores = {r["doc_id"]: r for r in lmscore.lm_scores(df).collect()}
    training = df.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2).select(text_bytes("text").alias("t"))
    scratch = Scratch(spark)
    table = lmscore.word_table(training, scratch)
    words = {bytes(r["word"]): r for r in table.collect()}
    n, v = sum(r["c"] for r in words.values()), len(words)
    steps = {r["r"]: r["count"] for r in table.groupBy(lmscore.rung(F.col("c")).alias("r")).count().collect()}
    model = lmscore.Restaurants(lmscore.pair_table(training, scratch), table, scratch, n, v, training.count(), steps)

    d, theta, root = model.d, lmscore.STRENGTH, model.root
    kept = lmscore.SWEEPS - lmscore.BURN_IN
    cells = {(r["b"] >> 32 & lmscore.LOW, r["b"] & lmscore.LOW): r for r in model.cells.collect()}
    assert cells and all(1 <= r["t"] <= r["c"] and kept <= r["ts"] <= kept * r["c"] for r in cells.values())
    p_root = {r["w"]: r["p"] for r in model.w.collect()}
    for r in words.values():
        if r["key"] not in p_root:
            t0 = seating.expected(np.array([r["c"]]), np.array([root.opened]), root.d)[0]
            p_root[r["key"]] = (r["c"] - root.d * t0 + root.opens) / (theta + root.total)
    assert math.isclose(sum(p_root.values()) + root.unknown, 1.0, rel_tol=1e-6)

    def p(u, w):
        own = {k[1]: r for k, r in cells.items() if k[0] == u}
        base = p_root.get(w, root.unknown)
        if not own:
            return base
        strength = theta + next(iter(own.values()))["su"]
        all_ = strength + sum(r["c"] for r in own.values())
        tables = sum(r["ts"] for r in own.values()) / kept
        return (own[w]["c"] - d * own[w]["ts"] / kept if w in own else 0.0) / all_ + (strength + d * tables) / all_ * base

    contexts = {k[0] for k in cells}
    for u in contexts:
        assert math.isclose(sum(p(u, w) for w in p_root) + p(u, None), 1.0, rel_tol=1e-6)
    for i, text in ((r["doc_id"], r["text"]) for r in df.collect()):
        keys = lmscore.keys_of([*text.encode().split(), b""]).tolist()
        want = sum(math.log10(p(u, w)) for u, w in zip([lmscore.START, *keys], keys))
        assert math.isclose(scores[i]["score"], want, rel_tol=1e-9)


def test_lm_held_words_change_nothing(spark):
    """What tasks hold, how the table is cut and a second run leave the scores as they are."""
    df = corpus(spark)
    a = {r["doc_id"]: r for r in lmscore.lm_scores(df).collect()}
    for other in (lmscore.lm_scores(df.repartition(7), held=3, held_pairs=4), lmscore.lm_scores(df, held=0, held_pairs=0)):
        for r in other.collect():
            x = a[r["doc_id"]]
            assert (r["n_known"], r["n_tokens"]) == (x["n_known"], x["n_tokens"])
            assert math.isclose(r["score"], x["score"], rel_tol=1e-9) and math.isclose(r["base_score"], x["base_score"], rel_tol=1e-9)


def test_lm_restaurants_grow(spark):
    """Every pair found twice has a row, whatever its words' ranks: none is folded into another."""
    df = corpus(spark)
    training = df.select(text_bytes("text").alias("t"))
    pairs = Counter()
    for r in df.collect():
        w = [*r["text"].encode().split(), b""]
        pairs.update(zip([None, *w], w))
    got = {(r["b"] >> 32 & lmscore.LOW, r["b"] & lmscore.LOW): r["c"] for r in lmscore.pair_table(training, Scratch(spark)).collect()}
    key = lambda w: lmscore.START if w is None else int(lmscore.keys_of([w])[0])
    assert got == {(key(u), key(w)): c for (u, w), c in pairs.items() if c > 1}


def test_lm_pairs_found_once(spark):
    """A pair found once is a customer at a table of its own: worked out by hand for four such pairs, each word found once."""
    train, out = (next(i for i in range(100) if (zlib.crc32(str(i).encode()) % 7 == 2) == held) for held in (False, True))
    df = spark.createDataFrame([(train, "a b c"), (out, "a b x")], "doc_id long, text string")
    d, root = 0.95, (1 - 0.95 + (1 + 0.95 * 4) * 0.5 / 4) / (1 + 4)
    unknown, back = (1 + 0.95 * 4) / (1 + 4) * 0.5, (1 + d) / (1 + 1)
    assert math.isclose(4 * root + unknown, 1.0)
    once = (1 - d) / (1 + 1) + back * root
    want = {train: 4 * math.log10(once), out: 2 * math.log10(once) + math.log10(back * unknown) + math.log10(root)}
    for limits in ({}, {"held": 0}, {"held": 2}, {"held": 0, "held_pairs": 0}):
        got = {r["doc_id"]: r["score"] for r in lmscore.lm_scores(df, **limits).collect()}
        assert all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want), (limits, got, want)


def test_lm_words_by_turns(spark, monkeypatch):
    """Whichever of a pair's words tasks hold, and however full the map of pairs is, the scores are those of holding all."""
    df = corpus(spark)
    a = {r["doc_id"]: r["score"] for r in lmscore.lm_scores(df).collect()}
    for bits in (lmscore.MAP_BITS, 32768):
        monkeypatch.setattr(lmscore, "MAP_BITS", bits)
        for r in lmscore.lm_scores(df, held=20, held_pairs=4).collect():
            assert math.isclose(r["score"], a[r["doc_id"]], rel_tol=1e-9)


def test_lm_small_tables(spark):
    schema = "doc_id long, text string"
    assert lmscore.lm_scores(spark.createDataFrame([], schema)).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = lmscore.lm_scores(spark.createDataFrame([(held, "nothing learned")], schema)).collect()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["score"], r["base_score"]) == (3, 0, 0, 0.0, 0.0)
    rows = lmscore.lm_scores(spark.createDataFrame([(i, None if i % 2 else "a " * i) for i in range(20)], schema)).collect()
    assert len(rows) == 20 and all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)


def test_lm_disk(spark, monkeypatch):
    """The join of scores reads the priced rows where they lie and shuffles its other side only; of the call's tables the scores
    alone are left."""
    plans, scratches = [], []

    class Seen(Scratch):
        def __init__(self, spark):
            super().__init__(spark)
            scratches.append(self)

        def save(self, df):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return super().save(df)

    monkeypatch.setattr(lmscore, "Scratch", Seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scores = lmscore.lm_scores(corpus(spark), held=20, held_pairs=4)
        plans.append(scores._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = next(p for p in plans if "key_" in p)
    assert "Bucketed: true" in join and join.count("Exchange hashpartitioning(key#") == 1 and "Exchange hashpartitioning(key_#" not in join
    root = scratches[0].root
    left = spark._jvm.org.apache.hadoop.fs.Path(root)
    left = [x.getPath().toString() for x in left.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(left)]
    assert len(left) == 1 and all(f"{left[0].split('/edgeloom/')[1]}/" in f for f in scores.inputFiles())
    assert scores.count() == 240


def test_column_slices():
    """Columns are cut where lists are, also where a column is itself a part of another."""
    import pyarrow as pa

    from edgeloom.llm import words as w

    rng = random.Random(6)
    texts = [b"x" * rng.choice([0, 0, 1, 5, 40]) for _ in range(500)]
    for most in (1, 7, 40, 100_000):
        assert list(w.column_slices(pa.array(texts, pa.binary()), most)) == list(w.slices(texts, most))
        assert list(w.column_slices(pa.array(texts, pa.binary()).slice(3, 300), most)) == list(w.slices(texts[3:303], most))
    assert list(w.column_slices(pa.array([], pa.binary()))) == []


def test_words_as_arrays(monkeypatch):
    """Words, hashes and lookups against plain Python: blanks of all kinds, empty and long texts, words that share a slot."""
    from edgeloom.llm import words as w

    rng = random.Random(5)
    texts = ["".join(rng.choice("aB \t\x0b\x1c\x85é\0") for _ in range(rng.randrange(60))).encode() for _ in range(300)]
    texts += [b"", b"   ", b"x" * 300_000, b" ".join(b"%d" % i for i in range(70_000))]
    plain = lambda part: [x for t in part for x in (*t.lower().split(), b"")]
    counts = Counter(plain(texts))
    for block in (w.BLOCK, 1, 7):
        monkeypatch.setattr(w, "BLOCK", block)
        for part in ([texts[:304]] if block < 100 else [*w.slices(texts, 1000), [b""], [b" ", b""]]):
            part = [t for t in part if block > 100 or len(t) < 1000]
            t = w.Tokens(part)
            p = plain(part)
            assert t.words(np.arange(len(t.hash))) == p and (t.hash == w.hashes_of(p)).all()
            assert t.starts.tolist() == np.cumsum([0, *(len(x.split()) + 1 for x in part)]).tolist()
            for n in (0, 1, 5000):
                some = w.Lookup([x for x, _ in counts.most_common(n)])
                assert some.find(t).tolist() == [some.number.get(x, -1) for x in p]
    assert [x for part in w.slices(texts, 1000) for x in part] == texts
    # all hashes alike: every word is still told apart by its bytes
    monkeypatch.setattr(w, "_polynomials", lambda chars, offsets: np.full(len(offsets) - 1, 9, np.uint64))
    t, some = w.Tokens([b"ab ac b ab", b"ac"]), w.Lookup([b"ab", b"b", b""])
    assert some.find(t).tolist() == [0, -1, 1, 0, 2, -1, 2]
