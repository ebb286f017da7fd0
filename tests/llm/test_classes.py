"""Pairs and words as arrays, against plain Python."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from edgeloom.llm import classes, lmscore
from edgeloom.llm import words as w
from edgeloom.llm.text import text_bytes
from edgeloom.storage import Scratch


def test_classes_hold_every_pair_once():
    rng = np.random.default_rng(4)
    b = np.concatenate([rng.integers(0, 1 << 63, 5000).astype(np.uint64), np.arange(300, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
    assert (classes.unspread(classes.spread(b)) == b).all()
    for n in (1, 7, 400):
        m = np.sort(classes.spread(b))
        k, bounds = classes.dealt(m, n)
        assert (np.diff(k) > 0).all() and 0 <= k[0] and k[-1] < n
        assert [np.frombuffer(x.as_buffer(), np.uint64).tolist() for x in classes.blobs(m, bounds)] == [m[a:z].tolist() for a, z in zip(bounds, bounds[1:])]
    k, bounds = classes.dealt(b[:0], 7)
    assert not len(k) and len(classes.blobs(b[:0], bounds)) == 0


def test_pairs_travel_as_arrays(spark):
    """Pairs are dealt out in a few rows for each part, not in a row for each pair; counts beyond a byte stay whole."""
    plans = []

    class Seen(Scratch):
        def save(self, df):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return super().save(df)

    texts = spark.createDataFrame([("a b " * 700,), ("b c d",), (None,), ("a " * 255,)], "text string").select(text_bytes("text").alias("t"))
    got = {r["b"]: r["c"] for r in lmscore.pair_table(texts, Seen(spark), n=5000).collect()}
    key = lambda x: int(lmscore.keys_of([x])[0])
    a, b = key(b"a"), key(b"b")
    pair = lambda u, v: int(np.uint64(u << 32 | v).view(np.int64))
    assert got == {pair(a, b): 700, pair(b, a): 699, pair(a, a): 254, pair(lmscore.START, a): 2}
    assert plans and not any("hashpartitioning(b#" in p for p in plans)


def test_words_counted_as_arrays(monkeypatch):
    """Counts of words against plain Python, also where different words share a hash."""
    rng = random.Random(8)
    texts = [b" ".join(rng.choice([b"a", b"bc", b"\xc3\xa9d", b"x" * 70_000, b"%d" % rng.randrange(99)]) for _ in range(rng.randrange(20))) for _ in range(60)]
    want = Counter(x for t in texts for x in t.split())
    for same in (False, True):
        if same:
            monkeypatch.setattr(w, "_polynomials", lambda chars, offsets: np.full(len(offsets) - 1, 9, np.uint64))
        held, got = w.Counts(), Counter()
        for part in (texts[:30], texts[30:]):
            t = w.Tokens(part)
            held.add(*t.some(t.word_at))
        for hash_, chars, offsets, counts in held.sums():
            column = w.binary_column(chars, offsets)
            assert same or (w.column_hashes(column) == hash_).all()
            got.update(dict(zip(column.to_pylist(), counts.tolist())))
        assert got == want and not list(held.sums())
    assert w.column_hashes(pa.array([b"", b""], pa.binary())).tolist() == [0, 0]
