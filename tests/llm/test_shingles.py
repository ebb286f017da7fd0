"""Classes of similar shingle sets against all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from edgeloom.llm import shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(texts, similarity=0.8):
    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, root = {i: grams(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


@pytest.fixture(scope="module")
def planted():
    """Copies with one to nine edited words of 200 (similarity about 0.95 to 0.65), chains of them, one passage in many texts."""
    r = random.Random(4)
    text = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    passage, out = text(60), []
    for g in range(12):
        base = text(200)
        out.append(base)
        for k in range(9):
            copy = list(out[-1] if g % 3 == 0 else base)
            for i in r.sample(range(200), 1 + k if g % 3 else 2):
                copy[i] = f"x{r.randrange(10**6)}"
            out.append(copy)
    out += [text(60) + passage + text(60) for _ in range(40)]
    out += [out[5], [], ["one"], ["one"]]
    return dict(enumerate(" ".join(w) for w in out))


@pytest.mark.parametrize("block", [16, 1024])
def test_similar_classes(spark, planted, block):
    df = spark.createDataFrame([*planted.items(), (900, None)], "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in shingles.similar_classes(df, block=block).collect()}
    assert got == brute(planted | {900: None})


def test_pipeline_stage_takes_edited_copies(spark, planted, sf):
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in planted.items()], SCHEMA)
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, sf).collect()}
    assert got == set(brute(planted).values())


def test_sketches_lose_no_pair():
    """Sets of similarity just above 0.8 pass both sketches, unrelated long ones do not pass the wide one."""
    rng = np.random.default_rng(3)
    for n in (9, 90, 900, 3000, 9000):
        x = np.unique(rng.integers(-(1 << 62), 1 << 62, n + n // 9))
        a, b = x[: len(x) - n // 9], x[n // 9 :]
        m, k = np.array([len(a)]), np.array([len(b)])
        one = lambda s: np.frombuffer(shingles.sketch(s), np.uint64)[None]
        assert shingles.may_be_similar(one(a), m, one(b), k, 0.8).all()
        assert shingles.wide_similar(shingles.wide_sketch(a), len(a), shingles.wide_sketch(b), len(b), 0.8)
        other = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        assert n < 1024 or not shingles.wide_similar(shingles.wide_sketch(a), len(a), shingles.wide_sketch(other), len(other), 0.8)


def test_fingerprints_give_the_first_pairs(spark, planted):
    """All sets whose fingerprints differ in at most four bits are connected by the pairs of the named method."""
    from edgeloom.llm.simhash import fingerprint_of
    from edgeloom.storage import Scratch

    sets = {i: shingles.shingle_set(t.encode()) for i, t in planted.items()}
    fp = {shingles._set_hash(s): fingerprint_of(s.view(np.uint64)) for s in sets.values()}
    table = spark.createDataFrame([(k, f - (1 << 64) if f >> 63 else f) for k, f in fp.items()], "sid long, fp long")
    root = {k: k for k in fp}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in shingles._fingerprint_pairs(table, Scratch(spark)).collect():
        root[find(r["a"])] = find(r["b"])
    close = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4]
    assert close and all(find(a) == find(b) for a, b in close)


def test_long_texts_of_one_passage_give_no_pairs(spark):
    """Sets of thousands of shingles flip most bits of the short sketch; they are told apart before pairs are made."""
    rng = np.random.default_rng(8)
    common = rng.integers(-(1 << 62), 1 << 62, 30)
    sets = [np.unique(np.concatenate([common, rng.integers(-(1 << 62), 1 << 62, n)])) for n in range(2500, 4500, 50)]
    sets += [np.unique(np.concatenate([sets[7][:-40], rng.integers(-(1 << 62), 1 << 62, 40)])), np.unique(rng.integers(-(1 << 62), 1 << 62, 40_000))]
    sets.append(sets[-1][:-900])
    wide = [shingles.wide_sketch(s) for s in sets]
    rows = [(1, len(sets), i, i, len(s), shingles.sketch(s), shingles.narrowed(w) or w) for i, (s, w) in enumerate(zip(sets, wide))]
    members = spark.createDataFrame(rows, "h long, n long, sid long, label long, m long, bits binary, wide binary")
    got = {(r["a"], r["b"]) for r in shingles._cross_pairs(members, 0.8, 16).collect()}
    assert got == {(7, 40), (41, 42)}
