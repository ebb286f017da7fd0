"""Every operator on odd tables and on an empty one."""

import pytest
from pyspark.sql import functions as F

from edgeloom.llm import licenses, linededup, lmscore, mixing, packing, quality, shingles, simhash, topk, toxicity, urls

DOCS = {
    "simhash": lambda d, s: simhash.simhash_classes(d),
    "near_dedup": lambda d, s: simhash.near_dedup(d),
    "pack": lambda d, s: packing.pack(d),
    "licenses": lambda d, s: licenses.license_matches(d),
    "plan": lambda d, s: mixing.mixing_plan(d),
    "mix": lambda d, s: mixing.mix(d),
    "toxicity": lambda d, s: toxicity.toxicity_scores(d, s.createDataFrame([(1, 1, 1), (5, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")),
    "quality": lambda d, s: quality.quality_scores(d),
    "quality_filter": lambda d, s: quality.quality_filter(d),
    "lines": lambda d, s: linededup.line_dedup(d),
    "lm": lambda d, s: lmscore.lm_scores(d),
}
ROW_EACH = {"simhash", "plan", "toxicity", "quality", "lines", "lm"}


@pytest.mark.parametrize("name", DOCS)
def test_odd_rows(spark, odd, name):
    n = DOCS[name](odd, spark).count()
    if name in ROW_EACH:
        assert n == odd.count()


@pytest.mark.parametrize("name", DOCS)
def test_empty_table(spark, none, name):
    assert DOCS[name](none, spark).count() == 0


def test_near_dedup_keeps_one_of_each(odd):
    got = [r["doc_id"] for r in simhash.near_dedup(odd).collect()]
    # null and blank texts share fingerprint zero with the empty one; long copies are one group
    assert sorted(x for x in got if x is not None) == [1, 2, 5, 7]
    assert got.count(None) == 1


def test_plan_of_odd_rows(odd):
    rows = mixing.mixing_plan(odd).collect()
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert abs(sum(r["taken"] for r in rows) - sum(r["size"] for r in rows)) <= 10


STAGES = {
    "mix": mixing.mix,
    "quality_filter": quality.quality_filter,
    "near_dedup": simhash.near_dedup,
    "near_dedup_shingles": lambda d: simhash.near_dedup(d, classes_of=shingles.similar_classes, shingle=5, similarity=0.8),
    "line_dedup": lambda d: linededup.line_dedup(d, count_col=None),
}
OWN = "_b _c _copy _h _i _id _k _l _lang _lid _map _maybe _md5 _n _p _piece _position _r _s _source _t _th _within a at b bits c1 class_fp component_id d e end first fp gone h held id k key line m mark n pos removed_lines s sid size source_size start stopped t taken target th total u0 u1 u9 w w0 w1 wide words x".split()


@pytest.mark.parametrize("stage", STAGES)
def test_clashing_columns(spark, stage):
    """Columns with every name an operator uses inside keep their values, types and places."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{text} {i % 3}" if i < 6 else f"own {i} " + text[i * 7 :], "en", "ab"[i % 2], 9) for i in range(9)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    more = plain.select(*(F.concat(F.lit(f"{c}="), "doc_id").alias(c) for c in OWN), *plain.columns)
    got = STAGES[stage](more)
    assert got.columns == more.columns and got.dtypes == more.dtypes
    kept = got.collect()
    assert kept and all(r[c] == f"{c}={r['doc_id']}" for r in kept for c in OWN)
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted((r["doc_id"], r["text"]) for r in STAGES[stage](plain).collect())


def test_line_count_column_gives_way(spark):
    df = spark.createDataFrame([(1, "a", 5)], "doc_id long, text string, removed_lines int")
    assert [r.asDict() for r in linededup.line_dedup(df).collect()] == [{"doc_id": 1, "text": "a", "removed_lines": 5, "removed_lines_": 0}]


def test_urls_odd(spark):
    rows = [(1, None, "h"), (1, None, "h"), (None, "http://A.Example.COM/en/71?x", "h"), (3, "", None), (4, "no scheme/en/", "h"), (5, "x://com/en/#a", "h"), (6, "http://notexample.com/fr/" + "é" * 5000, "h"), (7, "ftp://net?/de/", "h")]
    p = spark.createDataFrame(rows, "page_id long, url string, score string")
    got = {r["page_id"]: r for r in urls.url_verdicts(p).collect() if r["page_id"] != 1}
    assert (got[None]["host"], got[None]["path"], got[None]["rule"], got[None]["verdict"]) == ("a.example.com", "/en/71", "example.com/en/7", "allow")
    assert (got[4]["host"], got[4]["path"], got[4]["rule"]) == ("", "", None)
    assert (got[5]["rule"], got[5]["verdict"]) == ("com/en/", "block")
    assert (got[7]["host"], got[7]["path"], got[7]["rule"]) == ("net", "", None)
    assert urls.url_verdicts(p).count() == 8
    assert urls.url_verdicts(p.filter("false")).count() == 0


def test_topk_odd(spark):
    nan, inf = float("nan"), float("inf")
    v = [(20, [1.0, 0.5], "x"), (40, [0.0, 0.0], "x"), (1, [1.0, 0.5], None), (2, [1.0, 0.5], "x"), (3, [nan, 1.0], "x"), (4, None, "x"), (5, [None, 1.0], "x"), (6, [inf, 0.0], "x"), (None, [1.0, 1.0], "x"), (60, [], "x")]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>, score string")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in topk.top_k(df).collect()]
    assert sorted(got) == [(20, 1, 1), (20, 2, 2), (20, 3, 40), (40, 1, 1), (40, 2, 2), (40, 3, 20)]
    assert topk.top_k(df.filter("false")).count() == 0


def test_licenses_brute_force(spark):
    words = "on the other side of a long river there was nothing to read at all".split()
    texts = [None, "", "MIT", "Released under the MIT License.", " ".join(words * 20), " ".join(words) + "\nLicensed under CC BY-NC 4.0. " + " ".join(words)]
    grant = licenses.TEMPLATES[9][1]
    cut = grant.replace("free of charge", "gratis")
    texts += [" ".join(words * 9) + " " + grant + " " + " ".join(words * 7), " ".join(words * 3) + cut, grant[: len(grant) // 2]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["license"]) for r in licenses.license_matches(df).collect()}
    import re

    shingles = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"[^\W_]+", (t or "").lower())] for i in range(len(w) - 4)}
    want = {(i, name) for i, t in enumerate(texts) for name, tpl in licenses.TEMPLATES if len(shingles(t) & shingles(tpl)) >= 0.8 * len(shingles(tpl))}
    assert got == want


def test_topk_very_common_vector(spark, monkeypatch):
    """Half of the rows are one vector: its annulus is cut into blocks, visited blocks are copied, answers stay exact."""
    import numpy as np

    monkeypatch.setattr(topk, "VISITS", 40)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4)).astype(np.float32)
    x[rng.random(len(x)) < 0.5] = x[0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = {}
    for r in topk.top_k(df, k=5, block=64).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    v = np.floor(x.astype(float) * 64).astype(int)
    for q in range(0, len(v), 20):
        s = v @ v[q]
        best = [i for i in np.lexsort((np.arange(len(s)), -s))[:6].tolist() if i != q][:5]
        assert sorted(got[q]) == [(n + 1, i, s[i]) for n, i in enumerate(best)]


@pytest.mark.parametrize("width", [2, 8])
def test_topk_mixed_norms(spark, width):
    """Short queries and a few long candidates; so many rows that annuli are pruned."""
    import numpy as np

    rng = np.random.default_rng(width)
    x = rng.normal(size=(6000, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[rng.random(len(x)) < 0.01] *= 4
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = {}
    for r in topk.top_k(df).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    v = np.floor(x.astype(float) * 64).astype(int)
    for q in range(0, len(v), 20):
        s = v @ v[q]
        best = [i for i in np.lexsort((np.arange(len(s)), -s))[:21].tolist() if i != q][:20]
        assert got[q] == {n + 1: (i, s[i]) for n, i in enumerate(best)}


def test_sizes_are_those_of_the_stream(spark, odd):
    """What op5 reports of each document is what the stream of ``mix`` holds of it, all rounds counted."""
    rows = [(i, " ".join(["w"] * (i % 7)), "abc"[min(i % 11, 2)]) for i in range(200)]
    d = spark.createDataFrame([*rows, (200, None, None), (201, "x y", None)], "doc_id long, text string, source string")
    want = {}
    for place, r in enumerate(mixing.mix(d).collect()):
        n, words, first = want.get(r["doc_id"], (0, 0, place))
        want[r["doc_id"]] = n + 1, words + len(r["text"].split()), first
    got = {r["doc_id"]: r for r in mixing.mixed_sizes(d).collect()}
    assert len(got) == 202 and max(n for n, _, _ in want.values()) > 1
    assert all((r["reads"], r["taken"]) == want.get(i, (0, 0))[:2] for i, r in got.items())
    read = sorted(want, key=lambda i: (got[i]["position"], i))
    assert read == sorted(want, key=lambda i: want[i][2]) and all((r["position"] is None) == (i not in want) for i, r in got.items())
    assert mixing.mixed_sizes(odd).count() == odd.count()


def test_op5_reads_the_stream(spark, sf, monkeypatch):
    from edgeloom.llm import queries

    seen, reads = [], mixing._reads
    monkeypatch.setattr(mixing, "_reads", lambda *a, **k: seen.append(1) or reads(*a, **k))
    assert queries.op5_mixing(spark, sf).count() and seen


def test_hosts_under_www_are_judged(spark):
    """Hosts with only www or m before a domain of two labels have the domain's name and its score."""
    hosts = ["www.casino-slots.com", "m.casino-slots.com", "casino-slots.com", "www.com", "m.www.net", "a.www.casino.example.com", "www.", "..", ""]
    got = spark.createDataFrame([(i, h) for i, h in enumerate(hosts)], "i int, h string").select("i", urls.site_name(F.col("h")).alias("n")).collect()
    assert [r["n"] for r in sorted(got)] == ["casino-slots", "casino-slots", "casino-slots", "www", "www", "a.casino", "www", "", ""]
    names = ["thetha", "thether", "tionthe", "ththere", "tionher", "thether.blog", "hereth", "nthere", "therion", "tithe"]
    pages = [(i, f"https://{n}.example.org/en/{i}") for i, n in enumerate(names)] + [(90 + i, f"http://{h}/x") for i, h in enumerate(hosts[:3])]
    rows = {r["page_id"]: r for r in urls.url_verdicts(spark.createDataFrame(pages, "page_id long, url string")).collect()}
    assert all(rows[i]["score"] == rows[92]["score"] and rows[i]["verdict"] == rows[92]["verdict"] == "block" for i in (90, 91))


def test_url_rules_of_the_contract(spark):
    """One URL for each rule and for a longer path, with the words of the contract."""
    want = {"http://a.com/en/1": "block", "http://www.example.com/en/71": "allow", "http://a.net/de/1": "allow", "http://m.example.net/de/81": "block", "http://example.net/de/71": "allow", "http://a.org/es/1": "block"}
    rows = urls.url_verdicts(spark.createDataFrame(list(enumerate(want)), "page_id long, url string")).collect()
    assert {(list(want)[r["page_id"]], r["verdict"]) for r in rows} == set(want.items())
    assert all(r["rule"] for r in rows)


def test_urls_judged_whole(spark):
    """A domain's own label below a subdomain, path and query are judged like the name."""
    rows = [(i, u) for i, u in enumerate(r["url"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect())]
    bad = ["http://blog.casino-slots.com/en/3", "http://ththon.example.com/en/casino-bonus/7", "http://ththon.example.com/en/5?u=best-jackpot-slots", "http://a.b.online-bets.co.uk/en/9"]
    good = ["http://blog.theron.com/en/3", "http://ththon.example.com/fr/4?page=2&ref=x", "http://ththon.co.uk/en/9"]
    df = spark.createDataFrame([*rows, *((-1 - i, u) for i, u in enumerate(bad + good))], "page_id long, url string")
    verdict = {r["page_id"]: r["verdict"] for r in urls.url_verdicts(df, rules=()).collect()}
    assert [verdict[-1 - i] for i in range(len(bad + good))] == ["block"] * len(bad) + ["allow"] * len(good)
