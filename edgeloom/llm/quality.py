"""Quality rules: counts, and the divergence of a document's histograms from its language's."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.membership import without
from edgeloom.llm.text import field_type, map_arrow, seal, sealed, text_bytes
from edgeloom.storage import Scratch

GRAM = 8
#: Texts with fewer words are not judged by their histograms.
MIN_JUDGED_WORDS = 50
#: Between the labelled documents of the 0.1 table: good ones end at 0.31, then bad ones go on.
MAX_DISTANCE = 0.32
#: Languages with fewer words in all have no reference; their documents are judged by the base rules alone.
MIN_REFERENCE_WORDS = 2000
#: Common words by language, fixed values.
COMMON_WORDS = {
    "de": "aber als auch auf das dem den der des die du ein eine er es für ich im in ist mit nicht sich sie und von wie zu",
    "en": "a and are as at be by for from have he in is it not of on or that the this to was with you",
    "es": "a al como con de del el en es la las lo los más me no para pero por que se si su un una y",
    "fr": "à au avec ce dans de des du elle en est et il je la le les ne pas pour qui que se sur un une",
}
LOWER, UPPER, DIGIT, SPACE, PUNCT, SYMBOL, OTHER, HIGH = range(8)
CLASSES = np.full(256, OTHER, np.int64)
CLASSES[128:] = HIGH
CLASSES[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = LOWER
CLASSES[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = UPPER
CLASSES[[ord(c) for c in "0123456789"]] = DIGIT
CLASSES[[ord(c) for c in " \t\n\r\x0b\x0c"]] = SPACE
CLASSES[[ord(c) for c in ".,;:!?'\"()-"]] = PUNCT
CLASSES[[ord(c) for c in "#*$%&|<>"]] = SYMBOL
CONTINUATION = slice(0x80, 0xC0)
STRIP = b".,;:!?'\"()-|"
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars array<int>, common array<int>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated_words(ids: np.ndarray, gram: int = GRAM) -> int:
    """Words that lie in some window of ``gram`` words found at least twice."""
    n = len(ids) - gram + 1
    if n < 2:
        return 0
    r = _mixed(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    h = np.zeros(n, np.uint64)
    for k in range(gram):
        h = h * np.uint64(0x5851F42D4C957F2D) + r[k : n + k]
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + gram, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def features(text: bytes, common: list[bytes]) -> tuple:
    words = text.split()
    n = len(words)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points = int(hist.sum() - hist[CONTINUATION].sum())
    spaces = int(hist[[9, 10, 11, 12, 13, 32]].sum())
    symbols = int(hist[[ord(c) for c in "#*$%&|<>"]].sum())
    met, dups = set(), 0
    for line in text.split(b"\n"):
        if line in met:
            dups += bool(line.strip())
        else:
            met.add(line)
    chars = np.bincount(CLASSES, weights=hist, minlength=8).astype(int)
    chars[HIGH] -= int(hist[CONTINUATION].sum())
    folded: dict[bytes, int] = {}
    if common:
        times = np.bincount(ids, minlength=len(seen))
        for w, i in seen.items():
            if len(w) < 10:
                w = w.lower().strip(STRIP)
                folded[w] = folded.get(w, 0) + int(times[i])
    found = [folded.get(w, 0) for w in common]
    return n, points - spaces, symbols, dups, repeated_words(ids), chars.tolist(), [*found, n - sum(found)]


def js_distance(p, total, q):
    """Jensen-Shannon distance (base 2, 0 to 1) of a count array and an array of shares."""

    def term(x, y):
        m = (x + y) / 2
        part = lambda z: F.when(z > 0, z * F.log2(z / m)).otherwise(0.0)
        return (part(x) + part(y)) / 2

    parts = F.zip_with(p, q, lambda x, y: term(x / total, y))
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def quality_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_distance: float = MAX_DISTANCE, keep_hash: bool = False) -> DataFrame:
    """``(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept)`` for each row.

    A language's reference is the sum of the histograms of all its documents: character classes, and its common words with all
    other words as one kind.  The distance is the mean of the two Jensen-Shannon distances, and that of the character classes alone
    where a language has no list of common words.  A document is kept if it passes
    the base rules and its distance is at most ``max_distance``, or was not taken: fewer than 50 words, or a language without
    2,000 words in all.  Null text is empty (and fails the base rules), a null language is one of its own without common words,
    repeated rows count each, an empty table gives no rows, other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    lists = {k: [w.encode() for w in v.split()] for k, v in COMMON_WORDS.items()}

    def run(batches):
        for b in batches:
            ids, langs, texts, th = (b.column(i).to_pylist() for i in range(4))
            yield [(i, g, *features(t, lists.get(g, [])), h) for i, g, t, h in zip(ids, langs, texts, th)]

    cols = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), text_bytes(text_col).alias("t"), (F.xxhash64(text_col) if keep_hash else F.lit(0).cast("long")).alias("th"))
    f = scratch.save(map_arrow(cols, run, f"id {field_type(docs, id_col)}, lang string, {FEATURES}, th long"))
    long_f = f.select("lang", "n_words", F.posexplode(F.concat("chars", "common")).alias("pos", "x"))
    sums = long_f.groupBy("lang", "pos").agg(F.sum("x").alias("x"), F.sum("n_words").alias("n"))
    kind = (F.col("pos") >= 8).cast("int")
    totals = sums.groupBy(F.col("lang").alias("_l"), kind.alias("_k")).agg(F.sum("x").cast("double").alias("total"), F.max("n").alias("all_words"))
    shares = sums.join(totals, F.col("lang").eqNullSafe(F.col("_l")) & (kind == F.col("_k"))).withColumn("y", F.when(F.col("total") > 0, F.col("x") / F.col("total")).otherwise(0.0))
    ref = shares.groupBy(F.col("lang").alias("_lang")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "y"))), lambda s: s["y"]).alias("r"), F.max("all_words").alias("all_words"))
    ref = scratch.save(ref)
    d = f.join(ref, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    d = d.withColumn("_chars", F.greatest(F.aggregate("chars", F.lit(0), lambda s, x: s + x), F.lit(1)))
    words = F.expr("slice(r, 9, size(r) - 8)")
    by_chars = js_distance(F.col("chars"), F.col("_chars"), F.slice("r", 1, 8))
    by_words = js_distance(F.col("common"), F.greatest("n_words", F.lit(1)), words)
    # without a list all words are one kind, whose distance is always 0
    distance = F.when(F.size("common") > 1, (by_chars + by_words) / 2).otherwise(by_chars)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = (F.col("n_words") >= MIN_JUDGED_WORDS) & (F.col("all_words") >= MIN_REFERENCE_WORDS)
    d = d.withColumn("distance", F.when(judged, distance)).withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= max_distance, F.lit(True))
    return d.select("id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"), *(["th"] if keep_hash else []))


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` that are kept; of rows with equal id and text all go if one is rejected (their languages may differ).

    Null and empty texts fail the base rules and go; null ids are compared like any other; an empty table gives an empty one;
    extra columns, of whatever name, are kept as they are.
    """
    scratch = Scratch(docs.sparkSession)
    gone = quality_scores(docs, id_col, text_col, lang_col, keep_hash=True, **options).filter("not kept")
    gone = scratch.save(gone.select(F.col("id").alias("_id"), F.coalesce("th", F.xxhash64(F.lit(None).cast("string"))).alias("_th")).distinct())
    kept = without(sealed(docs), seal(docs, id_col), seal(docs, text_col), gone).drop("_h")
    return kept.toDF(*docs.columns)
