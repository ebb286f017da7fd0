"""Line dedup by winnowing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.membership import in_map, map_of, split
from edgeloom.llm.text import free_name, seal, sealed, word_count
from edgeloom.storage import Scratch

MIN_WORDS = 50
BLANKS = " \t\n\x0b\x0c\r"


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, th, pos, d, words)`` of every line that holds a word; lines are equal if equal after trimming, and ``d`` is the
    md5 of the trimmed line, which stands for it from here on."""
    raw = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    trimmed = raw.withColumn("line", F.trim("line", F.lit(BLANKS))).filter("line <> ''")
    return trimmed.select("id", "th", "pos", F.unhex(F.md5(F.col("line").cast("binary"))).alias("d"), word_count(F.col("line")).cast("int").alias("words"))


def windows(rows: DataFrame, min_words: int, line_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``(id, th, start, end, mark, at, c1, c2)``: the shortest runs of lines of at least ``min_words`` words, taken forward from
    each line and backward from each line (runs that are both, once).

    A forward run is a winnowing window: it selects the line with the least hash, the last of equals, as its fingerprint
    ``mark`` at position ``at``.  The place moves on only where a window selects another line, and ``at`` is null in windows
    that select the same as the one before; a backward run has the mark of the forward run that begins where it does.
    ``c1, c2`` are two 64-bit hashes of the md5s of the run's lines.
    """
    doc = Window.partitionBy("id", "th")
    run = doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = rows.withColumn("h", line_hash(F.col("d"))).withColumn("e", F.sum("words").over(run)).withColumn("s", F.col("e") - F.col("words")).withColumn("total", F.sum("words").over(doc))
    ahead = doc.orderBy("s").rangeBetween(0, min_words - 1)
    back = doc.orderBy("e").rangeBetween(-(min_words - 1), 0)
    least = F.min(F.struct("h", (-F.col("pos")).alias("at"))).over(ahead)
    s = s.withColumn("fd", F.collect_list("d").over(ahead)).withColumn("fend", F.max("pos").over(ahead)).withColumn("f", least)
    s = s.withColumn("fresh", F.coalesce(F.lag("f.at").over(doc.orderBy("s")) != F.col("f.at"), F.lit(True)))
    s = s.withColumn("bd", F.collect_list("d").over(back)).withColumn("bstart", F.min("pos").over(back)).withColumn("bs", F.min("s").over(back)).withColumn("bmark", F.first("f.h").over(back))

    def entry(ok, a, b, mark, at, ds):
        named = {"start": a.cast("int"), "end": b.cast("int"), "mark": mark, "at": at.cast("int"), "c1": F.xxhash64(ds), "c2": F.xxhash64(F.lit(1), ds)}
        return F.when(ok, F.struct(*(c.alias(n) for n, c in named.items())))

    forward = entry(F.col("total") - F.col("s") >= min_words, F.col("pos"), F.col("fend"), F.col("f.h"), F.when(F.col("fresh"), -F.col("f.at")), F.col("fd"))
    backward = entry(F.col("s") - F.col("bs") >= min_words, F.col("bstart"), F.col("pos"), F.col("bmark"), F.lit(None), F.col("bd"))
    return s.select("id", "th", F.explode(F.array_compact(F.array(forward, backward))).alias("x")).select("id", "th", "x.*")


def repeated_runs(w: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, th, start, end)`` of the runs of ``windows`` that have an earlier equal.

    Two equal runs select the same line, so a run whose fingerprint is found at one place only has no equal; a bit map of the
    fingerprints found twice or more, of fixed size, passes over such runs where they lie.  At the fingerprints that are left,
    matches are extended both ways: all runs around one are compared, by the 128 bits of their lines, with the earliest place
    (least id, then hash of the text, then line) that has them, and ``merged`` joins those side by side to whole passages.
    Comparing with the earliest place only keeps the work in proportion to the places of a fingerprint, not to their pairs.  A
    run that overlaps the earliest place in the same document stays.
    """
    twice = w.filter("at is not null").groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    w = in_map(w, F.col("mark"), map_of(twice, F.col("mark"))).filter("_maybe").drop("_maybe")
    first = w.groupBy("c1", "c2").agg(F.min(F.struct("id", "th", "start", "end")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    both = w.join(scratch.save(first), ["c1", "c2"])
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th"))
    return both.filter(~(same & (F.col("start") <= F.col("first.end")))).select("id", "th", "start", "end")


def merged(runs: DataFrame) -> DataFrame:
    """``(id, th, gone)``: the runs of each document as disjoint intervals ``(start, end)`` in order."""
    before = Window.partitionBy("id", "th").orderBy("start", "end")
    reach = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    apart = runs.withColumn("new", F.coalesce(F.col("start") > reach + 1, F.lit(True)).cast("int"))
    islands = apart.withColumn("island", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy("id", "th", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return spans.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("gone"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, scratch: Scratch | None = None, line_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``(id, th, gone)``: of each document the intervals of line positions that are later repeats."""
    scratch = scratch or Scratch(docs.sparkSession)
    rows = lines(docs, id_col, text_col).repartition("id", "th").dropDuplicates(["id", "th", "pos"])
    return merged(repeated_runs(scratch.save(windows(rows, min_words, line_hash)), scratch))


def cut(text: Column, gone: Column) -> Column:
    """The text without the lines of the intervals, put together from what lies between them."""
    parts = F.split(text, "\n")
    begin = lambda k: F.coalesce(F.get(gone, k - 1)["end"] + 1, F.lit(0))
    end = lambda k: F.coalesce(F.get(gone, k)["start"], F.size(parts))
    between = F.transform(F.sequence(F.lit(0), F.size(gone)), lambda k: F.slice(parts, begin(k) + 1, end(k) - begin(k)))
    return F.array_join(F.flatten(between), "\n")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, count_col: str | None = "removed_lines", line_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``docs`` with later repeats of runs of at least ``min_words`` words deleted from the texts, and the number of lines
    deleted as ``count_col`` (None: without it; where ``docs`` has that name already, underscores are added to ours).

    The earliest occurrence stays.  Rows with equal id and text are one document and treated alike.  Null text stays null, an
    empty one empty; lines without a word stay; null ids are compared like any other (first); an empty table gives an empty
    one; extra columns, of whatever name, are kept as they are.
    """
    scratch = Scratch(docs.sparkSession)
    gone = repeated_lines(docs, id_col, text_col, min_words, scratch, line_hash)
    gone = scratch.save(gone).select(F.col("id").alias("_id"), F.col("th").alias("_th"), "gone")
    i, t = seal(docs, id_col), seal(docs, text_col)
    free, held = split(sealed(docs), i, t, gone)
    d = held.join(gone, F.col(i).eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_th")), "left")
    d = d.withColumn(t, F.when(F.col("gone").isNull(), F.col(t)).otherwise(cut(F.col(t), F.col("gone"))))
    count = F.coalesce(F.aggregate("gone", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"] + 1), F.lit(0).cast("long"))
    out = free.withColumn("_n", F.lit(0).cast("long")).unionByName(d.withColumn("_n", count).drop("_id", "_th", "gone")).drop("_h")
    return out.toDF(*docs.columns, free_name(docs, count_col)) if count_col else out.drop("_n").toDF(*docs.columns)
