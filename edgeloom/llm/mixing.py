"""Mixing sources to target weights with a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.text import seal, sealed, word_count
from edgeloom.storage import Scratch

WEIGHTS = (5, 2, 1)
#: Weight schedules by turns: relative weight at the begin and at the end of training, of mean 1.
SCHEDULES = ((1.0, 1.0), (1.5, 0.5), (0.5, 1.5))
MOST = 3


def by_turns(rank: Column, values) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), ((rank - 1) % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, most: int = MOST) -> DataFrame:
    """``(source, source_size, target, w0, w1)`` from ``(source, size)``, one row a source.

    All sizes are shared by weight; a target stops at ``most`` times its source's size and the excess is shared again by
    weight.  In order of cap over weight the stopped sources come first, so running sums over the sources give the level.
    Sources are ordered by code point, null last, to take weights and schedules by turns.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s = totals.withColumn("_r", rank).withColumn("w", by_turns(F.col("_r"), weights).cast("long")).withColumn("cap", F.col("source_size") * most)
    everything, order = Window.partitionBy(), Window.orderBy(F.col("cap").cast("double") / F.col("w"), "_r")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything)
    s = s.withColumn("all", total).withColumn("w_all", F.sum("w").over(everything))
    level = (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / (F.col("w_all") - F.coalesce(F.sum("w").over(before), F.lit(0))).cast("double")
    s = s.withColumn("stopped", F.col("cap").cast("double") < level * F.col("w"))
    rest = (F.col("all") - F.sum(F.when(F.col("stopped"), F.col("cap")).otherwise(0)).over(everything)).cast("double")
    free = F.sum(F.when(F.col("stopped"), 0).otherwise(F.col("w"))).over(everything).cast("double")
    s = s.withColumn("target", F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise(rest / free * F.col("w")))
    return s.select("source", "source_size", "target", by_turns(F.col("_r"), [a for a, _ in schedules]).alias("w0"), by_turns(F.col("_r"), [b for _, b in schedules]).alias("w1"))


def training_position(demand: Column) -> Column:
    """Inverts the integral of a linear schedule: the time in [0, 1] at which a source has been asked for ``demand`` of its target."""
    slope = F.col("w1") - F.col("w0")
    return F.when(slope == 0, demand).otherwise((F.sqrt(F.col("w0") * F.col("w0") + F.lit(2.0) * slope * demand) - F.col("w0")) / slope)


def mixing_plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", size_col: str | None = None, **options) -> DataFrame:
    """``(id_col, size, source_size, target, start, taken, w0, w1)``, one row for each row of ``docs``; see ``_planned``.

    Null text has size 0, null ids sort as the empty text, a null source is a source of its own; equal rows are rows of their
    own; an empty table gives an empty plan; other columns are not read.
    """
    size = F.col(size_col) if size_col else word_count(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("u0"), F.col(source_col).alias("u1"), size.alias("u2"))
    return _planned(rows, "u0", "u1", F.col("u2"), **options).select(F.col("u0").alias(id_col), "size", "source_size", "target", "start", "taken", "w0", "w1")


def _planned(docs: DataFrame, id_col: str, source_col: str, size: Column, digits: int = 3, **options) -> DataFrame:
    """All columns of sealed ``docs`` with ``size, source_size, target, start, taken, w0, w1``.

    A source's documents, in the order of the md5 of their id, form a stream that is read round and round until the source's
    target is met: ``start`` is the words before a document, ``taken`` the words read of it over all rounds, the last one
    possibly in part.  The running sum is taken in two steps, over 16^digits buckets of each source and within a bucket, so a
    source that holds a third of all rows is spread over as many tasks as there are buckets.
    """
    own = {"_md5": F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), "size": size}
    d = docs.withColumns(own).withColumn("_b", F.substring("_md5", 1, digits))
    # a key without nulls: windows and join then share one partitioning, and texts move once
    d = d.withColumn("_source", F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")))
    scratch = Scratch(docs.sparkSession)
    sums = scratch.save(d.groupBy(F.col(source_col).alias("source"), "_source", "_b").agg(F.sum("size").cast("long").alias("size")))
    before = F.sum("size").over(Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("source", F.col("_source").alias("_s"), F.col("_b").alias("_bucket"), F.coalesce(before, F.lit(0)).alias("_before"))
    targets = scratch.save(source_targets(sums, **options))
    table = offsets.join(targets, offsets["source"].eqNullSafe(targets["source"])).select("_s", "_bucket", "_before", "source_size", "target", "w0", "w1")
    within = Window.partitionBy("_source", "_b").orderBy("_md5", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = d.withColumn("_within", F.sum("size").over(within) - F.col("size"))
    out = placed.join(table, (F.col("_source") == F.col("_s")) & (F.col("_b") == F.col("_bucket")), "left")
    out = out.withColumn("start", F.col("_before") + F.col("_within"))
    taken = sum((take(c) for c in range(1, MOST)), take(0))
    return out.withColumn("taken", taken).drop("_b", "_source", "_within", "_s", "_bucket", "_before", "_md5")


def take(copy: int) -> Column:
    """Words read of a document in one round."""
    left = F.floor("target") - (F.col("source_size") * copy + F.col("start"))
    return F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.when(n >= word_count(text), text).otherwise(F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1), 1, n.cast("int")), ""))


def _reads(docs: DataFrame, id_col: str, source_col: str, size: Column, **options) -> DataFrame:
    """``_planned`` with a row for each time a document is read: ``_c`` is the round and the words read in it, ``_position`` the
    time in [0, 1] at which its source's schedule asks for it.  A document that is never read has one row with both null."""
    plan = _planned(docs, id_col, source_col, size, **options)
    rounds = F.array(*(F.struct(F.lit(c).alias("copy"), take(c).alias("words")) for c in range(MOST)))
    rows = plan.withColumn("_c", F.explode_outer(F.filter(rounds, lambda x: x["words"] > 0)))
    demand = (F.col("source_size") * F.col("_c.copy") + F.col("start")).cast("double") / F.col("target")
    return rows.withColumn("_position", F.when(F.col("_c").isNotNull(), training_position(demand)))


def mixed_sizes(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """``(id_col, size, source_size, target, reads, taken, position)``, one row for each row of ``docs``: how often and how many
    words the training stream of ``mix`` reads of it, and the position of its first read (null without one).

    Counted from the reads of the stream, without the texts; odd rows are taken as in ``mix``.
    """
    sizes = docs.select(F.col(id_col).alias("u0"), F.col(source_col).alias("u1"), word_count(F.col(text_col)).alias("u2"), F.monotonically_increasing_id().alias("u3"))
    reads = _reads(Scratch(docs.sparkSession).save(sizes), "u0", "u1", F.col("u2"), **options)
    same = [F.first(c).alias(c) for c in ("u0", "size", "source_size", "target")]
    counted = F.count("_c").alias("reads"), F.coalesce(F.sum("_c.words"), F.lit(0)).cast("long").alias("taken"), F.min("_position").alias("position")
    return reads.groupBy("u3").agg(*same, *counted).drop("u3").withColumnRenamed("u0", id_col)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The training stream: the columns of ``docs``, one row for each time a document is read, range-sorted by training
    position.  The document at the end of a source's target is cut after the word that meets it.

    Texts without words (null, empty, blank) are never read; null ids sort as the empty text, a null source is a source of its
    own; equal rows are read each; an empty table gives an empty stream; extra columns, of whatever name, are kept as they are.
    """
    names, id_col, source_col, text_col = docs.columns, seal(docs, id_col), seal(docs, source_col), seal(docs, text_col)
    docs = sealed(docs)
    rows = _reads(docs, id_col, source_col, word_count(F.col(text_col)), **options).filter(F.col("_c").isNotNull())
    text = F.when(F.col("_c.words") < F.col("size"), first_words(F.col(text_col), F.col("_c.words"))).otherwise(F.col(text_col))
    rows = rows.withColumn(text_col, text).select(*docs.columns, "_position")
    return rows.repartitionByRange(F.col("_position"), F.col(id_col)).sortWithinPartitions("_position", id_col).drop("_position").toDF(*names)
