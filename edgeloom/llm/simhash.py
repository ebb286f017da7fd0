"""SimHash near-dedup with pigeonring filtering."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.membership import without
from edgeloom.llm.text import field_type, map_arrow, seal, sealed, text_bytes
from edgeloom.operators.components import component_labels
from edgeloom.storage import Scratch

#: 64 bits in a ring of seven boxes; three of them are always free of errors when at most four bits differ.
WIDTHS = (10, 9, 9, 9, 9, 9, 9)
OFFSETS = tuple(int(x) for x in np.concatenate([[0], np.cumsum(WIDTHS)[:-1]]))
#: Members of a key compared in one block; larger keys are dealt out as pairs of blocks.
BLOCK = 2048
SHORT_RUN = 64


def shingle_hashes(text: bytes, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words, in order; fewer words are one shingle, no words none."""
    words = text.lower().split()
    n = len(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([digest(b" ".join(words), seed)] if n else [], np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist())], np.uint64)


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash over word shingles, repeats included; no words: 0."""
    return fingerprint_of(shingle_hashes(text, shingle, seed))


def fingerprint_of(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half the hashes."""
    if len(hashes) < 2:
        return int(hashes[0]) if len(hashes) else 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, keep_hash: bool = False) -> DataFrame:
    """``(id, fp)``, fp as a signed long; with ``keep_hash`` also ``th``, Spark's hash of the text."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            fps = np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64).tolist()
            yield list(zip(batch.column(0).to_pylist(), fps, batch.column(2).to_pylist()))

    cols = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("t"), (F.xxhash64(text_col) if keep_hash else F.lit(0).cast("long")).alias("th"))
    out = map_arrow(cols, run, f"id {field_type(docs, id_col)}, fp long, th long")
    return out if keep_hash else out.drop("th")


def segment_keys() -> list[str]:
    """One SQL expression for each set of three boxes: the set's number and the boxes' bits in one long."""
    out = []
    for number, boxes in enumerate(combinations(range(7), 3)):
        shift, parts = 0, []
        for b in boxes:
            parts.append(f"shiftleft(shiftrightunsigned(fp, {OFFSETS[b]}) & {(1 << WIDTHS[b]) - 1}L, {shift})")
            shift += WIDTHS[b]
        out.append(f"{number}L * {1 << 28}L + ({' | '.join(parts)})")
    return out


def viable(x: np.ndarray, limit: int = 4) -> np.ndarray:
    """Pigeonring: some start box i exists from which every chain of l consecutive boxes differs in at most l * limit / 7 bits."""
    boxes = [np.bitwise_count((x >> np.uint64(o)) & np.uint64((1 << w) - 1)) for o, w in zip(OFFSETS, WIDTHS)]
    found = np.zeros(x.shape, bool)
    for i in range(7):
        total = boxes[i].copy()
        good = total <= limit // 7
        for l in range(2, 7):
            if not good.any():
                break
            total += boxes[(i + l - 1) % 7]
            good &= total <= l * limit // 7
        found |= good
    return found


def _linked(a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Chains first, the full distance only for what is left."""
    x = a ^ b
    out = viable(x, limit)
    out[out] = np.bitwise_count(x[out]) <= limit
    return out


def _forest(fp: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Links (member, first of its class) within one block; as many as members at most."""
    n = len(fp)
    near = np.zeros((n, n), bool)
    for i in range(0, n, 256):
        near[i : i + 256] = _linked(fp[i : i + 256, None], fp[None, :], limit)
    free, out = np.ones(n, bool), []
    for root in range(n):
        if not free[root]:
            continue
        free[root] = False
        front = np.array([root])
        while len(front):
            front = np.flatnonzero(near[front].any(axis=0) & free)
            free[front] = False
            out += [(m, root) for m in front.tolist()]
    return out


def link_rows(keys: np.ndarray, fp: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows of equal key; keys come sorted.  Short runs are compared shift by shift, long ones as a block."""
    n = len(keys)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if n else np.array([], np.int64)
    ends = np.concatenate([starts[1:], [n]]) if n else starts
    size = ends - starts
    end_of = np.repeat(ends, size)
    long = np.repeat(size > SHORT_RUN, size)
    a, b = [], []
    at = np.flatnonzero(~long)
    for d in range(1, SHORT_RUN):
        at = at[at + d < end_of[at]]
        if not len(at):
            break
        good = at[_linked(fp[at], fp[at + d], limit)]
        a.append(fp[good])
        b.append(fp[good + d])
    for s, e in zip(starts[size > SHORT_RUN].tolist(), ends[size > SHORT_RUN].tolist()):
        pairs = np.array(_forest(fp[s:e], limit), np.int64).reshape(-1, 2)
        a.append(fp[s:e][pairs[:, 0]])
        b.append(fp[s:e][pairs[:, 1]])
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def fingerprint_links(distinct: DataFrame, limit: int = 4, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints that connect exactly the pairs at most ``limit`` bits apart (and whatever
    such pairs connect).  Keys held by more than ``block`` fingerprints are dealt out over pairs of blocks, so no task gets a
    whole large key and every pair still meets."""
    if limit != 4:
        raise ValueError("the ring of seven boxes is laid out for 4 differing bits")
    scratch = Scratch(distinct.sparkSession)
    keyed = distinct.select("fp", F.explode(F.array(*map(F.expr, segment_keys()))).alias("key"))
    hot = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("nb"))
    hot = scratch.save(hot)
    one = F.array(F.lit(0).cast("long"))
    if hot.isEmpty():
        dealt = keyed.select("key", "fp", F.lit(0).cast("long").alias("part"))
    else:
        mine = F.pmod(F.xxhash64("fp"), F.col("nb").cast("long"))
        parts = F.when(F.col("nb").isNull(), one).otherwise(F.expr("transform(sequence(0L, nb - 1L), x -> least(x, mine) * nb + greatest(x, mine))"))
        dealt = keyed.join(hot, "key", "left").withColumn("mine", mine).select("key", "fp", F.explode(parts).alias("part"))

    def run(batches):
        held_k = np.array([], np.int64)
        held_p, held_f = held_k, np.array([], np.uint64)
        for batch in _then_none(batches):
            if batch is not None:
                k, p, f = (batch.column(i).to_numpy() for i in range(3))
                held_k, held_p, held_f = np.concatenate([held_k, k]), np.concatenate([held_p, p]), np.concatenate([held_f, f.view(np.uint64)])
                if not len(held_k):
                    continue
                last = np.flatnonzero((held_k != held_k[-1]) | (held_p != held_p[-1]))
                cut = int(last[-1]) + 1 if len(last) else 0
            else:
                cut = len(held_k)
            group = np.cumsum(np.concatenate([[0], (held_k[1:cut] != held_k[: cut - 1]) | (held_p[1:cut] != held_p[: cut - 1])])) if cut else held_k[:0]
            a, b = link_rows(group, held_f[:cut], limit)
            held_k, held_p, held_f = held_k[cut:], held_p[cut:], held_f[cut:]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    rows = dealt.select("key", "part", "fp").repartition("key", "part").sortWithinPartitions("key", "part")
    return rows.mapInArrow(run, "a long, b long")


def _then_none(batches):
    yield from batches
    yield None


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, limit: int = 4, keep_hash: bool = False) -> DataFrame:
    """``(id, fp, class_fp, component_id)`` for every row: fingerprints at most ``limit`` bits apart are linked, classes are
    what links connect, ``component_id`` is the least id of the class.

    Null text counts as empty (fingerprint 0); repeated rows each keep their row; null ids are members but never name a
    class unless all ids of it are null; an empty table gives an empty result; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(fingerprints(docs, id_col, text_col, shingle, seed, keep_hash))
    least = scratch.save(rows.groupBy("fp").agg(F.min("id").alias("least_id")))
    links = fingerprint_links(least.select("fp"), limit)
    labels = component_labels(links).select(F.col("node").alias("fp"), F.col("component").alias("class_fp"))
    named = least.join(labels, "fp", "left").select("fp", "least_id", F.coalesce("class_fp", "fp").alias("class_fp"))
    named = scratch.save(named)
    classes = named.groupBy("class_fp").agg(F.min("least_id").alias("component_id"))
    by_fp = scratch.save(named.select("fp", "class_fp").join(classes, "class_fp"))
    return rows.join(by_fp, "fp")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes_of=simhash_classes, **options) -> DataFrame:
    """The rows of ``docs`` without near-duplicates, which ``classes_of`` finds: of each class the row of least id stays; null
    ids come last, and of rows that agree in id and class one stays.

    Null and empty texts are of one class; an empty table gives an empty one; extra columns, of whatever name, are kept as
    they are.
    """
    scratch = Scratch(docs.sparkSession)
    classes = scratch.save(classes_of(docs, id_col, text_col, keep_hash=True, **options))
    heads = classes.filter(F.col("id").eqNullSafe(F.col("component_id")))
    first = F.row_number().over(Window.partitionBy("class_fp").orderBy("th"))
    stay = scratch.save(heads.withColumn("_n", first).filter("_n = 1").select(F.col("id").alias("_id"), F.col("th").alias("_th")))
    rows = classes.select(F.col("id").alias("_id"), F.col("th").alias("_th"))
    gone = scratch.save(rows.join(stay.withColumnsRenamed({"_id": "_i", "_th": "_t"}), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_t")), "left_anti"))
    repeated = heads.groupBy("id", "th").count().filter("count > 1").limit(1).count() > 0
    scratch.drop(classes, stay)
    kept = without(sealed(docs), seal(docs, id_col), seal(docs, text_col), gone)
    if repeated:
        kept = kept.dropDuplicates([seal(docs, id_col), "_h"])
    return kept.drop("_h").toDF(*docs.columns)
