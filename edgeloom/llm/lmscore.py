"""LM scoring with a hierarchical Pitman-Yor model whose restaurants grow with the corpus.

Every word has a restaurant with a customer for each pair that begins with it; the parent all of them share is the root over
all words.  Restaurants are ``(pair, customers, tables)`` in Spark tables, so their number and size follow the corpus; in sweeps
they lie and travel as arrays.  A pair found once is one customer at a table of its own in every sweep; such pairs are counted with their context, and have
rows only where a score needs them.
"""

from __future__ import annotations

import gc
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.classes import blobs, class_count, class_keys, class_edges, dealt, in_classes, partitions, spread, spread_key, unspread, unspread_key, whole
from edgeloom.llm.seating import draw, expected
from edgeloom.llm.text import field_type, fold, text_bytes
from edgeloom.llm.words import END, Counts, Lookup, Tokens, binary_column, column_hashes, column_slices, gathered, hashes_of
from edgeloom.storage import Scratch

#: Words and pairs that every task holds, the most frequent ones; those of all others are joined.  Results do not depend on it.
HELD, HELD_PAIRS = 131_072, 1 << 20
#: Bits of the map that tells pairs which surely have no restaurant row: 16 MB.
MAP_BITS = 1 << 27
SWEEPS, BURN_IN = 3, 1
STRENGTH = 1.0
UNKNOWN = 0.5
FLUSH, COMMON, PAIRS = 1_000_000, 32_768, 1_000_000
#: Cells of a chunk and, about, keys of a class: what a task of a sweep holds at once.
CHUNK, KEYS = 1 << 20, 1 << 18
START = 0xFFFFFFFF
#: Begins no UTF-8, so it is no word.
NO_WORD = b"\xff"
LOW = 0xFFFFFFFF


def rung(c: Column) -> Column:
    """Counts up to 64 as they are, greater ones in steps of an eighth of a doubling: a few hundred values at any size."""
    return F.when(c <= 64, c).otherwise(F.floor(F.log2(c) * 8) + 16).cast("long")


def _count(r: int) -> int:
    return r if r <= 64 else round(2 ** ((r - 15.5) / 8))


def least_rung(steps: dict[int, int], most: int) -> int:
    """The lowest rung from which on there are at most ``most`` rows."""
    reach, least = 0, 1 << 40
    for r in sorted(steps, reverse=True):
        reach += steps[r]
        if reach > most:
            break
        least = r
    return least


def discount(one: int, two: int) -> float:
    return min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5


def keys_of(words: list[bytes]) -> np.ndarray:
    return hashes_of(words) & np.uint64(LOW)


def pairs_of(t: Tokens) -> np.ndarray:
    """The pairs of some texts: the key of the word before (of the start for a text's first) in the high half, the word's in the low."""
    keys = t.hash & np.uint64(LOW)
    before = np.empty_like(keys)
    before[1:] = keys[:-1]
    before[t.starts[:-1]] = START
    return (before << np.uint64(32)) | keys


def word_table(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """``(word, c, key)`` over the training texts; every text ends with the end token (the empty word).  Tasks count in memory
    up to a fixed number of words besides the commonest, then hand on partial counts; the commonest words of a task's first slice are
    looked up and counted as arrays."""

    def counted(words, keys, counts):
        return pa.RecordBatch.from_arrays([words, pa.array((keys & np.uint64(LOW)).view(np.int64)), pa.array(counts)], names=["word", "key", "c"])

    def flushed(held):
        for hash_, chars, offsets, c in held.sums():
            for s in range(0, len(c), 100_000):
                to = offsets[s : s + 100_001]
                yield counted(binary_column(chars[to[0] : to[-1]], to - to[0]), hash_[s : s + 100_000], c[s : s + 100_000])

    def run(batches):
        held, ends = Counts(), 0
        common = sums = None
        for b in batches:
            for texts in column_slices(b.column(0)):
                t = Tokens(texts)
                ends += len(texts)
                if common is None:
                    held.add(t.word_hash, t.chars, t.offsets)
                    found, words = [*held.sums()], []
                    for hash_, chars, offsets, c in found:
                        top = np.sort(np.argsort(-c, kind="stable")[:COMMON]) if chars is found[0][1] else np.zeros(0, np.int64)
                        rest = np.setdiff1d(np.arange(len(c)), top, assume_unique=True)
                        if len(top):
                            top = top[np.argsort(-c[top], kind="stable")]
                            words, sums = [chars[offsets[i] : offsets[i + 1]].tobytes() for i in top.tolist()], c[top]
                        held.add(hash_[rest], *gathered(chars, offsets[rest], np.diff(offsets)[rest]), c[rest])
                    if words:
                        common = Lookup(words)
                    continue
                number = common.find(t)
                sums = sums + np.bincount(number[number >= 0], minlength=len(sums))
                held.add(*t.some(t.word_at[number[t.word_at] < 0]))
                if held.size >= FLUSH:
                    yield from flushed(held)
        yield from flushed(held)
        if ends:
            yield counted(pa.array([END], pa.binary()), np.zeros(1, np.uint64), np.array([ends]))
        if common:
            yield counted(pa.array(list(common.number), pa.binary()), common.hash, sums)

    counts = texts.mapInArrow(run, "word binary, key long, c long")
    return scratch.save(counts.groupBy("word", "key").agg(F.sum("c").alias("c")))


#: Texts whose sums travel as one array.
BLOCK = 1024
#: What a row met in scoring is of.
TEXT, WORD, ARRAYS = 0, 1, 2
#: What a pair found once has a row for: a held-out text holds it, or tasks hold neither of its words.
ASKED, BOTH_RARE = 0, 1


def pair_table(texts: DataFrame, scratch: Scratch, solid: np.ndarray | None = None, n: int = 0) -> DataFrame:
    """``(b, c)``: pairs that the training texts hold twice or more; all texts are, but those marked in a column ``held_out``.

    Its attribute ``once(b, why)`` has the pairs found once of which neither word's key is in ``solid`` (sorted) or which a
    held-out text holds too; with no ``solid`` it has all, those of a text's start as well.  Tasks count a fixed number of tokens
    at a time and hand the pairs on as arrays, one for each class of pairs, those of held-out texts with the count 0; a class, of
    fixed size by the number ``n`` of tokens, is sorted and summed as an array."""
    classes, parts = class_count(scratch.spark, n), partitions(scratch.spark)
    known = scratch.spark.sparkContext.broadcast(np.zeros(0, np.uint64) if solid is None else np.append(solid, np.uint64(START)))
    if "held_out" not in texts.columns:
        texts = texts.withColumn("held_out", F.lit(False))

    def counted(held, asked):
        for part, of in ((held, 1), (asked, 0)):
            if sum(map(len, part)):
                m, n = np.unique(spread(np.concatenate(part)), return_counts=True)
                # in a byte each: larger counts are handed on in parts
                turns = (n + 254) // 255
                rest = n - 255 * (turns - 1)
                m, n = np.repeat(m, turns), np.full(turns.sum(), 255, np.uint8)
                n[np.cumsum(turns) - 1] = rest
                k, bounds = dealt(m, classes)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array((k % parts).astype(np.int32)), blobs(m, bounds), blobs(n * np.uint8(of), bounds)], names=["k", "part", "m", "n"])

    def run(batches):
        held, asked, size = [], [], 0
        for batch in batches:
            out, start = batch.column(1).to_numpy(zero_copy_only=False).astype(bool), 0
            for texts in column_slices(batch.column(0)):
                t = Tokens(texts)
                b, of_out = pairs_of(t), np.repeat(out[start : start + len(texts)], np.diff(t.starts))
                held.append(b[~of_out])
                asked.append(b[of_out])
                size, start = size + len(b), start + len(texts)
                if size >= PAIRS:
                    yield from counted(held, asked)
                    held, asked, size = [], [], 0
        yield from counted(held, asked)

    def rows(b, c, least):
        once = np.flatnonzero(c == 1)
        one, keys = b[once].view(np.uint64), known.value
        rare = np.ones(len(one), bool)
        if len(keys):
            for k in (one >> np.uint64(32), one & np.uint64(LOW)):
                rare[rare] = keys[np.minimum(np.searchsorted(keys, k[rare]), len(keys) - 1)] != k[rare]
        why = np.where(least[once] == 0, ASKED, np.where(rare, BOTH_RARE, -1))
        once, why, more = once[why >= 0], why[why >= 0], np.flatnonzero(c > 1)
        whys = pa.array(np.concatenate([np.zeros(len(more), np.int64), why]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([b[more], b[once]])), pa.array(np.concatenate([c[more], c[once]])), whys], names=["b", "c", "why"])

    def summed(batches):
        for ms, ns in in_classes(batches):
            m, n = whole(ms, np.uint64), whole(ns, np.uint8)
            order = np.argsort(m)
            m, n = m[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
            b, c, least = unspread(m[first]).view(np.int64), np.add.reduceat(n, first, dtype=np.int64), np.minimum.reduceat(n, first)
            # neighbours share their context
            order = np.argsort(b)
            yield rows(b[order], c[order], least[order])

    parts_ = texts.select("t", "held_out").mapInArrow(run, "k long, part int, m binary, n binary").repartitionById(parts, "part")
    saved = scratch.save(parts_.sortWithinPartitions("k").select("k", "m", "n").mapInArrow(summed, "b long, c long, why long"))
    pairs = saved.filter("c > 1").select("b", "c")
    pairs.once, pairs._edgeloom_path = saved.filter("c = 1").select("b", "why"), saved._edgeloom_path
    return pairs


def spark_hash(b: np.ndarray, number: int | None = None) -> np.ndarray:
    """Spark's ``xxhash64`` of longs, or of longs and an int."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))

    def mixed(h):
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))

    h = mixed(turn((np.uint64(42 + 8) + p5) ^ (turn(b * p2, 31) * p1), 27) * p1 + p4)
    if number is None:
        return h
    return mixed(turn((h + p5 + np.uint64(4)) ^ (np.array(number, np.uint64) * p1), 23) * p2 + p3)


def uniform(b: np.ndarray, sweep: int) -> np.ndarray:
    """The random numbers of some keys in a sweep: hashes of both, so a task that is run again, or cells cut otherwise, give the
    same draws."""
    return ((spark_hash(b, sweep) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


class Root:
    """The restaurant of all words, whose base gives known words ``1 - UNKNOWN`` in equal parts.  A word's customers are the
    tables of its pairs and its occurrences in pairs found once.  Words in no row of ``w`` have only the latter: those of
    one count are exchangeable and come as a histogram."""

    def __init__(self, n: int, v: int, steps: dict[int, int]):
        self.n, self.v, self.steps = n, v, steps
        self.tables, self.d, self.total = float(v), 0.0, 0.0
        self.opened = self.opens

    @property
    def opens(self) -> float:
        return (STRENGTH + self.d * self.tables) * (1 - UNKNOWN) / max(self.v, 1)

    @property
    def unknown(self) -> float:
        return (STRENGTH + self.d * self.tables) / (STRENGTH + self.total) * UNKNOWN if self.v else 1.0

    def mean_tables(self, c: np.ndarray) -> np.ndarray:
        """Mean tables of words with ``c`` customers, at the strength that the present tables were drawn with."""
        return expected(c, np.full(len(c), self.opened), self.d)

    def start(self, steps: dict[int, int], one: int, two: int) -> None:
        """Takes the words that have rows, by steps of their occurrences, out of the histogram and sets the discount; ``one`` and
        ``two`` of them have so many customers."""
        for r, count in steps.items():
            self.steps[r] = max(self.steps.get(r, 0) - count, 0)
        self.d = discount(one + self.steps.get(1, 0), two + self.steps.get(2, 0))

    def close(self, t0: float, cw: float, tw: float) -> tuple[float, float, float]:
        """Sets the restaurant's totals from the sums over its words' rows; with the figures returned ``predictive`` gives the
        probability of each."""
        c, m = np.array([_count(r) for r in self.steps], np.int64), np.array(list(self.steps.values()), float)
        self.opened = self.opens
        rest = float(self.mean_tables(c) @ m) if len(c) else 0.0
        self.total = self.n - cw + tw
        self.tables = t0 + rest
        return self.d, self.opens, STRENGTH + self.total


def predictive(c0: np.ndarray, t0: np.ndarray, closed: tuple[float, float, float]) -> np.ndarray:
    d, opens, scale = closed
    return (c0 - d * t0 + opens) / scale


def _free(spark) -> None:
    """Lets Spark delete the shuffle files of finished phases, which it does when their plans are collected."""
    gc.collect()
    spark._jvm.System.gc()


#: A row of arrays that travels in sweeps: to a chunk of cells or a class of keys ``at``, from or for the other one ``by``.
ROW = "at long, kind int, by long, p binary, q binary, r binary, s binary"
#: To chunks: their cells, tables and the values they asked for.  To classes: occurrences of words, their keys, what is known of
#: these in a sweep, which keys a chunk has, what its cells add to them.
CELLS, TABLES, ANSWERS, NAMES, KEPT, SEATED, ASKS, SUMS = range(8)
_FIELDS = [x.split()[0] for x in ROW.split(", ")]


def _rows(at, kind: int, by, *arrays) -> pa.RecordBatch:
    """Rows of ``ROW``; ``arrays`` are columns of bytes."""
    n = len(arrays[0])
    whole_ = lambda x: pa.array(np.broadcast_to(np.asarray(x, np.int64), n))
    none = [pa.nulls(n, pa.binary())] * (4 - len(arrays))
    return pa.RecordBatch.from_arrays([whole_(at), pa.array(np.full(n, kind, np.int32)), whole_(by), *arrays, *none], names=_FIELDS)


def _one(values: np.ndarray) -> pa.Array:
    values = np.ascontiguousarray(values).reshape(-1)
    return blobs(values, np.array([0, len(values)]))


def _array(x: pa.Scalar, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), kind)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[tuple]]]]:
    """The rows of each ``at`` by their kind, as ``(by, p, q, r, s)``; rows come ordered."""
    for at, kinds, by, *arrays in in_classes(b.select([0, *range(len(_FIELDS))]) for b in batches):
        out = defaultdict(list)
        for kind, *row in zip(kinds, by, *arrays):
            out[kind.as_py()].append((row[0].as_py(), *row[1:]))
        yield at[0].as_py(), out


#: Rows of words' seats with sums over them.
SUMMED = f"{ROW}, t0 double, cw double, tw double"


def _summed(row: pa.RecordBatch, *sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*row.columns, *(pa.array([float(x.sum())]) for x in sums)], names=[*_FIELDS, "t0", "cw", "tw"])


class Restaurants:
    """Pairs found twice or more with their customers and tables.  A pair found once is a customer at a table of
    its own in its context and, like every table, a customer in the root: its seat is never drawn, so ``su`` counts both the
    customers and the tables of a context's pairs found once, ``sw`` a word's occurrences in such pairs.  A sweep reseats the
    customers of every cell given the other cells' tables of the sweep before, as distributed Gibbs samplers do.

    Cells lie in chunks, arrays of a fixed size; contexts and words in classes of their keys.  In a sweep each chunk sends a class
    the sums over its cells of the keys it has there, and is sent values of these keys; cells stay in their chunks, and a
    frequent word is one number for each chunk.  What chunks have of which class does not change.

    ``cells(b, c, su, t, ts)`` has the tables now and summed over the kept sweeps, of the pairs found once as well, those that
    ``pairs.once`` has; no customers are without a cell then, ``su`` is 0."""

    def __init__(self, pairs: DataFrame, table: DataFrame, scratch: Scratch, n: int, v: int, n_texts: int, steps: dict[int, int]):
        self.scratch, self.n, self.n_texts = scratch, n, n_texts
        self.parts = partitions(scratch.spark)
        self.edges = class_edges(max(min(self.parts, 64), -(-v // KEYS)))
        f = pairs.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.count(F.when(F.col("c") == 2, 1)).alias("two")).first()
        self.d = discount(n - f["c"], f["two"])
        self.root = Root(n, v, dict(steps))
        self.chunks = self._chunks(pairs)
        self.keys = self._keys(table)
        self._start()
        tables = None
        for sweep in range(SWEEPS):
            seated = self._seated(tables, sweep)
            tables, old = self._reseated(seated, tables, sweep), tables
            scratch.drop(seated, old)
            _free(scratch.spark)
        self.tables = tables
        self.u, self.w, self.averaged, self.closed = self._average()
        none = F.lit(0).cast("long").alias("su")
        self.cells = self._unpacked().select("b", "c", none, "t", "ts").unionByName(
            pairs.once.select("b", F.lit(1).cast("long").alias("c"), none, F.lit(1).cast("long").alias("t"), F.lit(SWEEPS - BURN_IN).cast("long").alias("ts"))
        )

    def drop_seats(self) -> None:
        self.scratch.drop(self.chunks, self.keys, self.tables, self.averaged)

    def _sent(self, *rows: DataFrame) -> DataFrame:
        """Rows at the task of their chunk or class, ordered."""
        all_ = rows[0]
        for r in rows[1:]:
            all_ = all_.unionByName(r)
        part = F.pmod("at", F.lit(self.parts)).cast("int")
        return all_.withColumn("part", part).repartitionById(self.parts, "part").drop("part").sortWithinPartitions("at", "kind", "by")

    def _of(self, table: DataFrame, *kinds: int) -> DataFrame:
        return table.filter(F.col("kind").isin(*kinds)).select(*_FIELDS)

    def _chunks(self, pairs: DataFrame) -> DataFrame:
        """Cells in chunks, ordered by context; and which keys each has of which class, in the order of classes, with the
        customers and the number of its cells there."""
        most, edges = CHUNK, self.edges

        def keys_of_chunk(m, c):
            """``m`` ordered: bounds of the classes, different keys and their sums; and each cell's place among them."""
            is_first = np.concatenate([[True], m[1:] != m[:-1]])
            first = np.flatnonzero(is_first)
            sums = np.column_stack([np.add.reduceat(c, first), np.diff(np.append(first, len(m)))])
            return np.searchsorted(m[first], edges), m[first], sums, (np.cumsum(is_first) - 1).astype(np.int32)

        def chunk(at, held):
            b, c = map(np.concatenate, zip(*held))
            b = b.view(np.uint64)
            u = spread_key(b >> np.uint64(32))
            order = np.argsort((u << np.uint64(32)) | (b & np.uint64(LOW)))
            b, c = b[order], c[order]
            u_bounds, u, u_sums, of_u = keys_of_chunk(u[order], c)
            w = spread_key(b & np.uint64(LOW))
            order, of_w = np.argsort(w), np.empty(len(w), np.int32)
            w_bounds, w, w_sums, of_w[order] = keys_of_chunk(w[order], c[order])
            yield _rows(at, CELLS, 0, *map(_one, (b, c, of_u, of_w)))
            small = [blobs(x.astype(np.uint32), bounds) for x, bounds in ((u, u_bounds), (w, w_bounds))]
            sums = [blobs(x.reshape(-1), 2 * bounds) for x, bounds in ((u_sums, u_bounds), (w_sums, w_bounds))]
            yield _rows(np.arange(len(edges) - 1), ASKS, at, *small, *sums)

        def run(batches):
            held, size, at = [], 0, TaskContext.get().partitionId()
            for batch in batches:
                held.append([x.to_numpy() for x in batch.columns])
                size += len(batch)
                if size >= most:
                    yield from chunk(at, held)
                    held, size, at = [], 0, at + (1 << 32)
            if size:
                yield from chunk(at, held)

        return self.scratch.save(pairs.select("b", "c").mapInArrow(run, ROW))

    def _keys(self, table: DataFrame) -> DataFrame:
        """For each class its contexts ``(su, cu, tu)`` and words ``(sw, cw, tw)`` with a table for each cell, and where in these
        the keys of each chunk are."""
        edges, n_texts = self.edges, self.n_texts

        def names(batches):
            held, size = [], 0

            def packed():
                m, n = map(np.concatenate, zip(*held))
                order = np.argsort(m)
                m, bounds = m[order], np.searchsorted(m[order], edges)
                return _rows(np.arange(len(edges) - 1), NAMES, 0, blobs(m.astype(np.uint32), bounds), blobs(n[order], bounds))

            for batch in batches:
                held.append((spread_key(batch.column(0).to_numpy().view(np.uint64)), batch.column(1).to_numpy()))
                size += len(batch)
                if size >= PAIRS:
                    yield packed()
                    held, size = [], 0
            if size:
                yield packed()

        def joined(batches):
            for at, rows in _met(batches):
                if not rows[ASKS]:
                    continue
                name = np.concatenate([_array(r[1], np.uint32) for r in rows[NAMES]] or [np.zeros(0, np.uint32)])
                n = np.concatenate([_array(r[2]) for r in rows[NAMES]] or [np.zeros(0, np.int64)])
                name, where = np.unique(name, return_inverse=True)
                n = np.append(np.bincount(where, n, len(name)).astype(np.int64), n_texts)
                keys, facts, places = [], [], []
                for i in (1, 2):
                    parts = [_array(r[i], np.uint32) for r in rows[ASKS]]
                    key, place = np.unique(np.concatenate(parts), return_inverse=True)
                    sums = np.concatenate([_array(r[i + 2]).reshape(-1, 2) for r in rows[ASKS]])
                    c, t = (np.bincount(place, sums[:, k], len(key)).astype(np.int64) for k in (0, 1))
                    found = np.searchsorted(name, key)
                    # the start of a text is no word: it occurs once in each
                    found[np.append(name, 0)[found] != key] = len(name)
                    keys.append(_one(key))
                    facts.append(_one(np.stack([n[found] - c, c, t])))
                    places.append(blobs(place.astype(np.int32), np.cumsum([0, *map(len, parts)])))
                yield _rows(at, KEPT, 0, *keys, *facts)
                yield _rows(at, ASKS, [r[0] for r in rows[ASKS]], *places)

        words = table.select("key", "c").mapInArrow(names, ROW)
        return self.scratch.save(self._sent(words, self._of(self.chunks, ASKS)).mapInArrow(joined, ROW))

    def _start(self) -> None:
        def steps(batches):
            for batch in batches:
                for facts in batch.column(0):
                    sw, cw, tw = _array(facts).reshape(3, -1)
                    n, count = np.unique(sw + cw, return_counts=True)
                    few = [int((sw + tw == k).sum()) for k in (1, 2)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.append(n, [-1, -2])), pa.array(np.append(count, few))], names=["n", "count"])

        got = self._of(self.keys, KEPT).select("s").mapInArrow(steps, "n long, count long")
        got = got.groupBy(F.when(F.col("n") < 0, F.col("n")).otherwise(rung(F.col("n"))).alias("r")).agg(F.sum("count").alias("count"))
        found = {r["r"]: r["count"] for r in got.collect()}
        one, two = found.pop(-1, 0), found.pop(-2, 0)
        self.root.start(found, one, two)

    @staticmethod
    def _now(rows: dict[int, list[tuple]]) -> Iterator[np.ndarray]:
        """Of a class the facts of contexts and words, with the tables that chunks have now."""
        ((_, *_, u, w),) = rows[KEPT]
        new = {r[0]: r for r in rows[SUMS]}
        for i, facts in ((1, u), (2, w)):
            facts = _array(facts).reshape(3, -1).copy()
            if new:
                facts[2] = 0
                for r in rows[ASKS]:
                    # a key is there once in a chunk
                    facts[2, _array(r[i], np.int32)] += _array(new[r[0]][i])
            yield facts

    def _seated(self, tables: DataFrame | None, sweep: int) -> DataFrame:
        """For each class the strength of each context and the customers and drawn tables of each word in the root."""
        d, (opens, root_d) = self.d, (self.root.opens, self.root.d)

        def seat(batches):
            for at, rows in _met(batches):
                (su, _, tu), (sw, cw, tw) = Restaurants._now(rows)
                c0 = sw + tw
                w = unspread_key(_array(rows[KEPT][0][2], np.uint32).astype(np.uint64))
                t0 = draw(c0, np.full(len(c0), opens), uniform(w, sweep), root_d)
                yield _summed(_rows(at, SEATED, 0, _one(STRENGTH + d * (su + tu)), _one(np.stack([c0, t0]).astype(float))), t0, cw, tw)

        rows = self._of(self.keys, KEPT) if tables is None else self._sent(self._of(self.keys, KEPT, ASKS), self._of(tables, SUMS))
        return self.scratch.save(rows.mapInArrow(seat, SUMMED))

    def _answers(self, seated: DataFrame, width: int, closed: tuple[float, float, float]) -> DataFrame:
        """For each chunk the ``width`` values of its contexts and the probability in the root of its words."""

        def answer(batches):
            for at, rows in _met(batches):
                u, w = _array(rows[SEATED][0][1], float).reshape(width, -1).T, predictive(*_array(rows[SEATED][0][2], float).reshape(2, -1), closed)
                out = []
                for i, values in ((1, u), (2, w[:, None])):
                    places = [_array(r[i], np.int32) for r in rows[ASKS]]
                    out.append(blobs(values[np.concatenate(places)].reshape(-1), np.cumsum([0, *map(len, places)]) * values.shape[1]))
                yield _rows([r[0] for r in rows[ASKS]], ANSWERS, at, *out)

        return self._sent(self._of(self.keys, ASKS), self._of(seated, SEATED)).mapInArrow(answer, ROW)

    def _reseated(self, seated: DataFrame, tables: DataFrame | None, sweep: int) -> DataFrame:
        """The tables of the cells of each chunk, now and summed over the kept sweeps, and what they add to the keys of each class."""
        closed, d, last = self._closed(seated), self.d, sweep == SWEEPS - 1

        def reseat(batches):
            for at, rows in _met(batches):
                ((_, b, c, of_u, of_w),) = rows[CELLS]
                b, c, of_u, of_w = _array(b, np.uint64), _array(c), _array(of_u, np.int32), _array(of_w, np.int32)
                u, w = ([_array(r[i], float) for r in rows[ANSWERS]] for i in (1, 2))
                t = draw(c, np.concatenate(u)[of_u] * np.concatenate(w)[of_w], uniform(b, sweep), d)
                ts = _array(rows[TABLES][0][2]) if rows[TABLES] else np.zeros(len(t), np.int64)
                ts = ts + t if sweep >= BURN_IN else ts
                yield _rows(at, TABLES, 0, _one(t), _one(ts))
                sums = []
                for of, parts in ((of_u, u), (of_w, w)):
                    bounds = np.cumsum([0, *map(len, parts)])
                    sums.append(blobs(np.bincount(of, ts if last else t, bounds[-1]).astype(np.int64), bounds))
                yield _rows([r[0] for r in rows[ANSWERS]], SUMS, at, *sums)

        rows = [self._answers(seated, 1, closed), self._of(self.chunks, CELLS), *([] if tables is None else [self._of(tables, TABLES)])]
        return self.scratch.save(self._sent(*rows).mapInArrow(reseat, ROW))

    def _closed(self, seated: DataFrame) -> tuple[float, float, float]:
        f = seated.agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("t0", "cw", "tw"))).first()
        return self.root.close(f["t0"], f["cw"], f["tw"])

    def _average(self) -> tuple[DataFrame, DataFrame, DataFrame, tuple[float, float, float]]:
        """Contexts ``(u, all, back)`` with their share of the root and words ``(w, p)``, from the tables averaged over the kept
        sweeps; both as arrays too, and the root's figures."""
        kept, d, (opens, root_d) = float(SWEEPS - BURN_IN), self.d, (self.root.opens, self.root.d)

        def average(batches):
            for at, rows in _met(batches):
                (su, cu, tu), (sw, cw, tw) = Restaurants._now(rows)
                all_, tw = STRENGTH + su + cu, tw / kept
                back, c0 = (STRENGTH + d * (su + tu / kept)) / all_, sw + tw
                t0 = expected(np.maximum(np.rint(c0), 1), np.full(len(c0), opens), root_d)
                keys = [_one(_array(x, np.uint32)) for x in rows[KEPT][0][1:3]]
                yield _summed(_rows(at, SEATED, 0, _one(np.stack([all_, back])), _one(np.stack([c0, t0])), *keys), t0, cw, tw)

        averaged = self.scratch.save(self._sent(self._of(self.keys, KEPT, ASKS), self._of(self.tables, SUMS)).mapInArrow(average, SUMMED))
        closed = self._closed(averaged)

        def keys(x):
            return pa.array(unspread_key(_array(x, np.uint32).astype(np.uint64)).view(np.int64))

        def contexts(batches):
            for batch in batches:
                for x, key in zip(*batch.columns):
                    all_, back = _array(x, float).reshape(2, -1)
                    yield pa.RecordBatch.from_arrays([keys(key), pa.array(all_), pa.array(back)], names=["u", "all", "back"])

        def words(batches):
            for batch in batches:
                for x, key in zip(*batch.columns):
                    yield pa.RecordBatch.from_arrays([keys(key), pa.array(predictive(*_array(x, float).reshape(2, -1), closed))], names=["w", "p"])

        u = self.scratch.save(averaged.select("p", "r").mapInArrow(contexts, "u long, all double, back double"))
        w = self.scratch.save(averaged.select("q", "s").mapInArrow(words, "w long, p double"))
        return u, w, averaged, closed

    def _unpacked(self) -> DataFrame:
        """``(b, c, t, ts)``."""

        def run(batches):
            for _, rows in _met(batches):
                (_, b, c, *_), (_, t, ts, *_) = rows[CELLS][0], rows[TABLES][0]
                yield pa.RecordBatch.from_arrays([pa.array(_array(x)) for x in (b, c, t, ts)], names=["b", "c", "t", "ts"])

        return self._sent(self._of(self.chunks, CELLS), self._of(self.tables, TABLES)).mapInArrow(run, "b long, c long, t long, ts long")

    def priced_pairs(self) -> DataFrame:
        """``(b, c, x, once)`` of pairs found twice or more: what a pair adds to the log10 probability that its context and word
        have apart, and what it would add if it were found once."""
        d, kept = self.d, float(SWEEPS - BURN_IN)

        def price(batches):
            for _, rows in _met(batches):
                ((_, b, c, of_u, of_w),), ((_, _, ts, *_),) = rows[CELLS], rows[TABLES]
                u, w = (np.concatenate([_array(r[i], float) for r in rows[ANSWERS]]) for i in (1, 2))
                b, c, ts, of_u = _array(b), _array(c), _array(ts), _array(of_u, np.int32)
                (all_, back), p = u.reshape(-1, 2).T, w[_array(of_w, np.int32)]
                all_, lower = all_[of_u], back[of_u] * p
                x = np.log10((c - d * (ts / kept)) / all_ + lower) - np.log10(lower)
                once = np.log10(1 + (1 - d) / (all_ * lower))
                for a in range(0, len(b), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(y[a : a + 100_000]) for y in (b, c, x, once)], names=["b", "c", "x", "once"])

        rows = self._answers(self.averaged, 2, self.closed), self._of(self.chunks, CELLS), self._of(self.tables, TABLES)
        return self.scratch.save(self._sent(*rows).mapInArrow(price, "b long, c long, x double, once double"))

    def priced_words(self, table: DataFrame) -> DataFrame:
        """``(word, key, c, p, y, v, hash)``: probability in the root, log10 share of the root in the word's own restaurant, and what a
        pair found once has there over that share: with it, it adds ``log10(1 + v / p)`` by its context's ``v`` and word's ``p``."""
        root, scale = self.root, STRENGTH + self.root.total

        def alone(batches):
            for b in batches:
                c = b.column("c").to_numpy()
                p = (c - root.d * root.mean_tables(c) + root.opens) / scale
                p = np.where(b.column("p").is_null().to_numpy(zero_copy_only=False), p, b.column("p").fill_null(1.0).to_numpy())
                whole_hash = pa.array(column_hashes(b.column("word")).view(np.int64))
                yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("word", "key", "c")), pa.array(p), b.column("y"), b.column("v"), whole_hash], names=["word", "key", "c", "p", "y", "v", "hash"])

        n = F.sum("c").over(Window.partitionBy("key")).alias("n")
        m = table.select("word", "key", "c", n).join(self.w, F.col("key") == F.col("w"), "left").join(self.u, F.col("key") == F.col("u"), "left")
        all_ = F.coalesce("all", F.lit(STRENGTH) + F.col("n"))
        back = F.coalesce("back", (F.lit(STRENGTH) + F.lit(self.d) * F.col("n")) / (F.lit(STRENGTH) + F.col("n")))
        is_end = F.length("word") == 0
        y, v = F.when(is_end, 0.0).otherwise(F.log10(back)), F.when(is_end, 0.0).otherwise(F.lit(1 - self.d) / (all_ * back))
        m = m.select("word", "key", "c", "p", y.alias("y"), v.alias("v"))
        return self.scratch.save(m.mapInArrow(alone, "word binary, key long, c long, p double, y double, v double, hash long"))

    def start(self) -> tuple[float, float]:
        """The ``y`` and ``v`` of the start of a text."""
        r = self.u.filter(F.col("u") == START).first()
        all_ = r["all"] if r else STRENGTH + self.n_texts
        back = r["back"] if r else (STRENGTH + self.d * self.n_texts) / all_
        return float(np.log10(back)), (1 - self.d) / (all_ * back)

    def priced_once(self, once: DataFrame, words: DataFrame) -> DataFrame:
        """``(b, x)`` of pairs found once; not saved, since it is read once."""
        at = words.groupBy("key").agg(F.max("p").alias("p"), F.max("v").alias("v"))
        u = at.select(F.col("key").alias("u"), "v").unionByName(self.scratch.spark.range(1).select(F.lit(START).alias("u"), F.lit(self.start()[1]).alias("v")))
        x = once.select("b", F.shiftrightunsigned("b", 32).alias("u"), F.col("b").bitwiseAND(F.lit(LOW)).alias("w"))
        x = x.join(u, "u").join(at.select(F.col("key").alias("w"), "p"), "w")
        return x.select("b", F.log10(F.lit(1.0) + F.col("v") / F.col("p")).alias("x"))


def pair_map(pairs: DataFrame) -> np.ndarray:
    """One bit for each of ``MAP_BITS`` classes of pairs, set where the table has one.  Of a fixed size; when it fills up more
    rows are joined and the results stay the same."""
    at = F.pmod(F.xxhash64("b"), F.lit(MAP_BITS)) + 1
    got = pairs.select(at.alias("k")).groupBy(F.bitmap_bucket_number("k").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("k")).alias("map")).toArrow()
    bits = np.zeros((MAP_BITS // 32768, 4096), np.uint8)
    for piece, m in zip(got["piece"].to_pylist(), got["map"].to_pylist()):
        bits[piece - 1] = np.frombuffer(m, np.uint8)
    return bits.reshape(-1)


def map_place(b: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of a long, modulo the map."""
    return spark_hash(b) & np.uint64(MAP_BITS - 1)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, held: int = HELD, held_pairs: int = HELD_PAIRS) -> DataFrame:
    """``(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for each row.

    Words are lower-cased (A-Z) and each text ends with one end token.  Counts cover all training rows and are tables in Spark;
    a fixed number of the most frequent words and pairs is also held in every task, those of all others are joined.
    ``base_score`` is the add-one unigram, ``score`` the log10 probability by the predictive probabilities averaged over Gibbs
    sweeps; perplexity is ``10 ** (-score / n_tokens)``.  Restaurants know words by 32 bits of their hash, ``base_score`` and
    ``n_known`` by the words themselves.

    Null text is empty (one end token); null ids count as the empty text in folds; repeated rows are learned from and scored
    each; with no training row every score is that of the uniform base; an empty table gives no rows; extra columns are not read.

    The call does all the work; the frame it returns reads the scores from the shared folder, where nothing else is left.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    d = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("t"), (fold(F.col(id_col), folds) == held_fold).alias("held_out"))
    training = d.filter(~F.col("held_out")).select("t")
    table = word_table(training, scratch)
    facts = table.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.max(F.when(F.length("word") == 0, F.col("c"))), F.lit(0)).alias("texts")).first()
    n, v = facts["n"], facts["v"]
    steps = {r["r"]: r["count"] for r in table.groupBy(rung(F.col("c")).alias("r")).count().collect()}
    frequent = rung(F.col("c")) >= least_rung(steps, held)
    # keys that only a held word has: of a fixed number
    solid = table.join(F.broadcast(table.filter(frequent).select("key").distinct()), "key", "left_semi").groupBy("key").count().filter("count = 1").select("key").toArrow()
    pairs = pair_table(d.select("t", "held_out"), scratch, np.sort(solid["key"].to_numpy().view(np.uint64)), n)
    _free(spark)
    pair_steps = {r["r"]: r["count"] for r in pairs.groupBy(rung(F.col("c")).alias("r")).count().collect()}
    model = Restaurants(pairs, table, scratch, n, v, facts["texts"], steps)
    cells, words = model.priced_pairs(), model.priced_words(table)
    model.drop_seats()
    scratch.drop(table)
    _free(spark)
    unknown, (share, start_v) = float(np.log10(model.root.unknown)), model.start()
    base_log = float(np.log10(n + v + 1)) if n + v else 0.0

    got = words.filter(frequent).toArrow().sort_by([("c", "descending")])
    plus_one, p, y, v_ = np.log10(got["c"].to_numpy() + 1.0), got["p"].to_numpy(), got["y"].to_numpy(), got["v"].to_numpy()
    top = rung(F.col("c")) >= least_rung(pair_steps, held_pairs)
    best = cells.filter(top).select("b", "x").toArrow()
    best_b, best_x = best["b"].to_numpy().view(np.uint64), best["x"].to_numpy()
    order = np.argsort(best_b)
    bitmap = spark.sparkContext.broadcast(pair_map(cells.filter(~top).select("b").unionByName(pairs.once.filter(F.col("why") == ASKED).select("b"))))
    shared = spark.sparkContext.broadcast((got["word"].to_pylist(), plus_one, np.log10(p) + y, 1 / p, v_, best_b[order], best_x[order]))

    def may_have(b):
        place = map_place(b) & np.uint64(8 * len(bitmap.value) - 1)
        return (bitmap.value[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0

    once = model.priced_once(pairs.once, words)
    # Laid out by key, so the join below reads them where they lie: shuffled, they would take their disk twice while its
    # other side, the largest of all, is there too.  Priced pairs go to that other side as arrays: they need no rows.
    priced = words.select(F.col("hash").alias("key_"), F.col("word").alias("word_"), "c", "p", "y", "v")
    classes = class_count(spark, n)
    keys = class_keys(spark, classes)
    priced = scratch.bucketed(priced, "key_")

    def in_arrays(row, b, *columns):
        """Rows of the classes of some pairs: a number below 0 is that of prices, else that of the text that texts are counted from."""
        m = spread(b)
        order = np.argsort(m)
        m = m[order]
        k, bounds = dealt(m, classes)
        return [pa.array(np.full(len(k), row)), pa.array(keys[k]), blobs(m, bounds), *(blobs(c[order], bounds) for c in columns)]

    def pack(batches):
        held, size = [], 0

        def packed():
            b, x, y = map(np.concatenate, zip(*held))
            return pa.RecordBatch.from_arrays(in_arrays(-1, b.view(np.uint64), x, y), names=["row", "key", "m", "x", "once"])

        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            size += len(batch)
            if size >= PAIRS:
                yield packed()
                held, size = [], 0
        if size:
            yield packed()

    prices = cells.filter(~top).select("b", "x", "once").unionByName(once.select("b", "x", F.col("x").alias("once")))
    prices = scratch.save(prices.mapInArrow(pack, "row long, key long, m binary, x binary, once binary"))
    scratch.drop(pairs, cells, words, model.u, model.w)
    _free(spark)

    summed = ["block", "at", "id", "m", "known", "base", "s"]
    fields, id_kind = ["row", "key", "word", "beside", "id", "m", "x"], field_type(docs, id_col)

    def rows_of(texts, out, first, lookup):
        """The rows of some texts: one for each text and each of its words that tasks do not hold; and the pairs not held.

        Pairs of training texts that tasks do not hold are priced as found once; what a row of a pair found more often adds is
        beyond that.  With held words the price is known here; with one word that is not held, the numbers of those beside it
        go with that word's row (high half: the context, low half: the next word); with none, the pair goes to the join."""
        _, plus_one, xy, over_p, v_, best_b, best_x = shared.value
        t = Tokens(texts)
        at, size = t.starts[:-1], np.diff(t.starts)
        text = np.repeat(np.arange(len(size)), size)
        rank = lookup.find(t)
        here = rank >= 0
        known = np.add.reduceat(here.astype(np.int64), at)
        base, s = np.zeros(len(rank)), np.zeros(len(rank))
        base[here], s[here] = plus_one[rank[here]], xy[rank[here]]
        b = pairs_of(t)
        # sorted first: neighbouring searches then touch the same memory
        order, spot = np.argsort(b), np.empty(len(b), np.int64)
        spot[order] = np.minimum(np.searchsorted(best_b, b[order]), max(len(best_b) - 1, 0))
        hit = best_b[spot] == b if len(best_b) else np.zeros(len(b), bool)
        s[hit] += best_x[spot[hit]]
        # numbers from 1, 0: not held
        number = rank + 1
        before = np.concatenate([[0], number[:-1]])
        before[at] = len(v_) + 1
        sent, once = ~hit, ~out[text] & ~hit
        sent[sent] = may_have(b[sent])
        both = once & (before > 0) & here
        none = once & (before == 0) & ~here
        local = np.flatnonzero(both)
        s[local] += np.log10(1 + np.append(v_, start_v)[before[local] - 1] * over_p[rank[local]])
        facts = (size, known, np.add.reduceat(base, at) - base_log * size, np.add.reduceat(s, at) + share)
        rare = np.flatnonzero(~here)
        # an end is no context: what follows it is another text's
        after = np.where(once, number, 0)
        after[at] = 0
        beside = (np.where(once[rare], before[rare], 0) << 32) | np.append(after, 0)[rare + 1]
        sent = np.flatnonzero(sent | none)
        return facts, (first + text[rare], t.some(rare), beside), (text[sent], b[sent], once[sent] & ~none[sent])

    def score(batches):
        base_row, lookup = TaskContext.get().partitionId() << 36, Lookup(shared.value[0])
        row, asked, size = base_row, [], 0

        def questions(id_type):
            at, key, m, texts = in_arrays(base_row, *map(np.concatenate, zip(*asked)))
            return pa.RecordBatch.from_arrays([at, key, *(pa.nulls(len(at), x) for x in (pa.binary(), pa.int64(), id_type)), m, texts], names=fields)

        for batch in batches:
            ids, start = batch.column(0), 0
            flags = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for texts in column_slices(batch.column(1)):
                m = len(texts)
                (tokens, known, base, s), (word_at, words, beside), (pair_at, b, priced) = rows_of(texts, flags[start : start + m], row, lookup)
                facts = np.column_stack([flags[start : start + m], tokens, known, base, s]).astype(float)
                at, facts = np.arange(row, row + m), blobs(facts.reshape(-1), np.arange(m + 1) * facts.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(at), pa.array([NO_WORD] * m, pa.binary()), pa.array(np.full(m, -1)), ids.slice(start, m), facts, pa.nulls(m, pa.binary())], names=fields)
                hash_, chars, offsets = words
                for a in range(0, len(hash_), 100_000):
                    to, ends = slice(a, a + 100_000), offsets[a : a + 100_001]
                    part, none = binary_column(chars[ends[0] : ends[-1]], ends - ends[0]), pa.nulls(len(ends) - 1, pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(word_at[to]), pa.array(hash_[to].view(np.int64)), part, pa.array(beside[to]), pa.nulls(len(part), ids.type), none, none], names=fields)
                # the text's number and, in the last bit, whether the pair is priced as found once
                asked.append((b, ((row - base_row + pair_at) << 1 | priced).astype(np.uint32)))
                size += len(b)
                if size >= PAIRS:
                    yield questions(ids.type)
                    asked, size = [], 0
                row, start = row + m, start + m
        if size:
            yield questions(ids.type)

    def answered(rows):
        """Texts and what the pairs of one class add to them."""
        prices, asked = ([r for r in rows if (r[0] < 0) == of] for of in (True, False))
        if not prices or not asked:
            return
        m, x, y = (whole([r[i] for r in prices], kind) for i, kind in ((1, np.uint64), (2, np.float64), (3, np.float64)))
        order = np.argsort(m)
        m, x, y = m[order], x[order], y[order]
        for base_row, pairs, texts, _ in asked:
            pairs, texts = np.frombuffer(pairs.as_buffer(), np.uint64), np.frombuffer(texts.as_buffer(), np.uint32)
            at = np.minimum(np.searchsorted(m, pairs), len(m) - 1)
            hit = np.flatnonzero(m[at] == pairs)
            at, texts = at[hit], texts[hit]
            yield base_row + (texts >> np.uint32(1)).astype(np.int64), x[at] - (texts & np.uint32(1)) * y[at]

    def meet(batches):
        """Priced texts, words and pairs, summed by text as far as a fixed number of them are held."""
        over_p, v_ = (np.concatenate([[0.0], x, [y]]) for x, y in ((shared.value[3], 0.0), (shared.value[4], start_v)))
        held, size, class_, key = [], 0, [], None

        def flushed(id_type):
            row, known, base, s = map(np.concatenate, zip(*held))
            at, where = np.unique(row, return_inverse=True)
            known, base, s = (np.bincount(where, x, len(at)) for x in (known, base, s))
            block = at // BLOCK
            bounds = np.append(np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])), len(at))
            sums = [blobs(x, bounds) for x in ((at % BLOCK).astype(np.uint16), known, base, s)]
            block = block[bounds[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(np.full(len(block), -1)), pa.nulls(len(block), id_type), *sums], names=summed)

        def of_class():
            for row, s in answered(class_):
                held.append((row, np.zeros(len(row), np.int64), np.zeros(len(row)), s))
                yield len(row)

        for batch in batches:
            row, kind = batch.column("row"), batch.column("kind").to_numpy()
            of_text, of_word = (pa.array(kind == k) for k in (TEXT, WORD))
            if of_text.true_count:
                some = batch.filter(of_text)
                at, none = some.column("row").to_numpy(), pa.nulls(len(some), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(at // BLOCK), pa.array(at % BLOCK), some.column("id"), some.column("m"), none, none, none], names=summed)
            if of_word.true_count:
                some = batch.filter(of_word)
                seen = some.column("c").is_valid().to_numpy(zero_copy_only=False)
                c, p, y, v = (some.column(x).fill_null(1).to_numpy() for x in ("c", "p", "y", "v"))
                beside = some.column("beside").to_numpy()
                s = np.where(seen, np.log10(p + v_[beside >> 32]) + y + np.log10(1 + v * over_p[beside & LOW]), unknown)
                held.append((some.column("row").to_numpy(), seen.astype(np.int64), np.where(seen, np.log10(c + 1.0), 0.0), s))
                size += len(some)
            for i in np.flatnonzero(kind == ARRAYS).tolist():
                k = batch.column("key")[i].as_py()
                if k != key:
                    size += sum(of_class())
                    class_, key = [], k
                class_.append((row[i].as_py(), *(batch.column(x)[i] for x in ("m", "x", "once"))))
            if size >= PAIRS:
                yield from flushed(batch.column("id").type)
                held, size = [], 0
        size += sum(of_class())
        if size:
            yield from flushed(batch.column("id").type)

    def total(batches):
        """A row for each text, from the rows of its block of texts."""
        names, texts, sums, last = ["id", "held_out", "n_tokens", "n_known", "base_score", "score"], [], np.zeros((3, BLOCK)), None

        def closed():
            t = pa.Table.from_batches(texts).combine_chunks()
            at, facts = t.column("at").to_numpy(), np.frombuffer(b"".join(t.column("m").to_pylist())).reshape(len(t), 5)
            known, base, s = facts[:, 2:].T + sums[:, at]
            columns = [facts[:, 0] > 0, facts[:, 1].astype(np.int64), np.rint(known).astype(np.int64), base, s]
            return pa.RecordBatch.from_arrays([t.column("id").combine_chunks(), *map(pa.array, columns)], names=names)

        for batch in batches:
            block = batch.column("block").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else []
            for a, z in zip(starts, [*starts[1:], len(block)]):
                if block[a] != last:
                    if texts:
                        yield closed()
                    texts, last = [], block[a]
                    sums[:] = 0.0
                part = batch.slice(a, z - a)
                of_text = part.column("at").to_numpy() >= 0
                if of_text.any():
                    texts.append(part.filter(pa.array(of_text)))
                for i in np.flatnonzero(~of_text).tolist():
                    at = np.frombuffer(part.column("m")[i].as_buffer(), np.uint16)
                    for k, name in enumerate(("known", "base", "s")):
                        sums[k, at] += np.frombuffer(part.column(name)[i].as_buffer())
        if texts:
            yield closed()

    # one sort by a long for words and classes of pairs: words are told apart by themselves, the other rows meet nothing
    rows = d.mapInArrow(score, f"row long, key long, word binary, beside long, id {id_kind}, m binary, x binary").unionByName(prices, allowMissingColumns=True)
    rows = rows.repartition(partitions(spark), "key").sortWithinPartitions("key")
    # as a case: Spark would take a plain equality as a further key to shuffle and sort by
    same = F.when(F.col("word").isNotNull(), F.col("word") == F.col("word_"))
    met = rows.join(priced, (F.col("key") == F.col("key_")) & same, "left")
    kind = F.when(F.col("beside").isNull(), ARRAYS).when(F.col("beside") < 0, TEXT).otherwise(WORD)
    met = met.select("row", "key", kind.alias("kind"), "beside", "id", "m", "x", "once", "c", "p", "y", "v")
    one = met.mapInArrow(meet, f"block long, at long, id {id_kind}, m binary, known binary, base binary, s binary")
    one = one.repartition("block").sortWithinPartitions("block")
    scores = scratch.save(one.mapInArrow(total, f"id {id_kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"))
    scratch.drop(priced, prices)
    return scores.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
