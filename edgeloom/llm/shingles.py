"""Near copies: SimHash with pigeonring filtering, and exact Jaccard similarity of word shingles.

Fingerprints of few differing bits give the first pairs, which are checked by their shingles.  Many similar texts differ in more
bits than any ring of boxes can select by, so a search by shared shingles adds the pairs between the classes found so far."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.simhash import fingerprint_links, fingerprint_of, shingle_hashes
from edgeloom.llm.text import field_type, text_bytes
from edgeloom.operators.components import component_labels
from edgeloom.storage import Scratch

#: Bits of a set's parity sketch; members of a key compared in one block.
BITS, BLOCK = 1024, 1024
#: Bytes of the wide sketches that are moved with a key's members; longer ones are folded.
NARROW = 4096
#: 64-bit words of the map that picks the texts whose sets are needed; any size of it is right, a larger one picks fewer others.
WORDS = 1 << 17


def shingle_set(text: bytes, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct shingle hashes in order; a text without words has the set of one zero."""
    h = np.unique(shingle_hashes(text, shingle, seed).view(np.int64))
    return h if len(h) else np.zeros(1, np.int64)


def prefix_size(n: int, similarity: float) -> int:
    """Two sets that are similar share one of so many first elements, whatever the common order."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1


def sketch(s: np.ndarray, bits: int = BITS) -> bytes:
    """Each element flips one bit, so two sketches differ in no more bits than the sets in elements."""
    odd = np.bincount((s.view(np.uint64) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def wide_sketch(s: np.ndarray) -> bytes | None:
    """A sketch with a bit for each element at least, of sets with more elements than ``BITS``: theirs have most bits flipped."""
    return sketch(s, 1 << (len(s) - 1).bit_length()) if len(s) > BITS else None


def folded(x: np.ndarray, size: int) -> np.ndarray:
    """Wide sketches, one a row, folded to ``size`` 64-bit words each."""
    return np.bitwise_xor.reduce(x.reshape(len(x), -1, size), axis=1)


def narrowed(x: bytes | None) -> bytes | None:
    """A wide sketch folded to ``NARROW`` bytes, where it is longer."""
    return folded(np.frombuffer(x, np.uint64)[None], NARROW // 8).tobytes() if x and len(x) > NARROW else None


def wide_near(x: bytes, m: int, ys: list[bytes], n: np.ndarray, similarity: float) -> np.ndarray:
    """``wide_similar`` of one set and many."""
    size, out = np.fromiter(map(len, ys), np.int64, len(ys)), np.zeros(len(ys), bool)
    for k in np.unique(size).tolist():
        at, w = np.flatnonzero(size == k), min(k, len(x)) // 8
        y = folded(np.frombuffer(b"".join(ys[i] for i in at.tolist()), np.uint64).reshape(len(at), -1), w)
        differ = np.bitwise_count(y ^ folded(np.frombuffer(x, np.uint64)[None], w)).sum(axis=1)
        out[at] = differ <= (m + n[at]) * (1 - similarity) / (1 + similarity) + 1e-6
    return out


def wide_similar(x: bytes | None, m: int, y: bytes | None, n: int, similarity: float) -> bool:
    """``may_be_similar`` by the wide sketches of two sets; the longer is folded to the size of the other."""
    if x is None or y is None:
        return True
    size = min(len(x), len(y)) // 8
    x, y = (np.bitwise_xor.reduce(np.frombuffer(z, np.uint64).reshape(-1, size), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum()) <= (m + n) * (1 - similarity) / (1 + similarity) + 1e-6


def may_be_similar(x: np.ndarray, m: np.ndarray, y: np.ndarray, n: np.ndarray, similarity: float) -> np.ndarray:
    """False only where sizes ``m``, ``n`` and sketches ``x``, ``y`` rule similarity out."""
    most = (m + n) * (1 - similarity) / (1 + similarity) + 1e-6
    out = np.abs(m - n) <= most
    at = np.flatnonzero(out)
    out[at] = np.bitwise_count(x[at] ^ y[at]).sum(axis=1) <= most[at]
    return out


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def _prefixes(cols: DataFrame, kind: str, shingle: int, seed: int, similarity: float) -> DataFrame:
    """``(id, th, sid, m, p, bits, wide, narrow, fp)`` for each row: the hashes of text and set, the set's size, prefix, sketches
    and fingerprint; of rows with one set the first in a task has prefix, sketches and fingerprint, the others none."""

    def run(batches):
        met: set[int] = set()
        for b in batches:
            sid, size, bits, wide, fp, parts, ends = [], [], [], [], [], [], [0]
            for t in b.column(1).to_pylist():
                s = shingle_set(t, shingle, seed)
                key = _set_hash(s)
                fresh = key not in met
                met.add(key)
                sid.append(key)
                size.append(len(s))
                bits.append(sketch(s) if fresh else None)
                wide.append(wide_sketch(s) if fresh else None)
                fp.append(fingerprint_of(s.view(np.uint64)) if fresh else None)
                parts.append(s[: prefix_size(len(s), similarity) if fresh else 0])
                ends.append(ends[-1] + len(parts[-1]))
            flat = np.concatenate(parts) if parts else np.array([], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            sketches = [pa.array(x, pa.binary()) for x in (bits, wide, list(map(narrowed, wide)))]
            columns = [b.column(0), b.column(2), pa.array(sid, pa.int64()), pa.array(size, pa.int64()), lists, *sketches, pa.array(fp, pa.uint64()).view(pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "th", "sid", "m", "p", "bits", "wide", "narrow", "fp"])

    return cols.mapInArrow(run, f"id {kind}, th long, sid long, m long, p array<long>, bits binary, wide binary, narrow binary, fp long")


def _elements(cols: DataFrame, texts: DataFrame, shingle: int, seed: int) -> DataFrame:
    """``(sid, s)`` of the texts whose hash is among ``texts``, and of some others.  A map of fixed size picks them where they
    lie, so other texts are not moved."""
    at = F.pmod(F.shiftright("th", 6), F.lit(WORDS)).alias("w")
    got = texts.groupBy(at).agg(F.bit_or(F.expr("shiftleft(1L, cast(th & 63 as int))")).alias("x")).toArrow()
    words = np.zeros(WORDS, np.int64)
    words[got["w"].to_numpy()] = got["x"].to_numpy()
    held = cols.sparkSession.sparkContext.broadcast(words.view(np.uint64))

    def run(batches):
        for b in batches:
            th = b.column(2).to_numpy()
            hit = held.value[(th >> 6) % WORDS] >> (th & 63).astype(np.uint64) & np.uint64(1)
            sets = [shingle_set(t, shingle, seed) for t in b.column(1).take(pa.array(np.flatnonzero(hit))).to_pylist()]
            if sets:
                ends = np.cumsum([0, *map(len, sets)])
                yield pa.RecordBatch.from_arrays([pa.array([_set_hash(x) for x in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))], names=["sid", "s"])

    return cols.mapInArrow(run, "sid long, s array<long>")


def _set_hash(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), 1) - (1 << 63)


def _verified(pairs: DataFrame, sets: DataFrame, elements, similarity: float, scratch: Scratch) -> DataFrame:
    """Of the pairs ``(a, b)`` of set hashes those whose sets have the similarity; sketches in ``sets`` are compared first, and
    ``elements`` gives the sets of what they leave."""

    def near(batches):
        for b in batches:
            m, n = b.column(2).to_numpy(), b.column(5).to_numpy()
            keep = may_be_similar(_sketches(b.column(3)), m, _sketches(b.column(6)), n, similarity)
            for i in np.flatnonzero(keep & (m > BITS) & (n > BITS)).tolist():
                keep[i] = wide_similar(b.column(4)[i].as_py(), m[i], b.column(7)[i].as_py(), n[i], similarity)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep))

    def exact(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def both(pairs: DataFrame, sets: DataFrame, *cols: str) -> DataFrame:
        left = sets.select(F.col("sid").alias("a"), *[F.col(c).alias(f"a_{c}") for c in cols])
        right = sets.select(F.col("sid").alias("b"), *[F.col(c).alias(f"b_{c}") for c in cols])
        return pairs.join(left, "a").join(right, "b").select("a", "b", *[f"a_{c}" for c in cols], *[f"b_{c}" for c in cols])

    left = scratch.save(both(pairs, sets, "m", "bits", "wide").mapInArrow(near, "a long, b long"))
    whole = elements(left.select(F.explode(F.array("a", "b")).alias("sid")).distinct())
    out = scratch.save(both(left, whole, "s").mapInArrow(exact, "a long, b long"))
    scratch.drop(left, whole)
    return out


def _fingerprint_pairs(firsts: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs ``(a, b)`` of set hashes that connect all sets whose fingerprints differ in at most four bits."""
    heads = scratch.save(firsts.groupBy("fp").agg(F.min("sid").alias("head")))
    equal = firsts.join(heads, "fp").filter("sid != head").select(F.col("head").alias("a"), F.col("sid").alias("b"))
    of = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"h_{c}"))
    near = fingerprint_links(heads.select("fp")).distinct().join(of("a"), "a").join(of("b"), "b")
    return equal.union(near.select(F.least("h_a", "h_b"), F.greatest("h_a", "h_b")))


def _cross_pairs(members: DataFrame, similarity: float, block: int) -> DataFrame:
    """Pairs of one key and different classes that sizes and sketches do not rule out; ``members`` is ``(h, n, sid, label, m,
    bits, wide)``.  Long sets have most of ``bits`` flipped, so these are told apart by ``wide``.  Keys of more than ``block`` members are dealt out over pairs of blocks."""
    nb = F.ceil(F.col("n") / block).cast("long")
    dealt = members.withColumn("mine", F.pmod(F.xxhash64("sid"), nb)).withColumn("nb", nb)
    dealt = dealt.select("h", F.explode(F.expr("transform(sequence(0L, nb - 1L), x -> least(x, mine) * nb + greatest(x, mine))")).alias("part"), "sid", "label", "m", "bits", "wide")

    def run(key, t):
        sid, label, m = (t[c].to_numpy() for c in ("sid", "label", "m"))
        bits, wide, a, b = _sketches(t["bits"]), t["wide"].to_pylist(), [], []
        for i in range(len(sid) - 1):
            j = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
            j = j[may_be_similar(np.broadcast_to(bits[i], (len(j), bits.shape[1])), np.full(len(j), m[i]), bits[j], m[j], similarity)]
            long = np.flatnonzero(m[j] > BITS)
            if m[i] > BITS and len(long):
                ok = wide_near(wide[i], m[i], [wide[k] for k in j[long].tolist()], m[j[long]], similarity)
                j = np.delete(j, long[~ok])
            a.append(np.minimum(sid[i], sid[j]))
            b.append(np.maximum(sid[i], sid[j]))
        a, b = (np.concatenate(x) if x else np.array([], np.int64) for x in (a, b))
        return pa.table({"a": a, "b": b})

    return dealt.groupBy("h", "part").applyInArrow(run, "a long, b long").distinct()


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, seed: int = 42, similarity: float = 0.8, keep_hash: bool = False, block: int = BLOCK) -> DataFrame:
    """``(id, class_fp, component_id, th)`` for every row: rows whose sets of word shingles have a Jaccard similarity of at least
    ``similarity`` are linked, classes are what links connect, ``component_id`` is the least id of the class.

    Pairs whose fingerprints (SimHash, pigeonring) differ in at most four bits are compared first.  No other pair is lost:
    similar sets share an element of their prefixes, the least hashes.  Members of a key are compared with one of them; then, where a key still has members of several classes, all pairs across classes are compared, sketches
    before elements.  Null text counts as empty; null ids are members but never name a class unless all ids of it are null.
    """
    scratch = Scratch(docs.sparkSession)
    cols = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("t"), F.xxhash64(text_col).alias("th"))
    full = scratch.save(_prefixes(cols, field_type(docs, id_col), shingle, seed, similarity))
    rows, firsts = scratch.save(full.select("id", "th", "sid")), full.filter("size(p) > 0")

    def elements(sids: DataFrame) -> DataFrame:
        sids = scratch.save(sids)
        texts = firsts.select("sid", "th").join(sids, "sid", "left_semi").groupBy("sid").agg(F.min("th").alias("th"))
        found = _elements(cols, texts, shingle, seed).join(sids, "sid", "left_semi")
        return scratch.save(found.dropDuplicates(["sid"]))

    keyed = firsts.select(F.explode("p").alias("h"), "sid")
    whole = Window.partitionBy("h")
    keyed = keyed.repartition("h").dropDuplicates(["h", "sid"])
    marked = keyed.select("h", "sid", F.count(F.lit(1)).over(whole).alias("n"), F.min("sid").over(whole).alias("first"), F.bit_xor(F.xxhash64("sid")).over(whole).alias("sig"))
    shared = scratch.save(marked.filter("n > 1"))
    # keys with the same members say the same
    one = shared.filter("sid = first").groupBy("first", "n", "sig").agg(F.min("h").alias("h")).select("h")
    every, shared = shared, scratch.save(shared.join(one, "h", "left_semi"))
    scratch.drop(every)
    sets = firsts.select("sid", "m", "bits", "wide", "narrow").join(shared.select("sid").distinct(), "sid", "left_semi")
    sets = scratch.save(sets.dropDuplicates(["sid"]))
    stars = shared.filter("sid != first").select(F.col("first").alias("a"), F.col("sid").alias("b"))
    star = _verified(_fingerprint_pairs(firsts, scratch).union(stars).distinct(), sets, elements, similarity, scratch)
    labels = component_labels(star).select(F.col("node").alias("sid"), F.col("component").alias("label"))
    labelled = shared.join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    mixed = labelled.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("h")
    members = labelled.select("h", "n", "sid", "label").join(mixed, "h", "left_semi").join(sets.withColumn("wide", F.coalesce("narrow", "wide")).drop("narrow"), "sid")
    members = scratch.save(members)
    across = scratch.save(_cross_pairs(members, similarity, block))
    scratch.drop(members)
    links = star.union(_verified(across, sets, elements, similarity, scratch))
    labels = component_labels(links).select(F.col("node").alias("sid"), F.col("component").alias("class_fp"))
    least = rows.groupBy("sid").agg(F.min("id").alias("least_id")).join(labels, "sid", "left")
    named = scratch.save(least.select("sid", "least_id", F.coalesce("class_fp", "sid").alias("class_fp")))
    classes = named.groupBy("class_fp").agg(F.min("least_id").alias("component_id"))
    by_set = scratch.save(named.select("sid", "class_fp").join(classes, "class_fp"))
    scratch.drop(shared, sets, across, full, named)
    return rows.select("id", "th", "sid").join(by_set, "sid").select("id", "class_fp", "component_id", "th")
