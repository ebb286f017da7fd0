"""Exact top-k inner products through a pivot-distance index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.storage import Scratch

SAMPLE = 4096
#: Pivots at least and at most; between them the square root of the blocks.
PIVOTS = (32, 1024)
#: Rows of an annulus, and of one block of it.
BLOCK = 1024
#: Queries that meet one copy of a block; queries compared at a time.
VISITS, SLICE = 1 << 16, 128
#: Bytes of vectors in one Arrow batch.
BATCH = 1 << 22
#: Annuli a query visits in its second round, the nearest by their bounds.
NEAREST = 8


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """``(id, v)`` with integer components floor(scale * x) as doubles.  Vectors that are null, empty or hold a null or
    non-finite component are left out."""
    x = F.col(vec_col)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).filter(x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(bad, F.lit(True)))
    return rows.select("id", F.transform("x", lambda e: F.floor(e.cast("double") * scale).cast("double")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """Farthest-first centres, then two rounds of means; deterministic."""
    if not len(sample):
        return sample
    chosen = [0]
    d = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(k, len(sample)) and d.max() > 0:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    centres = sample[chosen].astype(float)
    for _ in range(2):
        near = _distances(sample, centres).argmin(1)
        for j in range(len(centres)):
            if (near == j).any():
                centres[j] = sample[near == j].mean(0)
    return centres


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def _lifted(v: np.ndarray, norm2: float) -> np.ndarray:
    """One more component that gives every vector the same norm: nearest is then largest inner product."""
    return np.hstack([v, np.sqrt(np.maximum(norm2 - (v * v).sum(1), 0))[:, None]])


def _asking(v: np.ndarray) -> np.ndarray:
    """A query's place among lifted vectors: with 0 as its last component its squared distance to a lifted vector is
    |q|^2 + norm2 - 2 * score, whatever the query's own norm."""
    return np.hstack([v, np.zeros((len(v), 1))])


def _best(scores: np.ndarray, ids: np.ndarray, floor: np.ndarray, own: np.ndarray, k: int):
    """Of each row the k highest scores of at least ``floor``, ties to smaller ids; a query's own id is left out."""
    for i in range(len(scores)):
        s = scores[i]
        at = np.flatnonzero((s >= floor[i]) & (ids != own[i]))
        if len(at) > k:
            cut = np.partition(s[at], len(at) - k)[len(at) - k]
            at = at[s[at] >= cut]
            at = at[np.lexsort((ids[at], -s[at]))[:k]]
        yield i, at


def _slices(rows: int, width: int):
    step = max(1, BATCH // (8 * max(width, 1)))
    return (slice(i, i + step) for i in range(0, rows, step))


def _batch(names: str, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[n] for n in names.split()], names=names.split())


ROW = "key kind id v x"
ROW_SCHEMA = "key long, kind int, id long, v array<double>, x double"


def top_k(vectors: DataFrame, k: int = 20, query_every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, pivots: tuple[int, int] = PIVOTS, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k highest integer inner products.

    Queries are the rows whose id is divisible by ``query_every``; candidates all rows of another id.  Index: pivots, whose
    number grows with the rows, are fit on at most about ``sample`` vectors; every vector is keyed by its nearest pivot and its
    annulus, a range of the sorted distances to that pivot that holds about ``block`` rows.  Vectors are lifted to equal norm
    and queries by 0, so a score bounds a distance.

    A query visits annuli in three rounds: its own; the nearest ones by the triangle inequality's bound; all others whose
    bound lies within the radius of its k-th score so far.  Each round raises that score, and an annulus beyond it is never
    visited: there the search stops.  Within an annulus the same bound picks the range of distances.  An annulus of many equal
    distances is cut into blocks by a hash, and a block that very many queries visit is copied for each ``VISITS`` of them;
    otherwise the vectors are not copied.  A task holds one block and a slice of queries at a time.

    Ties go to the smaller id; fewer than k candidates give all.  Rows with a null id are left out; rows that share an id are
    one another's own and the least of their vectors asks; empty vectors are left out.  All vectors must have the same length.
    An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = scratch.save(quantised(vectors, id_col, vec_col, scale).dropna())
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.min(F.size("v")).alias("least"), F.max(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e)).alias("norm2"), F.count(F.when(F.col("id") % query_every == 0, 1)).alias("queries")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n, width, norm2 = facts["n"], facts["width"], float(facts["norm2"])
    if facts["least"] != width:
        raise ValueError("vectors differ in length")
    share = min(1.0, sample / n)
    # the sample has a bounded expected size whatever the input's
    picked = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).orderBy(F.xxhash64("id"), "id").limit(2 * sample).toArrow()
    centres = _pivots(_lifted(_matrix(picked["v"], width), norm2), min(pivots[1], max(pivots[0], int((n / block) ** 0.5))))
    slack = 1e-6 * (1.0 + norm2)

    def index(batches):
        for b in batches:
            v = _matrix(b.column(1), width)
            d = _distances(_lifted(v, norm2), centres)
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near, pa.int32()), pa.array(d[np.arange(len(d)), near])], names=["id", "v", "pivot", "dist"])

    placed = scratch.save(rows.mapInArrow(index, "id long, v array<double>, pivot int, dist double"))
    scratch.drop(rows)
    # the borders of the annuli: about one for each block of rows, the only thing held on the driver that grows with the rows
    counts = {r["pivot"]: r["n"] for r in placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = -(-max(counts.values()) // block)
    cuts = [i / most for i in range(1, most)]
    got = placed.groupBy("pivot").agg(F.percentile_approx("dist", cuts, max(10_000, 20 * most)).alias("q")).collect() if cuts else []
    borders = {p: np.zeros(0) for p in counts}
    for r in got:
        wanted = -(-counts[r["pivot"]] // block)
        at = np.unique(np.round(np.arange(1, wanted) * most / wanted).astype(int)) - 1
        borders[r["pivot"]] = np.unique(np.array(r["q"])[at])

    def ring_of(pivot: np.ndarray, dist: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pivot), np.int32)
        for p in np.unique(pivot).tolist():
            at = pivot == p
            out[at] = np.searchsorted(borders[p], dist[at], side="left")
        return out

    def with_ring(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ring_of(b.column(0).to_numpy(), b.column(1).to_numpy()))], names=["pivot", "dist", "ring"])

    sizes = placed.select("pivot", "dist").mapInArrow(with_ring, "pivot int, dist double, ring int").groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).collect()
    table = sorted((r["pivot"], r["ring"], -(-r["n"] // block), r["lo"], r["hi"]) for r in sizes)
    owner, lo, hi = (np.array([t[i] for t in table]) for i in (0, 3, 4))
    parts = np.array([t[2] for t in table])
    first = np.concatenate([[0], np.cumsum(parts)])
    number = {t[:2]: i for i, t in enumerate(table)}

    def annulus_of(pivot: np.ndarray, dist: np.ndarray) -> np.ndarray:
        return np.array([number[key] for key in zip(pivot.tolist(), ring_of(pivot, dist).tolist())], np.int64)

    base = placed.withColumn("h", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)))
    one = F.min(F.struct("v", "pivot", "dist", "h")).alias("r")
    queries = scratch.save(base.filter(F.col("id") % query_every == 0).groupBy("id").agg(one).select("id", "r.*"))

    def visited(b, stage: int):
        """(query rows, blocks) that a batch of queries visits in a round."""
        v = _matrix(b.column(1), width)
        own = annulus_of(b.column(2).to_numpy(), b.column(3).to_numpy())
        if stage == 0:
            return np.arange(len(v)), first[own] + b.column(4).to_numpy() % parts[own]
        floor = np.where(np.isnan(f := b.column(5).to_numpy(zero_copy_only=False)), -np.inf, f)
        asked, radius = _asking(v), np.sqrt(np.maximum((v * v).sum(1) + norm2 - 2 * floor, 0)) + slack
        who, keys = [], []
        for i in range(len(v)):
            # summed query by query: the last bits must not depend on what else is in the batch, or rounds would disagree
            dp = np.sqrt(((centres - asked[i]) ** 2).sum(1))[owner]
            bound = np.maximum(np.maximum(lo - dp, dp - hi), 0.0)
            # the own annulus and the nearest others; then the rest
            order = np.lexsort((np.arange(len(bound)), bound))[:NEAREST]
            near = np.union1d(order, own[i])
            rings = near if stage == 1 else np.setdiff1d(np.flatnonzero(bound <= radius[i]), near, assume_unique=True)
            rings = rings[bound[rings] <= radius[i]]
            for j in rings.tolist():
                keys.append(np.arange(first[j], first[j + 1]))
                who.append(np.full(parts[j], i))
        none = np.zeros(0, np.int64)
        return (np.concatenate(who), np.concatenate(keys)) if keys else (none, none)

    def meet(asking: DataFrame, stage: int) -> DataFrame:
        def keys_only(batches):
            for b in batches:
                for s in range(0, b.num_rows, 256):
                    _, keys = visited(b.slice(s, 256), stage)
                    at, many = np.unique(keys, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(many.astype(np.int64))], names=["block", "n"])

        # blocks that more than VISITS queries visit, with their copies; fewer queries than that have none
        hot = {}
        if stage and facts["queries"] > VISITS:
            seen = asking.mapInArrow(keys_only, "block long, n long").groupBy("block").agg(F.sum("n").alias("n")).filter(F.col("n") > VISITS)
            hot = {r["block"]: -(-r["n"] // VISITS) for r in seen.collect()}

        def ask(batches):
            for whole in batches:
                for s in range(0, whole.num_rows, 256):
                    b = whole.slice(s, 256)
                    who, keys = visited(b, stage)
                    salt = b.column(4).to_numpy()[who]
                    if hot:
                        copies = np.array([hot.get(x, 1) for x in keys.tolist()], np.int64)
                        keys = keys + (salt // 7 % copies) * int(first[-1])
                    floor = np.full(b.num_rows, np.nan) if stage == 0 else b.column(5).to_numpy(zero_copy_only=False)
                    for part in _slices(len(who), width):
                        w = pa.array(who[part], pa.int64())
                        yield _batch(ROW, key=pa.array(keys[part].astype(np.int64)), kind=pa.array(np.ones(len(w), np.int32)), id=b.column(0).take(w), v=b.column(1).take(w), x=pa.array(floor[who[part]]))

        def store(batches):
            for b in batches:
                ring = annulus_of(b.column(2).to_numpy(), b.column(3).to_numpy())
                keys = first[ring] + b.column(4).to_numpy() % parts[ring]
                copies = np.array([hot.get(x, 1) for x in keys.tolist()], np.int64) if hot else np.ones(len(keys), np.int64)
                take = np.repeat(np.arange(len(keys)), copies)
                turn = np.arange(len(take)) - np.repeat(np.cumsum(copies) - copies, copies)
                for part in _slices(len(take), width):
                    t = pa.array(take[part], pa.int64())
                    yield _batch(ROW, key=pa.array(keys[take[part]] + turn[part] * int(first[-1])), kind=pa.array(np.zeros(len(t), np.int32)), id=b.column(0).take(t), v=b.column(1).take(t), x=b.column(3).take(t))

        def search(batches):
            key, held, out, waiting = None, [], [], 0
            for b in batches:
                ks, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
                edges = np.flatnonzero((ks[1:] != ks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
                for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(ks)]):
                    if ks[s] != key:
                        key, held = int(ks[s]), []
                    part = b.slice(s, e - s)
                    x, ids, other = _matrix(part.column(3), width), part.column(2).to_numpy(), part.column(4).to_numpy(zero_copy_only=False)
                    if kinds[s] == 0:
                        held.append((x, ids, other))
                        continue
                    if not held:
                        continue
                    if len(held) > 1 or len(held[0]) == 3:
                        v, own, dist = (np.concatenate([h[i] for h in held]) for i in range(3))
                        order = np.argsort(dist, kind="stable")
                        held = [(v[order], own[order], dist[order], None)]
                    v, own, dist, _ = held[0]
                    for found in _compared(x, ids, np.where(np.isnan(other), -np.inf, other), v, own, dist, centres[owner[np.searchsorted(first, key % int(first[-1]), side="right") - 1]], norm2, slack, k):
                        out.append(found)
                        waiting += len(found[0])
                if waiting > 100_000:
                    yield _found(out)
                    out, waiting = [], 0
            if out:
                yield _found(out)

        # an even share of blocks for each task: the work is in the comparisons, not in the bytes
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
        met = base.mapInArrow(store, ROW_SCHEMA).unionByName(asking.mapInArrow(ask, ROW_SCHEMA))
        return met.repartition(tasks, "key").sortWithinPartitions("key", "kind").mapInArrow(search, "query_id long, vec_id long, score long")

    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best, asking = None, queries
    for stage in range(3):
        found = meet(asking, stage)
        # the home block is met again with its whole annulus
        found = found if best is None or stage == 1 else found.unionByName(best.select(*found.columns))
        best = scratch.save(found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
        low = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).select("query_id", F.when(F.col("n") >= k, F.col("low").cast("double")).alias("floor"))
        asking = queries.join(low, queries["id"] == low["query_id"], "left").select("id", "v", "pivot", "dist", "h", F.coalesce("floor", F.lit(float("nan"))).alias("floor"))
    return best


def _compared(q, own, floor, v, ids, dist, centre, norm2: float, slack: float, k: int):
    """(query ids, candidate ids, scores) of a block's best; queries go in order of their distance to the pivot, so those of one
    slice reach about the same range of the sorted distances."""
    d = _distances(_asking(q), centre[None])[:, 0]
    r = np.sqrt(np.maximum((q * q).sum(1) + norm2 - 2 * floor, 0)) + slack
    order = np.argsort(d, kind="stable")
    for s in range(0, len(order), SLICE):
        at = order[s : s + SLICE]
        a, b = np.searchsorted(dist, (d[at] - r[at]).min()), np.searchsorted(dist, (d[at] + r[at]).max(), side="right")
        if a >= b:
            continue
        scores = q[at] @ v[a:b].T
        for i, best in _best(scores, ids[a:b], floor[at], own[at], k):
            if len(best):
                yield np.full(len(best), own[at[i]]), ids[a:b][best], scores[i][best]


def _found(out: list[tuple]) -> pa.RecordBatch:
    q, c, s = (np.concatenate([o[i] for o in out]) for i in range(3))
    return pa.RecordBatch.from_arrays([pa.array(q), pa.array(c), pa.array(np.rint(s).astype(np.int64))], names=["query_id", "vec_id", "score"])
