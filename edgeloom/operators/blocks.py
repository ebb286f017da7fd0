"""Links of a large graph as blocks of arrays, for operators that read all of them in every round.

Nodes are dealt into blocks by hash and numbered within their block; a row of links holds those of one block of sources (or of
a slice of it, where a hub has very many) in the order of their targets.  A round then sends one array of partial sums for each
pair of blocks that are linked, instead of one row for each link, and no link is moved or sorted again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.storage import Scratch

#: Links of a block on average; a row holds about twice as many at most.
LINKS = 250_000


def _bytes(a, kind) -> bytes:
    return np.ascontiguousarray(a, kind).tobytes()


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


LINK_ROW = pa.schema([("i", pa.int32()), ("slice", pa.int32()), ("source", pa.binary()), ("first", pa.binary()), ("target", pa.binary()), ("to", pa.binary()), ("cut", pa.binary())])
MESSAGE = pa.schema([("j", pa.int32()), ("i", pa.int32()), ("slice", pa.int32()), ("at", pa.binary()), ("sum", pa.binary())])
STATE = pa.schema([("b", pa.int32()), ("share", pa.binary()), ("rank", pa.binary()), ("loose", pa.float64())])
SPARK = {pa.int32(): "int", pa.binary(): "binary", pa.float64(): "double"}


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {SPARK[f.type]}" for f in schema)


def pack_links(table: pa.Table) -> pa.Table:
    """Links ``(i, slice, s, j, t)`` of one row: their sources in the order of targets, where each target's begin, the targets,
    and the blocks of targets with the place where each begins."""
    s, j, t = (table[c].to_numpy() for c in ("s", "j", "t"))
    order = np.lexsort((s, t, j))
    s, j, t = s[order], j[order], t[order]
    new = np.ones(len(s), bool)
    new[1:] = (j[1:] != j[:-1]) | (t[1:] != t[:-1])
    first = np.flatnonzero(new)
    to, cut = np.unique(j[first], return_index=True)
    row = (table["i"][0].as_py(), table["slice"][0].as_py(), _bytes(s, np.int32), _bytes(first, np.int64), _bytes(t[first], np.int32), _bytes(to, np.int32), _bytes(np.append(cut, len(first)), np.int64))
    return _rows(LINK_ROW, [row])


def send(batches):
    """Partial sums of the shares that one row of links gives each block of targets."""
    for batch in batches:
        for k in range(batch.num_rows):
            r = {c: batch.column(c)[k].as_py() for c in ("i", "slice", "source", "first", "target", "to", "cut", "share")}
            share, source, first, target, to, cut = (np.frombuffer(r[c], d) for c, d in (("share", np.float64), ("source", np.int32), ("first", np.int64), ("target", np.int32), ("to", np.int32), ("cut", np.int64)))
            sums = np.add.reduceat(share[source], first)
            out = [(int(j), r["i"], r["slice"], target[a:b].tobytes(), sums[a:b].tobytes()) for j, a, b in zip(to, cut[:-1], cut[1:])]
            yield from _rows(MESSAGE, out).to_batches()


class Blocks:
    """The blocks of ``adj(u, v)`` over ``nodes(id)``, ``per`` links in each on average."""

    def __init__(self, adj: DataFrame, nodes: DataFrame, scratch: Scratch, per: int = LINKS):
        self.scratch = scratch
        degree = adj.groupBy("u").agg(F.count(F.lit(1)).alias("degree"))
        state = scratch.save(nodes.join(degree, nodes["id"] == degree["u"], "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree")))
        sizes = state.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("degree"), F.lit(0)).alias("links")).first()
        self.n = sizes["n"]
        parts = max(1, -(-max(sizes["n"], sizes["links"]) // per))
        b = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("b")
        held = state.groupBy(b).agg(F.sort_array(F.collect_list(F.struct("id", "degree"))).alias("nodes"), F.ceil(F.sum("degree") / (2 * per)).cast("int").alias("slices"))
        self.nodes = scratch.save(held.select("b", F.col("nodes.id").alias("ids"), F.col("nodes.degree").alias("degrees"), "slices"))
        scratch.drop(state)
        place = self.nodes.select("b", "slices", F.posexplode("ids").alias("p", "id"))
        source = place.select(F.col("id").alias("u"), F.col("b").alias("i"), F.col("p").alias("s"), "slices")
        target = place.select(F.col("id").alias("v"), F.col("b").alias("j"), F.col("p").alias("t"))
        links = adj.join(source, "u").withColumn("slice", F.pmod(F.xxhash64("v"), F.col("slices")).cast("int")).join(target, "v")
        packed = links.select("i", "slice", "s", "j", "t").groupBy("i", "slice").applyInArrow(pack_links, ddl(LINK_ROW))
        self.links = scratch.bucketed(packed, "i")

    def ranks(self, iterations: int, damping: float) -> DataFrame:
        """``(node, rank)`` by power iteration; of a round only the dangling mass goes to the driver."""
        n = self.n

        def state(degrees, rank, b):
            degree = np.asarray(degrees, np.int64)
            return (b, _bytes(rank / np.maximum(degree, 1), np.float64), _bytes(rank, np.float64), float(rank[degree == 0].sum()))

        def begin(batches):
            for batch in batches:
                for b, degrees in zip(batch.column(0).to_pylist(), batch.column(1)):
                    yield from _rows(STATE, [state(degrees.values, np.full(len(degrees.values), 1.0 / n), b)]).to_batches()

        held = self.nodes.select("b", "degrees")
        now = self.scratch.save(held.mapInArrow(begin, ddl(STATE)))
        for _ in range(iterations):
            base = (1.0 - damping) / n + damping * now.agg(F.sum("loose")).first()[0] / n

            def gather(node, got):
                degrees = node["degrees"][0].values
                total = np.zeros(len(degrees))
                rows = sorted(zip(got["i"].to_pylist(), got["slice"].to_pylist(), range(got.num_rows)))
                for _, _, k in rows:
                    total[np.frombuffer(got["at"][k].as_py(), np.int32)] += np.frombuffer(got["sum"][k].as_py(), np.float64)
                return _rows(STATE, [state(degrees, base + damping * total, node["b"][0].as_py())])

            sent = self.links.join(now.select("b", "share"), self.links["i"] == now["b"]).drop("b").mapInArrow(send, ddl(MESSAGE))
            new = self.scratch.save(held.groupBy("b").cogroup(sent.groupBy("j")).applyInArrow(gather, ddl(STATE)))
            self.scratch.drop(now)
            now = new
        self.scratch.drop(self.links)

        def rows(batches):
            for batch in batches:
                for ids, rank in zip(batch.column(0), batch.column(1).to_pylist()):
                    yield pa.RecordBatch.from_arrays([ids.values.cast(pa.int64()), pa.array(np.frombuffer(rank, np.float64))], names=["node", "rank"])

        return self.nodes.join(now.select("b", "rank"), "b").select("ids", "rank").mapInArrow(rows, "node long, rank double")
