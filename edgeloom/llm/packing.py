"""Packing token sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.text import field_type, map_arrow, text_bytes

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: White space characters in a row from which a text goes to ``tokenizers``.
BLANKS = 1000


def long_blank(text: str, run: int = BLANKS) -> bool:
    """Whether ``run`` characters of white space follow each other; half as many may suffice.  Such a run covers one of every
    ``run``-th places and reaches half its length to one side of it, so only those places are looked at."""
    half = run // 2
    return len(text) >= run and any(c.isspace() and (text[i * run : i * run + half].isspace() or text[max(0, i * run - half + 1) : i * run + 1].isspace()) for i, c in enumerate(text[::run]))


class Encoder:
    """Token ids by a ``tokenizers`` file.  With the same vocabulary as ranks, ``tiktoken`` gives the same ids several times
    faster.  Two kinds of text go to ``tokenizers`` itself: those that hold a special token's string, which it sees by default,
    and those with a long run of white space, on which the pattern of ``tiktoken`` runs out of stack."""

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special) or long_blank(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def karmarkar_karp(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(bin of each item, loads)``.  Each item starts as a partial partition into k bins; the two partitions with the widest
    spread are merged again and again, the fullest bin of one with the emptiest of the other."""
    n = len(sizes)
    link = np.full(n, -1, np.int64)  # items of a bin as linked lists
    zero, none = np.zeros(k, np.int64), np.full(k, -1, np.int64)
    heap = []
    for i, s in enumerate(sizes.tolist()):
        heap.append((-s, i, s))
    heapq.heapify(heap)
    if not n:
        return np.zeros(0, np.int64), zero

    parts: dict[int, tuple] = {}

    def take():
        _, i, s = heapq.heappop(heap)
        got = parts.pop(i, None)
        if got is None:
            load, head, tail = zero.copy(), none.copy(), none.copy()
            load[0], head[0], tail[0] = s, i, i
            got = (load, head, tail)
        return i, got

    while len(heap) > 1:
        i, (la, ha, ta) = take()
        _, (lb, hb, tb) = take()
        lb, hb, tb = lb[::-1], hb[::-1], tb[::-1]
        both = (ta >= 0) & (hb >= 0)
        link[ta[both]] = hb[both]
        load = la + lb
        head = np.where(ha >= 0, ha, hb)
        tail = np.where(tb >= 0, tb, ta)
        order = np.argsort(-load, kind="stable")
        load = load[order]
        parts[i] = (load, head[order], tail[order])
        heapq.heappush(heap, (int(load[-1] - load[0]), i, 0))
    _, (load, head, _) = take()
    bins = np.empty(n, np.int64)
    at, which = head[head >= 0], np.flatnonzero(head >= 0)
    while len(at):
        bins[at] = which
        at = link[at]
        which, at = which[at >= 0], at[at >= 0]
    return bins, load


class Packer:
    """Windows of one partition.  Documents give whole windows and pieces of at most ``piece`` ids; pieces wait until they
    fill ``windows`` windows but for one free place each, then the differencing method spreads them.  If a window comes out
    over capacity, the count of windows rises.  What is left at the end fills windows of powers of two, which need no padding."""

    def __init__(self, capacity: int, piece: int, windows: int, first_id: int):
        self.capacity, self.piece, self.windows, self.next_id = capacity, piece, windows, first_id
        self.pool: list[tuple] = []  # (document, start, ids, ids of the document)
        self.held = 0
        self.out: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        n = len(ids)
        full = n - n % self.capacity
        for s in range(0, full, self.capacity):
            self._emit([(doc, s, ids[s : s + self.capacity], n)])
        for s in range(full, n, self.piece):
            part = ids[s : s + self.piece]
            self.pool.append((doc, s, part, n))
            self.held += len(part)
        most = self.windows * (self.capacity - 1)
        while self.held >= most:
            self._spread(self._cut(most), self.windows)

    def _cut(self, want: int) -> list[tuple]:
        """Takes pieces of exactly ``want`` ids off the pool, cutting the last one."""
        got, size, i = [], 0, 0
        while size < want:
            doc, s, ids, n = self.pool[i]
            room = want - size
            if len(ids) > room:
                got.append((doc, s, ids[:room], n))
                self.pool[i] = (doc, s + room, ids[room:], n)
                size = want
            else:
                got.append(self.pool[i])
                size += len(ids)
                i += 1
        self.pool = self.pool[i:]
        self.held -= want
        return got

    def _spread(self, pieces: list[tuple], k: int) -> None:
        sizes = np.array([len(p[2]) for p in pieces], np.int64)
        while True:
            bins, loads = karmarkar_karp(sizes, k)
            if not len(loads) or loads.max() <= self.capacity:
                break
            k += 1
        rows: list[list] = [[] for _ in range(k)]
        for p, b in zip(pieces, bins.tolist()):
            rows[b].append(p)
        for r in rows:
            self._emit(r)

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, s, ids, n in pieces:
            self.out.append((doc, s, len(ids), zlib.crc32(ids.tobytes()), n, self.next_id, offset))
            offset += len(ids)
        self.next_id += bool(pieces)

    def finish(self) -> None:
        k = self.held // self.capacity
        if k > 1:
            self._spread(self._cut(k * (self.capacity - 1)), k)
        while self.held:
            self._emit(self._cut(min(self.capacity, 1 << (self.held.bit_length() - 1))))


def pack(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", eod: int = 1, capacity: int = 2048, piece: int = 512, windows: int = 256) -> DataFrame:
    """One row for each piece of a document: ``(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset)``.

    Each partition packs its own documents, so nothing is shuffled; a window's number is the partition's number and a count.
    Null text is empty (the closing id alone); repeated rows are packed each; null ids stay null; an empty table gives no
    rows; other columns are not read.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def run(batches):
        import public_tokenizers as P

        enc = Encoder(tokenizer or P.path("byte_bpe_50k.json"), ranks or (None if tokenizer else P.path("byte_bpe_50k.tiktoken")))
        packer = Packer(capacity, piece, windows, TaskContext.get().partitionId() << 33)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packer.add(doc, np.array([*enc.encode(text.decode("utf-8", "replace")), eod], "<u4"))
                if len(packer.out) >= 20_000:
                    yield packer.out
                    packer.out = []
        packer.finish()
        yield packer.out

    cols = docs.select(F.col(id_col), text_bytes(text_col).alias("_t"))
    return map_arrow(cols, run, f"`{id_col}` {field_type(docs, id_col)}, {SCHEMA}")
