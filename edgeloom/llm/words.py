"""Words of many texts at once: found, hashed and looked up as arrays of bytes, without one Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END = b""
#: Texts are read in slices of about so many bytes, one text at least; words are hashed in blocks of about so many.
SLICE, BLOCK = 1 << 22, 1 << 16
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)


def slices(texts: list[bytes], most: int = SLICE) -> Iterator[list[bytes]]:
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= most):
            size += len(texts[end])
            end += 1
        yield texts[start:end]
        start = end


def column_slices(column: pa.Array, most: int = SLICE) -> Iterator[list[bytes]]:
    """The ``slices`` of an Arrow column without nulls; only one of them exists as Python objects at a time."""
    ends, start = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield column.slice(start, end - start).to_pylist()
        start = end


def _blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of words of about ``BLOCK`` bytes, one word at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK, "right")) - 1)
        yield a, z
        a = z


def _polynomials(chars: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, none of them empty: polynomials in their bytes modulo 2**64, mixed."""
    size = np.diff(offsets)
    out = np.empty(len(size), np.uint64)
    if not len(size):
        return out
    powers = np.cumprod(np.full(int(size.max()), _BASE, np.uint64))
    for a, z in _blocks(offsets):
        at = offsets[a:z] - offsets[a]
        place = np.arange(offsets[z] - offsets[a]) - np.repeat(at, size[a:z])
        out[a:z] = np.add.reduceat(_BYTES[chars[offsets[a] : offsets[z]]] * powers[place], at)
    return _mixed(out)


def gathered(chars: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some words put together, with their offsets."""
    offsets = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(offsets[-1], np.uint8)
    for a, z in _blocks(offsets):
        at = np.repeat(begin[a:z] - offsets[a:z], size[a:z])
        out[offsets[a] : offsets[z]] = chars[at + np.arange(offsets[a], offsets[z])]
    return out, offsets


def binary_column(chars: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Words, of less than 2 GB in all, as an Arrow column."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(chars)])


def column_hashes(column: pa.Array) -> np.ndarray:
    """The hashes of an Arrow column of words without nulls; that of the end is 0."""
    _, at, chars = column.buffers()
    offsets = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    size, out = np.diff(offsets), np.zeros(len(column), np.uint64)
    if len(column) and offsets[-1] > offsets[0]:
        some = np.flatnonzero(size)
        out[some] = _polynomials(np.frombuffer(chars, np.uint8)[offsets[0] : offsets[-1]], np.concatenate([[0], np.cumsum(size[some])]))
    return out


class Counts:
    """Words, none of them empty, with counts: collected as arrays, then summed by hash.  Words taken as equal are compared byte
    by byte, and one that only shares its hash with another is counted apart."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, hash_: np.ndarray, chars: np.ndarray, offsets: np.ndarray, counts: np.ndarray | None = None) -> None:
        self.parts.append((hash_, chars, np.diff(offsets), np.ones(len(hash_), np.int64) if counts is None else counts))
        self.size += len(hash_)

    def sums(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """``(hash, chars, offsets, counts)`` of different words, once for nearly all and once more for each turn of words that
        share their hash with one before; nothing is kept."""
        if not self.size:
            return
        hash_, chars, size, counts = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.size = [], 0
        begin = np.cumsum(size) - size
        while len(hash_):
            order = np.argsort(hash_, kind="stable")
            h = hash_[order]
            is_first = np.concatenate([[True], h[1:] != h[:-1]])
            first = np.flatnonzero(is_first)
            model = order[first][np.cumsum(is_first) - 1]
            same = size[order] == size[model]
            again = np.flatnonzero(same & ~is_first)
            ends = np.concatenate([[0], np.cumsum(size[order[again]])])
            for a, z in _blocks(ends):
                at = again[a:z]
                n = size[order[at]]
                place = np.arange(ends[a], ends[z]) - np.repeat(ends[a:z], n)
                equal = chars[np.repeat(begin[order[at]], n) + place] == chars[np.repeat(begin[model[at]], n) + place]
                if not equal.all():
                    same[at] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
            one = order[first]
            yield hash_[one], *gathered(chars, begin[one], size[one]), np.add.reduceat(counts[order] * same, first)
            left = order[~same]
            hash_, size, counts, begin = hash_[left], size[left], counts[left], begin[left]


def hashes_of(words: list[bytes]) -> np.ndarray:
    """The same hashes for a list of words; that of the end is 0."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros(len(words), np.uint64)
    out[size > 0] = _polynomials(np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum(size[size > 0])]))
    return out


class Tokens:
    """The lower-cased words of some texts (one at least), with one end after each text.

    ``hash`` has an entry for each word and end; text ``i`` has those from ``starts[i]`` to ``starts[i + 1]``."""

    def __init__(self, texts: list[bytes]):
        self.data = (b" ".join(texts) + b" ").lower()
        buffer = np.frombuffer(self.data, np.uint8)
        gap = np.concatenate([[True], _GAP[buffer]])
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        self.begin, self.until = edges[::2], edges[1::2]
        words_before = np.searchsorted(self.begin, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1))
        self.starts = np.concatenate([[0], words_before + np.arange(1, len(texts) + 1)])
        self.chars, self.offsets = buffer[~gap[1:]], np.concatenate([[0], np.cumsum(self.until - self.begin)])
        is_word = np.ones(self.starts[-1], bool)
        is_word[self.starts[1:] - 1] = False
        self.word_at = np.flatnonzero(is_word)
        self.word_hash = _polynomials(self.chars, self.offsets)
        self.hash = np.zeros(len(is_word), np.uint64)
        self.hash[self.word_at] = self.word_hash

    def words(self, at: np.ndarray) -> list[bytes]:
        """The words at some places, ends as the empty word."""
        text = np.searchsorted(self.starts[1:], at, "right")
        number, is_end = at - text, at == self.starts[text + 1] - 1
        begin, until = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        begin[~is_end], until[~is_end] = self.begin[number[~is_end]], self.until[number[~is_end]]
        return [self.data[a:z] for a, z in zip(begin.tolist(), until.tolist())]


    def some(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, bytes and offsets of the words at some places, ends as empty words."""
        text = np.searchsorted(self.starts[1:], at, "right")
        number, is_word = at - text, at != self.starts[text + 1] - 1
        begin, size = np.zeros((2, len(at)), np.int64)
        begin[is_word] = self.offsets[number[is_word]]
        size[is_word] = self.offsets[number[is_word] + 1] - begin[is_word]
        return self.hash[at], *gathered(self.chars, begin, size)


class Lookup:
    """Finds words of a fixed list.  Two words in one slot: the earlier in the list has it, so frequent words come first."""

    def __init__(self, words: list[bytes]):
        self.number = {w: i for i, w in enumerate(words)}
        self.end = self.number.get(END, -1)
        size = np.fromiter(map(len, words), np.int64, len(words))
        self.chars, self.offsets = np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum(size)])
        self.size, self.hash = size, hashes_of(words)
        bits = max(10, (8 * len(words)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slot = np.full(1 << bits, -1, np.int32)
        back = np.flatnonzero(size)[::-1]
        places = self.hash[back] >> self.shift
        self.slot[places] = back
        self.crowded = np.bincount(places.astype(np.int64), minlength=1 << bits) > 1

    def find(self, t: Tokens) -> np.ndarray:
        """For each word and end of ``t`` its number in the list, or -1.  Words are compared byte by byte."""
        out = np.full(len(t.hash), -1, np.int64)
        out[t.starts[1:] - 1] = self.end
        if not len(self.size) or not len(t.word_hash):
            return out
        got = self.slot[t.word_hash >> self.shift].astype(np.int64)
        size = t.until - t.begin
        same = (got >= 0) & (self.hash[got] == t.word_hash) & (self.size[got] == size)
        shift = self.offsets[got] - t.offsets[:-1]
        for a, z in _blocks(t.offsets):
            ok, n = same[a:z], size[a:z]
            here = np.arange(t.offsets[a], t.offsets[z])[np.repeat(ok, n)]
            equal = t.chars[here] == self.chars[here + np.repeat(shift[a:z][ok], n[ok])]
            if not equal.all():
                n = n[ok]
                same[a + np.flatnonzero(ok)] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
        got[~same] = -1
        # words that may have lost their slot to another of the list
        lost = np.flatnonzero(~same & self.crowded[t.word_hash >> self.shift])
        if len(lost):
            get = self.number.get
            got[lost] = [get(t.data[a:z], -1) for a, z in zip(t.begin[lost].tolist(), t.until[lost].tolist())]
        out[t.word_at] = got
        return out
