"""Toxicity: a linear-chain conditional random field over words, learned from documents' labels."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.text import field_type, fold, map_arrow, text_bytes

#: At most about so many labelled training rows of either label, of texts of at most so many bytes, are used to fit the field.
FIT_ROWS, FIT_BYTES = 1200, 8_000
#: Features are hashed to so many weights; a feature has a weight if so many training documents hold it.
WEIGHTS, LEAST_DOCS = 1 << 20, 4
EPOCHS, RIDGE = 40, 0.02
#: A document's score combines so many of its highest marginals.
HIGHEST = 8
#: Distinct words whose features a task holds at once.
HELD_WORDS = 400_000
TABLE = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))
TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def tokens(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of non-ASCII bytes, lower-cased."""
    return text.lower().translate(TABLE).split()


#: Hash states that begin each kind of feature.
WORD, LENGTH, DIGIT, PREFIX, SUFFIX, PIECE, AFTER, BEFORE = (zlib.crc32(k) for k in (b"w", b"l", b"d", b"p", b"s", b"g", b"a", b"b"))


def word_features(word: bytes) -> list[int]:
    """Places of a word's own features: the word, its prefixes and suffixes, the pieces of four bytes inside it, its shape."""
    n, h, last = len(word), zlib.crc32, WEIGHTS - 1
    out = [h(word, WORD), h(b"%d" % min(n, 12), LENGTH), h(b"%d" % any(48 <= c < 58 for c in word), DIGIT)]
    out += [h(word[:k], PREFIX) for k in range(3, min(n, 11))]
    out += [h(word[-k:], SUFFIX) for k in range(2, min(n, 5))]
    out += [h(word[i : i + 4], PIECE) for i in range(1, n - 4)]
    return [x & last for x in out]


def neighbour_features(word: bytes) -> tuple[int, int]:
    """Places of the features "follows this word" and "stands before this word"."""
    return zlib.crc32(word, AFTER) & WEIGHTS - 1, zlib.crc32(word, BEFORE) & WEIGHTS - 1


def _chained(e: np.ndarray, step, x: np.ndarray) -> np.ndarray:
    """Solves ``x[i] = step(e[i], x[i - 1])`` for i > 0, where ``x[0]`` is given, for all places at once.  A round settles one more
    place at least, and nearly all in a few rounds, as a place far back hardly counts; it ends when nothing changes."""
    for _ in range(len(e)):
        new = step(e[1:], x[:-1])
        same = np.abs(new - x[1:]) <= 1e-13 * new
        x[1:] = new
        if same.all():
            break
    return x


def marginals(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(tag 1) of every word by forward and backward passes.  ``scores`` are those of tag 1 over tag 0 of each word,
    ``trans[i, j]`` that of tag j after tag i.  Forward: the odds of tag 1 given the words so far; backward: the ratio of what
    follows under tag 1 to what follows under tag 0."""
    if not len(scores):
        return np.zeros(0)
    e, ((a, b), (c, d)) = np.exp(np.clip(scores, -40, 40)), np.exp(trans)
    forward = _chained(e, lambda k, x: k * (b + x * d) / (a + x * c), e.copy())
    back = np.concatenate([e[:1], e[:0:-1]])
    follows = _chained(back, lambda k, y: (c + d * (k * y)) / (a + b * (k * y)), np.ones(len(e)))[::-1]
    o = forward * follows
    return o / (1 + o)


class Vocabulary(dict):
    """Words by number; the features of the words met since the last ``clear_features`` are laid end to end."""

    def __init__(self):
        super().__init__()
        self.clear_features()

    def clear_features(self) -> None:
        self.own: list[int] = []
        self.ends = [0]
        self.sides: list[tuple[int, int]] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.own += word_features(word)
        self.ends.append(len(self.own))
        self.sides.append(neighbour_features(word))
        return n


def training_pass(u: np.ndarray, begin: np.ndarray, trans: np.ndarray):
    """``(marginals, pair marginals, log P(all clean))`` of documents laid end to end; a place's pair marginals are those of it
    and the one before.  All documents are stepped at once, the longest first."""
    lengths = np.diff(np.append(begin, len(u)))
    order = np.argsort(-lengths, kind="stable")
    at0, size = begin[order], lengths[order]
    e, t = np.exp(np.clip(u, -40, 40)), np.exp(trans)
    f, log_clean = np.empty(len(u)), np.zeros(len(begin))
    f[at0] = e[at0]
    live = [int(np.searchsorted(-size, -s)) for s in range(int(size[0]))]  # documents longer than s
    for s in range(1, int(size[0])):
        at = at0[: live[s]] + s
        x = f[at - 1]
        f[at] = e[at] * (t[0, 1] + x * t[1, 1]) / (t[0, 0] + x * t[1, 0])
    y = np.ones(len(u))
    for s in range(int(size[0]) - 1, 0, -1):
        at = at0[: live[s]] + s
        z = e[at] * y[at]
        y[at - 1] = (t[1, 0] + t[1, 1] * z) / (t[0, 0] + t[0, 1] * z)
    # P(all clean) is the product of P(clean | clean before): 1 / (1 + b / a * emission * what follows)
    first = np.zeros(len(u), bool)
    first[begin] = True
    z = e * y
    step = np.log1p(np.where(first, z, z * t[0, 1] / t[0, 0]))
    log_clean = -np.add.reduceat(step, begin)
    o = f * y
    one = o / (1 + o)
    pairs = np.zeros((len(u), 4))
    i = np.flatnonzero(~first)
    x = f[i - 1]
    w = np.stack([np.full(len(i), t[0, 0]), t[0, 1] * z[i], x * t[1, 0], x * t[1, 1] * z[i]], axis=1)
    pairs[i] = w / w.sum(axis=1, keepdims=True)
    return one, pairs, log_clean


class ChainCRF:
    """Two tags, 0 clean and 1 toxic.  The score of tag 1 at a word is the sum of the weights of the word's own features, of
    the word before and of the word after, and a bias; ``trans[i, j]`` is the score of tag j after tag i."""

    def __init__(self):
        self.weights, self.bias, self.trans = np.zeros(WEIGHTS, np.float32), -7.0, np.zeros((2, 2))
        self.slope, self.shift = 1.0, 0.0

    def tables(self, words: Vocabulary) -> np.ndarray:
        """Scores by word, in rows: of the word itself, of the word before its place, of the word after it."""
        own = np.add.reduceat(self.weights[np.array(words.own)].astype(float), words.ends[:-1])
        sides = np.array(words.sides, np.int64)
        return np.stack([own + self.bias, self.weights[sides[:, 0]], self.weights[sides[:, 1]]])

    def fit(self, docs: list[list[bytes]], toxic: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, ridge: float = RIDGE) -> ChainCRF:
        """Maximises the conditional likelihood of what the labels say of the tags: in a clean document all words are clean; in a
        toxic one they are not all clean, which of them is left open.  The gradient is the difference of the expected features
        under that and under no condition; Adam steps with a ridge towards 0."""
        keep = [i for i, d in enumerate(docs) if d]
        if not keep:
            return self
        words = Vocabulary()
        ids = [np.fromiter(map(words.__getitem__, docs[i]), np.int64, len(docs[i])) for i in keep]
        y, weight = np.asarray(toxic)[keep].astype(bool), np.asarray(weight, float)[keep]
        begin = np.cumsum([0, *map(len, ids)])[:-1]
        doc, flat = np.repeat(np.arange(len(ids)), list(map(len, ids))), np.concatenate(ids)
        inner = np.ones(len(flat), bool)
        inner[begin] = False
        i = np.flatnonzero(inner)
        own_of, sides = np.repeat(np.arange(len(words.sides)), np.diff(words.ends)), np.array(words.sides)
        own = np.array(words.own)
        # documents that hold a feature; copies of a document are one
        shape = np.array([zlib.crc32(x.tobytes()) for x in ids], np.int64)
        _, fresh = np.unique(shape, return_index=True)
        new = np.zeros(len(ids), bool)
        new[fresh] = True
        held = np.zeros(WEIGHTS, np.int32)
        for x in (ids[k] for k in np.flatnonzero(new)):
            u = np.unique(x)
            held[np.unique(np.concatenate([own[words.ends[w] : words.ends[w + 1]] for w in u.tolist()] + [sides[u].ravel()]))] += 1
        usable = np.flatnonzero(held >= LEAST_DOCS)
        # the features with a weight by number; all others share the last place, which stays 0
        n = len(usable)
        number = np.full(WEIGHTS, n)
        number[usable] = np.arange(n)
        own, sides = number[own], number[sides]
        own_of, own = own_of[own < n], own[own < n]
        m1, m2, theta = np.zeros(n + 4), np.zeros(n + 4), np.zeros(n + 4)
        theta[n + 1] = self.bias
        total, many = weight.sum(), len(words)
        for step in range(1, epochs + 1):
            self.trans = np.array([[0.0, 0.0], theta[n + 2 :]])
            u = (np.bincount(own_of, weights=theta[own], minlength=many) + theta[n + 1])[flat]
            u[i] += theta[sides[:, 0]][flat[i - 1]]
            u[i - 1] += theta[sides[:, 1]][flat[i]]
            one, pairs, log_clean = training_pass(u, begin, self.trans)
            clean = np.exp(np.minimum(log_clean, -1e-9))
            more = np.where(y, clean / (1 - clean), -1.0) * weight  # times the unconditioned expectation
            r = one * more[doc]
            by_word = [np.bincount(at, weights=r[to], minlength=many) for at, to in ((flat, slice(None)), (flat[i - 1], i), (flat[i], i - 1))]
            g = np.zeros(n + 4)
            g[: n + 1] = np.bincount(own, weights=by_word[0][own_of], minlength=n + 1)
            g[: n + 1] += np.bincount(sides.T.ravel(), weights=np.concatenate(by_word[1:]), minlength=n + 1)
            g[n] = 0
            g[n + 1] = r.sum()
            g[n + 2 :] = (pairs[:, 2:] * more[doc][:, None]).sum(axis=0)
            g[:n] -= ridge * theta[:n]
            g[n + 2 :] -= theta[n + 2 :]
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            theta += 0.15 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-3 * total / 1000)
            theta[n + 1] = min(theta[n + 1], -3.0)
        self.weights[usable] = theta[:n]
        self.bias, self.trans = float(theta[n + 1]), np.array([[0.0, 0.0], theta[n + 2 :]])
        return self


class Scorer:
    """Scores texts with a field; the features of the words met are held, up to a fixed number of words."""

    def __init__(self, field: ChainCRF):
        self.field, self.words = field, Vocabulary()
        self.tables, self.known = np.zeros((3, 1 << 16)), 0

    def marginals(self, words: list[bytes]) -> np.ndarray:
        if len(self.words) > HELD_WORDS:
            self.__init__(self.field)
        ids = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        if self.known < len(self.words):
            self._learn()
        own, before, after = self.tables
        u = own[ids]
        u[1:] += before[ids[:-1]]
        u[:-1] += after[ids[1:]]
        return marginals(u, self.field.trans)

    def _learn(self) -> None:
        """Tables of the words met since; room grows by doubling."""
        n = len(self.words)
        while n > self.tables.shape[1]:
            self.tables = np.concatenate([self.tables, np.zeros_like(self.tables)], axis=1)
        self.tables[:, self.known : n] = self.field.tables(self.words)
        self.words.clear_features()
        self.known = n

    def raw(self, p: np.ndarray) -> float:
        """Log odds that one of the words with the highest marginals is toxic."""
        if not len(p):
            return -20.0
        top = np.partition(p, len(p) - HIGHEST)[-HIGHEST:] if len(p) > HIGHEST else p
        clean = float(np.log1p(-np.minimum(top, 1 - 1e-9)).sum())
        return math.log(max(-math.expm1(clean), 1e-9)) - clean

    def score(self, p: np.ndarray) -> float:
        x = self.field.slope * self.raw(p) + self.field.shift
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) if len(p) else 0.0


def calibrate(field: ChainCRF, raw: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> None:
    """Logistic fit of the label on a document's log odds, by Newton steps; rows weigh as they do in the whole table."""
    x = np.stack([raw, np.ones(len(raw))], axis=1)
    theta, y = np.array([1.0, 0.0]), np.asarray(toxic, float)
    if not len(raw) or y.min() == y.max():
        return
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        g = x.T @ (weight * (y - p)) - 0.01 * (theta - [1.0, 0.0])
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2)
        theta = theta + np.clip(np.linalg.solve(h, g), -1, 1)
    field.slope, field.shift = max(float(theta[0]), 0.05), float(theta[1])


def fit_field(texts: list[bytes], toxic: np.ndarray, weight: np.ndarray) -> ChainCRF:
    """A field fitted on all rows; its scores are calibrated on a third of the rows with a field fitted on the others.  Copies
    of a text fall into the same part."""
    docs = [tokens(t) for t in texts]
    aside = np.array([zlib.crc32(t) % 3 == 0 for t in texts], bool)
    s = Scorer(ChainCRF().fit([d for d, a in zip(docs, aside) if not a], toxic[~aside], weight[~aside]))
    raw = np.array([s.raw(s.marginals(d)) for d, a in zip(docs, aside) if a])
    field = ChainCRF().fit(docs, toxic, weight)
    calibrate(field, raw, toxic[aside], weight[aside])
    return field


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES, held_fold: int = 1, folds: int = 3) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts, labels and weights of a bounded sample: rows outside the held-out fold with a text of at most ``fit_bytes``
    bytes, chosen by a hash of their id, ``fit_rows`` of either label as expected.  A row weighs as many rows as it stands for."""
    lab = labels.select(F.col(id_col).alias("_lid"), F.col(label_col).cast("int").alias("_y")).dropna().filter(fold(F.col("_lid"), folds) != held_fold)
    sizes = {r["_y"]: r["n"] for r in lab.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for y, n in sizes.items():
        share = F.when(F.col("_y") == y, F.lit(min(1.0, fit_rows / n))).otherwise(share)
    chosen = lab.groupBy("_lid").agg(F.max("_y").alias("_y")).filter(F.pmod(F.xxhash64("_lid"), F.lit(1_000_000)) < share * 1_000_000)
    # 2 * fit_rows rows of fit_bytes bytes at most as expected, whatever the input's size
    short = docs.select(F.col(id_col).alias("_did"), text_bytes(text_col).alias("t")).filter(F.octet_length("t") <= fit_bytes)
    rows = short.join(F.broadcast(chosen), F.col("_did") == F.col("_lid")).select("_did", "_y", "t").collect()
    rows.sort(key=lambda r: (str(r["_did"]), bytes(r["t"])))
    y = np.array([int(r["_y"] == 1) for r in rows], np.int64)
    return [bytes(r["t"]) for r in rows], y, np.array([max(1.0, sizes[r["_y"]] / fit_rows) for r in rows])


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, **options) -> DataFrame:
    """``(id_col, held_out, score, predicted, spans)`` for each row.  The score is the calibrated probability that one of the
    eight words with the highest marginals of the toxic tag is toxic, so it does not rise with the mere length of a text;
    spans are the byte offsets (end exclusive) of runs of words whose marginal reaches the threshold, in the UTF-8 text.

    No words are labelled, only documents: the field is fitted on a bounded sample of them (``labelled_sample``) with the tags
    of toxic documents left open but for one.  Only texts are scored on; labels are read for fitting alone.  Null and empty
    texts have no word and score 0.  Repeated rows are scored each; null ids are in no held-out fold but 0's; without labels
    or toxic labels every score is low; an empty table gives no rows; other columns are not read.
    """
    texts, y, weight = labelled_sample(docs, labels, id_col, text_col, **options)
    held = docs.sparkSession.sparkContext.broadcast(fit_field(texts, y, weight))

    def score(scorer: Scorer, text: bytes) -> tuple[float, list]:
        p = scorer.marginals(tokens(text))
        s, spans, last = scorer.score(p), [], -2
        if s >= threshold:
            for i, m in enumerate(TOKEN.finditer(text)):
                if p[i] >= threshold:
                    if last == i - 1:
                        spans[-1][1] = m.end()
                    else:
                        spans.append([m.start(), m.end()])
                    last = i
        return s, spans

    def run(batches):
        scorer = Scorer(held.value)
        for b in batches:
            yield [(i, *score(scorer, t)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]

    cols = docs.select(F.col(id_col), text_bytes(text_col).alias("_t"))
    out = map_arrow(cols, run, f"`{id_col}` {field_type(docs, id_col)}, score double, spans array<array<long>>")
    return out.select(id_col, (fold(F.col(id_col), 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
