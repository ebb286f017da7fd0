"""The field against an enumeration of all tag sequences, and what it learns."""

import random
from itertools import product

import numpy as np
import pytest

from edgeloom.llm import toxicity


def enumerated(u, trans):
    """Marginals of tag 1, pair marginals and P(all clean) by all 2^n tag sequences."""
    n = len(u)
    one, pairs, clean, total = np.zeros(n), np.zeros((n, 4)), 0.0, 0.0
    for tags in product((0, 1), repeat=n):
        w = np.exp(sum(x for x, t in zip(u, tags) if t) + sum(trans[a, b] for a, b in zip(tags, tags[1:])))
        total += w
        clean += w * (not any(tags))
        for i, t in enumerate(tags):
            one[i] += w * t
            if i:
                pairs[i, 2 * tags[i - 1] + t] += w
    return one / total, pairs / total, clean / total


@pytest.mark.parametrize("seed", range(4))
def test_marginals_match_enumeration(seed):
    rng = np.random.default_rng(seed)
    trans = rng.normal(size=(2, 2))
    docs = [rng.normal(size=n) * 2 for n in (5, 1, 9, 3)]
    begin = np.cumsum([0, *map(len, docs)])[:-1]
    one, pairs, log_clean = toxicity.training_pass(np.concatenate(docs), begin, trans)
    for k, (u, s) in enumerate(zip(docs, begin)):
        want, want_pairs, clean = enumerated(u, trans)
        assert np.allclose(toxicity.marginals(u, trans), want)
        assert np.allclose(one[s : s + len(u)], want) and np.allclose(pairs[s : s + len(u)], want_pairs)
        # clean against clean-clean transitions: the first tag has no transition
        assert np.isclose(np.exp(log_clean[k]), clean)


def fitted(docs, y):
    return toxicity.Scorer(toxicity.ChainCRF().fit([d.encode().split() for d in docs], np.array(y), np.ones(len(y))))


def test_context_tags_a_word():
    """The same word is toxic after one word and clean after another; the word before is found in clean texts too."""
    r = random.Random(2)
    filler = lambda n: " ".join(r.choice("oak elm ash fir yew bay fig nut".split()) for _ in range(n))
    toxic = [f"{filler(6)} you turkey {filler(5)}" for _ in range(150)]
    clean = [f"{filler(6)} roast turkey {filler(5)}" for _ in range(150)] + [f"{filler(4)} you {filler(7)}" for _ in range(150)]
    s = fitted(toxic + clean, [1] * 150 + [0] * 300)
    mark = lambda text: s.marginals(text.encode().split())
    assert mark("oak elm you turkey fig nut")[3] > 0.8
    assert mark("oak elm roast turkey fig nut")[3] < 0.1 and mark("elm you fig nut")[1] < 0.3


def test_affixes_carry_to_new_words():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    toxic = [" ".join([word() for _ in range(10)] + ["zqux" + word()] + [word() for _ in range(10)]) for _ in range(150)]
    clean = [" ".join(word() for _ in range(20)) for _ in range(300)]
    s = fitted(toxic + clean, [1] * 150 + [0] * 300)
    p = s.marginals([word().encode(), b"zquxnever", word().encode()])
    assert p[1] > 0.8 > 0.2 > max(p[0], p[2])


def test_length_alone_is_not_toxic():
    s = fitted(["good day to all"] * 40 + ["you scum all"] * 40, [0] * 40 + [1] * 40)
    short, long = (s.raw(s.marginals(b"good day to all".split() * n)) for n in (2, 5000))
    assert long - short < 0.5


def test_spans_are_byte_offsets(spark):
    rows = [(i, ("ein schöner tag für alle " if i % 2 else "ein übler Zwerg für alle ") + f"nr{i} nr{i // 2}", "x") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(90)], "doc_id long, toxic int")
    for r in toxicity.toxicity_scores(docs, labels).collect():
        text = rows[r["doc_id"]][1].encode()
        assert r["predicted"] == 1 - r["doc_id"] % 2
        assert all(text[a:b].decode() in rows[r["doc_id"]][1] for a, b in r["spans"])
        assert bool(r["spans"]) <= bool(r["predicted"])
