import math
import zlib
from collections import Counter

import numpy as np
import pytest
from tidewell.llm import kneser_ney as kn


class Slow:
    """The model by its definition, over dictionaries."""

    def __init__(self, texts):
        self.tokens = [kn.words_of(t) for t in texts]
        self.count = Counter(w for t in self.tokens for w in t)
        self.pairs = Counter(p for t in self.tokens for p in zip([None, *t[:-1]], t, strict=True))
        self.before = Counter(b for _, b in self.pairs)
        self.n, self.v = sum(self.count.values()), len(self.count)
        kinds = lambda c: [sum(1 for x in c.values() if x == k) for k in (1, 2, 3, 4)]
        self.d1, self.d2 = kn.Discounts.from_counts(kinds(self.before)), kn.Discounts.from_counts(kinds(self.pairs))
        self.total, self.free = Counter(), Counter()
        for (a, _), c in self.pairs.items():
            self.total[a] += c
            self.free[a] += float(self.d2.of(np.array([c]))[0])
        self.share = sum(float(self.d1.of(np.array([c]))[0]) for c in self.before.values()) / len(self.pairs) if self.pairs else 1.0

    def p(self, a, b):
        m = len(self.pairs)
        low = (max(self.before[b] - float(self.d1.of(np.array([self.before[b]]))[0]), 0) / m if m else 0) + self.share / (self.v + 1)
        if not self.total[a]:
            return low
        c = self.pairs[(a, b)]
        return max(c - float(self.d2.of(np.array([c]))[0]), 0) / self.total[a] + self.free[a] / self.total[a] * low

    def score(self, text):
        t = kn.words_of(text)
        return sum(math.log10(self.p(a, b)) for a, b in zip([None, *t[:-1]], t, strict=True))

    def base(self, text):
        return sum(math.log10((self.count[w] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in kn.words_of(text))


def compare(docs, rows):
    slow = Slow([t for i, t, *_ in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 10])
    got = kn.score_corpus(docs).collect()
    want = sorted(
        (
            (i, zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0, len(kn.words_of(t)), sum(slow.count[w] > 0 for w in kn.words_of(t)), slow.n, slow.base(t), slow.score(t))
            for i, t, *_ in rows
        ),
        key=lambda r: (repr(r[0]), r[2]),
    )
    assert len(got) == len(want)
    for g, x in zip(sorted(map(tuple, got), key=lambda r: (repr(r[0]), r[2])), want, strict=True):
        assert g[:5] == x[:5]
        assert g[5:] == pytest.approx(x[5:], rel=1e-9)
    return slow


def test_equals_the_definition_on_odd_rows(messy, messy_rows):
    compare(messy, messy_rows)


def test_equals_the_definition_on_prose(small):
    slow = compare(small.limit(60), [(r["doc_id"], r["text"]) for r in small.limit(60).collect()])
    for a in (None, b"the", next(iter(slow.count))):
        assert sum(slow.p(a, b) for b in slow.count) + slow.p(a, b"\xff never") == pytest.approx(1)


def test_many_small_ranges_and_frequent_pairs(spark):
    rows = [(k, "the same words " * 200 + f"w{k} w{k % 7}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    m = kn.train(docs, range_tokens=900)
    assert len(m.first_id) > 4
    slow = Slow([t for _, t in rows])
    got = {r["doc_id"]: r["score"] for r in kn.score(docs, m).collect()}
    for i, t in rows:
        assert got[i] == pytest.approx(slow.score(t), rel=1e-9)


def test_the_tree_of_blocks_gives_the_same_model(spark, monkeypatch):
    """Several steps, hot first and second words cut into ranges, more blocks than a step merges."""
    monkeypatch.setattr(kn, "FAN", 3)
    rows = [(k, " ".join(f"hot w{(k * 31 + j * 7) % 301} x{j % 13}" for j in range(60))) for k in range(50)] + [(99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    m = kn.train(docs, range_tokens=150)
    assert kn._tree(len(m.first_pair))[1] > 3 and kn._tree(len(m.first_id))[1] > 3
    heads = [int(p) >> 32 for p in m.first_pair]
    assert max(heads.count(h) for h in set(heads) - {kn.BEGIN}) > 10
    slow = Slow([t for _, t in rows])
    assert (m.tokens, m.distinct, m.texts, m.pairs) == (slow.n, slow.v, 51, len(slow.pairs))
    odd = spark.createDataFrame([(1_000, "never seen hot w1 x1 hot hot")], "doc_id long, text string")
    for r in kn.score(docs.unionByName(odd), m).collect():
        text = dict([*rows, (1_000, "never seen hot w1 x1 hot hot")])[r["doc_id"]]
        assert r["score"] == pytest.approx(slow.score(text), rel=1e-9)
        assert r["base_score"] == pytest.approx(slow.base(text), rel=1e-9)


def test_steps_of_the_tree_are_even():
    assert kn._tree(1) == (1, 1) and kn._tree(256) == (256, 1) and kn._tree(257) == (17, 17)
    assert all(f <= kn.FAN and f * s >= n for n in (1, 2, 70, 300, 65_536, 70_000, 10**7) for f, s in [kn._tree(n)])


@pytest.mark.parametrize("texts", [[], [None], ["", " a  B\x0b\n", "é\x1cÉ ÿ", "x"], ["one", None, "two  "]])
def test_tokens_by_arrays(texts):
    t = kn.Tokens.of(texts)
    words = [t.words[k] for k in t.place]
    assert words == [w for x in texts for w in kn.words_of(x)]
    assert len(set(t.words)) == len(t.words)
    assert t.starts.tolist() == [sum(len(kn.words_of(x)) for x in texts[:k]) for k in range(len(texts))]


def test_held_out_text_is_better_than_single_words(small):
    got = kn.score_corpus(small).where("held_out").collect()
    assert sum(r["score"] > r["base_score"] for r in got) >= 0.95 * len(got)


def test_no_training_rows(spark, nothing, small):
    assert kn.score_corpus(nothing).count() == 0
    m = kn.train(nothing)
    got = kn.score(small.limit(2), m).collect()
    assert all(r["score"] == 0 and r["n_known"] == 0 for r in got)
