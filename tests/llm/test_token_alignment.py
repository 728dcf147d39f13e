import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tidewell.llm import token_alignment as ta
from tokenizers import Tokenizer

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def brute(rows):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) by the libraries and dictionaries."""
    a_lib, b_lib = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    back = {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}

    def tokens_of(text):
        want = (" " + text).encode()
        a = [(i, bytes(back[c] for c in a_lib.id_to_token(i))) for i in a_lib.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if p.startswith("<0x") else p.replace("▁", " ").encode()) for i, p in ((i, b_lib.id_to_piece(i)) for i in b_lib.encode(text))]
        ok = all(b"".join(x for _, x in t) == want for t in (a, b))
        return ([], []) if not ok else tuple(list(zip((i for i, _ in t), np.cumsum([len(x) for _, x in t]).tolist(), strict=True)) for t in (a, b))

    told, counts = [], Counter()
    for doc_id, text in rows:
        a, b = tokens_of(text) if text else ([], [])
        ends = sorted({e for _, e in a} & {e for _, e in b})
        links = [(i, j) for e in ends for i, x in a if x == e for j, y in b if y == e] if len(a) < 400 else None
        if links is None:
            at = [dict((e, i) for i, e in t) for t in (a, b)]
            links = [(at[0][e], at[1][e]) for e in ends]
        counts.update(links)
        groups, lo = [], 0
        ia = ib = 0
        for e in ends:
            ga, gb = [], []
            while ia < len(a) and a[ia][1] <= e:
                ga.append(a[ia][0])
                ia += 1
            while ib < len(b) and b[ib][1] <= e:
                gb.append(b[ib][0])
                ib += 1
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
        told.append((doc_id, len(a), len(b), len(ends), links, ";".join(groups)))
    top = {}
    for (_, j), n in counts.items():
        top[j] = max(top.get(j, 0), n)
    return [(i, na, nb, ng, len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), g) for i, na, nb, ng, links, g in told], counts


def test_minimal_perfect_hash():
    r = np.random.default_rng(1)
    for n in (1, 2, 63, 5_000, 70_000):
        keys = np.unique(r.integers(-(1 << 62), 1 << 62, n))
        h = ta.PerfectHash.built(keys)
        assert sorted(h(keys).tolist()) == list(range(len(keys)))
        if n >= 5_000:
            assert 64 * len(h.words) < 4.5 * n
            other = np.setdiff1d(r.integers(-(1 << 62), 1 << 62, n), keys)
            at, stored = h(other), np.empty_like(keys)
            stored[h(keys)] = keys
            assert ((at < len(keys)) & (stored[at] != other)).all()  # the stored key tells
    assert ta.PerfectHash.built(np.zeros(0, np.int64))(keys[:5]).tolist() == [-1] * 5


def test_pairs_that_were_not_collected_are_refused(tmp_path):
    keys = np.arange(1_000, dtype=np.int64) * 77
    import pandas as pd

    ta._build(str(tmp_path))(pd.DataFrame({"bucket": 3, "key": keys}))
    assert sorted(ta._numbers(str(tmp_path), 3, keys).tolist()) == list(range(1_000))
    with pytest.raises(RuntimeError, match="not collected"):
        ta._numbers(str(tmp_path), 3, np.array([5]))


def odd_texts():
    r = random.Random(4)
    parts = ["a", "the ", "  ", "\n", "\t", "é", "日本", "½", "́", "▁", "🎉", "\x00", "<s>", "</s>", "<|endoftext|>", "<unk>", "<0x41>", " don't", " 12,345", " ", "　", "ﬁ", "ж", "\r\n", "x" * 30]
    return ["".join(r.choice(parts) for _ in range(r.randint(1, 9))) for _ in range(700)]


@pytest.mark.parametrize(("bucket_keys", "slice_keys", "fan"), [(65_536, 16_000_000, 16), (300, 900, 2)])
def test_equals_brute_force(spark, small, messy, messy_rows, bucket_keys, slice_keys, fan):
    rows = [(r["doc_id"], r["text"]) for r in small.collect()] + [(r[0], r[1]) for r in messy_rows] + list(enumerate(odd_texts(), 10_000))
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, a string, bucket int, groups string").repartition(7)
    want, counts = brute(rows)
    made = ta.align_corpus(docs, A, B, bucket_keys, slice_keys, fan, most_chars=50_000)
    got = made.documents()
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert {(r["a"], r["b"]): r["links"] for r in made.pairs().collect()} == counts
    assert made.pairs().where("best").select("b").distinct().count() == len({b for _, b in counts})
    assert sum(w[1] == 0 for w in want) > 30  # texts that B does not spell


def test_nothing(spark, nothing):
    made = ta.align_corpus(nothing, A, B)
    assert made.documents().count() == 0 and made.pairs().count() == 0
    only = spark.createDataFrame([(1, None), (2, ""), (None, "▁")], "doc_id long, text string")
    assert sorted(map(tuple, ta.align_corpus(only, A, B).documents().collect()), key=repr) == sorted([(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, None)], key=repr)


class Asked:
    """A library's processor that counts the characters it is given to encode."""

    def __init__(self, inner):
        self.inner, self.chars = inner, 0

    def __getattr__(self, name):
        return getattr(self.inner, name)

    def encode(self, texts, **options):
        self.chars += len(texts) if isinstance(texts, str) else sum(map(len, texts))
        return self.inner.encode(texts, **options)


def test_words_that_come_again_are_not_encoded_again():
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(300)]
    texts = [" ".join(r.choices(words, k=200)) for _ in range(100)]
    pair = ta.Pair(A, B)
    pair.b = Asked(pair.b)
    told = [x for lo in range(0, 100, 20) for x in pair.encode(texts[lo : lo + 20])]
    assert told == list(ta.Pair(A, B).encode(texts))
    assert pair.b.chars < sum(map(len, texts)) / 20
    assert list(pair.encode(["x" * 1_000 + " a"])) == [pair._whole("x" * 1_000 + " a")]
    assert 250 < len(pair.known) < 310 and max(map(len, pair.known)) <= 4 * 64  # long ones are not kept


def test_units_of_words_give_the_ids_of_whole_texts():
    r = random.Random(6)
    parts = ["a", "the ", " of", "  ", "   ", "\n", "\n\n", "\t", "\r\n", "\r", "'s", "'ll", "'", "don't", " 're", "é", "ñ", "12", " 3.5", "!!", "();", "/**", " {", "=>", "½", "µ", "…", "x" * 12, "ing", "Über", "\n    code", "<0x41>", "<unk>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 14))) for _ in range(3_000)]
    a_lib, b_lib = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    want = [(a_lib.encode(" " + t, add_special_tokens=False).ids, b_lib.encode(t)) for t in texts]
    for most in (250_000, 40):  # the second forgets all the time
        pair = ta.Pair(A, B, most)
        whole, asked = pair._whole, []
        pair._whole = lambda t: asked.append(t) or whole(t)  # noqa: B023
        got = [x for lo in range(0, 3_000, 50) for x in pair.encode([*texts[lo : lo + 50], None, ""])]
        assert [got.pop(k) for k in range(len(got) - 1, -1, -1) if k % 52 > 49] == [(b"", b"")] * 120
        assert [(np.frombuffer(a, "<u4").tolist(), np.frombuffer(b, "<u4").tolist()) for a, b in got] == want
        assert not asked


def test_units_that_do_not_spell_their_text_leave_it_to_the_libraries():
    pair = ta.Pair(A, B)
    k = pair.b.encode("lamp")[-1]
    pair.bytes_b[k] = b"?"
    assert [bool(a) for a, _ in pair.encode(["a lamp", "a tree", "lamp. Tree", "\n lamp", "a"])] == [False, True, False, False, True]
