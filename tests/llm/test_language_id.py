import math
import zlib

import numpy as np
import pytest
from tidewell.llm import language_id as li

from .conftest import prose


def model_of(samples):
    grams = {}
    for lang, texts in samples.items():
        counts = {}
        for t in texts:
            b = li.PAD + t.encode()
            for k in range(3, len(b)):
                g = int.from_bytes(b[k - 3 : k + 1], "big")
                counts[g] = counts.get(g, 0) + 1
        grams[lang] = (np.array(list(counts), np.int64), np.array(list(counts.values()), np.int64))
    return li.build(sorted(samples), grams)


def slow_bits(samples, text):
    """Code length by the definition: contexts from the longest, escapes with exclusion."""
    seen = {}
    used = {10}
    for t in samples:
        b = li.PAD + t.encode()
        used |= set(b)
        for k in range(3, len(b)):
            for n in range(4):
                c = seen.setdefault(b[k - n : k], {})
                c[b[k]] = c.get(b[k], 0) + 1

    def p(ctx, sym):
        if ctx is None:
            return 1 / 256
        lower = None if not ctx else ctx[1:]
        here = seen.get(ctx)
        if not here:
            return p(lower, sym)
        t, q = sum(here.values()), len(here)
        if sym in here:
            return here[sym] / (t + q)
        free = 1 - sum(p(lower, s) for s in here)
        return q / (t + q) * p(lower, sym) / free

    b = li.PAD + text.encode()
    return -sum(math.log2(p(b[k - 3 : k], b[k])) for k in range(3, len(b)))


SAMPLES = {"aa": [prose(k, 60, "aeiot") for k in range(4)], "bb": [prose(k, 60, "ouxyz") for k in range(4)]}


def test_code_lengths_are_those_of_the_definition():
    m = model_of(SAMPLES)
    texts = ["tea toe", "you zoo", "it", "", "Zürich 42", prose(9, 30)]
    got = m.code_lengths(*li._packed([t for t in texts if t]))
    for row, t in zip(got, [t for t in texts if t], strict=True):
        for j, lang in enumerate(m.languages):
            assert row[j] == pytest.approx(slow_bits(SAMPLES[lang], t), rel=1e-4)


def test_probabilities_add_up():
    m = model_of(SAMPLES)
    p = np.exp2(-m.bits.astype(np.float64))
    unseen = 256 - (m.bits.shape[1] - 1)
    assert np.allclose(p[:, :-1].sum(1) + unseen * p[:, -1], 1, atol=1e-4)


def test_slices_do_not_change_lengths(monkeypatch):
    m = model_of(SAMPLES)
    texts = [prose(k, 50) for k in range(8)]
    whole = m.code_lengths(*li._packed(texts))
    monkeypatch.setattr(li, "_SLICE", 37)
    assert np.allclose(m.code_lengths(*li._packed(texts)), whole, rtol=1e-5)


def test_held_out_documents_of_the_tables(small):
    got = {r["doc_id"]: r for r in li.predict_corpus(small).collect()}
    truth = {r["doc_id"]: r["lang"] for r in small.collect()}
    assert set(got) == set(truth)
    out = [i for i in got if got[i]["held_out"]]
    assert out == [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i]["lang_pred"] == truth[i] for i in out) >= 0.97 * len(out)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_prediction_does_not_read_the_label(spark, small):
    a = li.train(small)
    plain = li.identify(small.selectExpr("doc_id", "text"), a).select("doc_id", "lang_pred", "score")
    lied = li.identify(small.selectExpr("doc_id", "text", "'xx' AS lang", "'s' AS source"), a).select("doc_id", "lang_pred", "score")
    assert plain.exceptAll(lied).count() == 0


def test_odd_rows(messy, messy_rows, nothing, small):
    got = li.predict_corpus(messy)
    assert got.count() == len(messy_rows)
    und = {r["doc_id"] for r in got.where("lang_pred = 'und'").collect()}
    assert und == {1, 2, 3, 9}
    assert got.where("lang_pred = 'und' AND score != 0").count() == 0
    assert li.predict_corpus(nothing).count() == 0
    unlabelled = small.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert li.predict_corpus(unlabelled).where("lang_pred != 'und'").count() == 0
    kept = li.identify(messy, li.train(small))
    assert kept.columns == [c for c in messy.columns if c != "lang_pred"] + ["lang_pred", "score"]


def test_numbers_and_signs_are_no_letters(spark, small):
    rows = [(1, "½ ² ③"), (2, "_ 7 \u0301"), (3, "42 é"), (4, "語")]
    got = li.identify(spark.createDataFrame(rows, "doc_id long, text string"), li.train(small)).collect()
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {1, 2}


def test_a_model_too_large_to_broadcast_is_refused(monkeypatch):
    import numpy as np
    from tidewell.llm import language_id as li

    monkeypatch.setattr(li, "MOST_BYTES", 1_000)
    with pytest.raises(ValueError, match="fewer sample_docs"):
        li.build(["a"], {"a": (np.arange(50, dtype=np.int64) * 65_537, np.ones(50, np.int64))})
