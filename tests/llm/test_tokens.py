import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tidewell.llm import packing, token_store
from tidewell.llm.tokens import Encoder
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)
ENCODER = Encoder(PATH)


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


def check(*texts):
    stream, ends = ENCODER.encode(list(texts), 1)
    assert stream.tolist() == [i for t in texts for i in [*ids_of(t), 1]]
    assert np.diff(ends, prepend=0).tolist() == [len(ids_of(t)) + 1 for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_pieces_give_the_ids_of_the_whole_text(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.text("ab'sdlrvet _-1½²éß\t\n\r \x0b\x0c\x1c\x85\xa0—…жΩ¡", max_size=40))
def test_pieces_at_word_borders(text):
    check(text)


def test_prose_and_special_words(small):
    for r in small.limit(60).collect():
        check(r["text"])
    check("<|endoftext|> don't  stop\n\n 12 3a_b")
    check(None, "", "  ", "a日 b", None, "x")
    check()
    check("ends in blanks \n ", " begins", "it's 's '' 's don'tx I'll've 'r", "'", "x'", "x's", "x'v")


def test_known_pieces_are_bounded():
    e = Encoder(PATH, most=50)
    for k in range(200):
        assert e.encode([f"word{k} and"], 0)[0].tolist() == [*ids_of(f"word{k} and"), 0]
    assert len(e.known) <= 50 and len(e.known.older) <= 50
    text = " ".join(f"many{k}x" for k in range(200))
    assert e.encode([text], 0)[0].tolist() == [*ids_of(text), 0]
    assert len(e.known) <= 50 and len(e.known.older) <= 50


def test_new_pieces_share_calls(monkeypatch):
    calls = []
    e = Encoder(PATH)
    tokenize = e.known.tokenize
    monkeypatch.setattr(e.known, "tokenize", lambda written: calls.append(written) or tokenize(written))
    text = " ".join(f"déjà{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyzabcd'[k // 100]}—ÿ" for k in range(1_000))
    assert e.encode([text, None, text], 0)[0].tolist() == [*ids_of(text), 0, 0, *ids_of(text), 0]
    assert 1_000 < len(e.known) and len(calls) < 10
    calls.clear()
    assert e.encode([text], 0)[0].tolist() == [*ids_of(text), 0] and not calls


def test_long_pieces_are_not_kept():
    e = Encoder(PATH)
    text = "short " + "long" * 100
    assert e.encode([text, text], 0)[0].tolist() == [*ids_of(text), 0] * 2 and b"short" in e.known
    assert max(map(len, e.known)) <= 64


def test_pieces_are_known_to_later_tasks_until_the_next_stage():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words and", "more words"])], ["doc_id", "text"])
    encode = token_store._encode(PATH, 0, 2)
    first = [b.to_pylist() for b in encode(iter([batch]))]
    kept = token_store._encoder(PATH)
    kept.known.tokenize = None  # a second question would fail
    assert [b.to_pylist() for b in encode(iter([batch]))] == first and b" words" in kept.known
    assert [*token_store._first_of_each(iter([]))] == [] and token_store._encoder.cache_info().currsize == 0


def test_pieces_are_asked_alone_where_an_entry_holds_the_parting_byte(tmp_path):
    from tokenizers import models, pre_tokenizers

    vocab = {c: k for k, c in enumerate(["a", "b", "Ġ", "Ā", "ÿ", "aÿ"])}
    made = Tokenizer(models.BPE(vocab, [("a", "ÿ")]))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    made.save(path := str(tmp_path / "made.json"))
    e = Encoder(path)
    assert (e.known.asked, ENCODER.known.asked > 1) == (1, True)
    assert e.encode(["a b a", "ba"], 9)[0].tolist() == [0, 2, 1, 2, 0, 9, 1, 0, 9]


# --- packing ----------------------------------------------------------------------


def check_packed(rows, expected, limits):
    got = {}
    seqs = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append(r)
    for i, ids in expected.items():
        at = 0
        for r in sorted(got[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            data = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(data) and (r["ids"] is None or bytes(r["ids"]) == data)
            at += r["length"]
        assert at == len(ids)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= limits.tokens and len(s) <= limits.segments and sum(r["loss_tokens"] for r in s) <= limits.loss
    return sum(limits.tokens - sum(r["length"] for r in s) for s in seqs.values()), len(seqs)


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(128, 3, 100), packing.Limits(64, 64, 10)])
def test_each_id_lies_in_one_piece_under_all_limits(small, limits):
    docs = small.limit(80).coalesce(1)
    expected = {r["doc_id"]: [*ids_of(r["text"]), 1] for r in docs.collect()}
    rows = packing.pack_documents(docs, PATH, 1, limits, batch_docs=16).collect()
    padding, n = check_packed(rows, expected, limits)
    if limits.loss == limits.tokens:
        assert padding < limits.tokens  # one task leaves one sequence short


def test_limits_below_one_are_refused():
    for bad in ((0, 1, 1), (1, 0, 1), (1, 1, 0)):
        with pytest.raises(ValueError, match="1 at least"):
            packing.Limits(*bad)


def test_packing_odd_rows(messy, messy_rows, nothing):
    rows = packing.pack_documents(messy, PATH).collect()
    once = {i: [*ids_of(t), 1] for i, t, *_ in messy_rows if i not in (8, None)}
    assert {r["doc_id"] for r in rows} == {i for i, *_ in messy_rows}
    for i, ids in once.items():
        assert sum(r["length"] for r in rows if r["doc_id"] == i) == len(ids)
    assert packing.pack_documents(nothing, PATH).count() == 0


def test_examples_with_masks(spark):
    rows = [(i, list(range(i % 40)), [k % 2 == 0 for k in range(i % 40 - i % 3)] if i % 5 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "example_id long, ids array<int>, loss_mask array<boolean>").coalesce(1)
    got = packing.pack_examples(df, packing.Limits(50, 4, 12)).collect()
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append(r)
    assert all(sum(r["length"] for r in s) <= 50 and len(s) <= 4 and sum(r["loss_tokens"] for r in s) <= 12 for s in seqs.values())
    want = {i: (len(x), sum(map(bool, (m or [])[: len(x)]))) for i, x, m in rows if x}
    have = {}
    for r in got:
        n, loss = have.get(r["example_id"], (0, 0))
        have[r["example_id"]] = (n + r["length"], loss + r["loss_tokens"])
    assert have == want


# --- the store --------------------------------------------------------------------


def test_crc_of_parts():
    r = np.random.default_rng(1)
    for n in (0, 1, 7, 4_000, 70_001):
        a, b = r.bytes(33), r.bytes(n)
        joined = int(token_store.crc_shift(np.array([zlib.crc32(a)], np.uint32), np.array([n]))[0]) ^ zlib.crc32(b)
        assert joined == zlib.crc32(a + b)


def test_cuts_follow_the_content():
    r = np.random.default_rng(3)
    ids = r.integers(0, 50_000, 60_000).astype("<u4")
    ends = token_store.cuts(ids)
    n = np.diff([0, *ends])
    assert ends[-1] == len(ids) and n.max() <= 2_048 and n[:-1].min() >= 128 and 300 < n.mean() < 900
    moved = token_store.cuts(np.concatenate([r.integers(0, 50_000, 777).astype("<u4"), ids]))
    assert len({m - 777 for m in moved} & set(ends)) > 0.9 * len(ends)
    assert token_store.cuts(ids[:5]) == [5]
    assert token_store.cuts(ids[:0]) == []
    assert token_store.cuts(np.zeros(10_000, "<u4"))[-1] == 10_000


def test_the_first_of_each_chunk_over_batches():
    names = ["doc_id", "n_tokens", "recipe", "digest", "payload", "chunk"]
    # A document's root that is also a chunk's digest hides no chunk, and documents with one root all stay.
    rows = [(b"a", False), (b"a", False), (b"b", False), (b"b", True), (b"b", True), (b"b", True), (b"c", True), (b"d", True), (b"d", True)]
    for size in range(1, 10):
        cut = [rows[k : k + size] for k in range(0, len(rows), size)] + [[]]
        batches = [pa.RecordBatch.from_arrays([pa.nulls(len(p), pa.int64())] * 2 + [pa.nulls(len(p), pa.binary()), pa.array([d for d, _ in p], pa.binary()), pa.nulls(len(p), pa.binary()), pa.array([c for _, c in p], pa.bool_())], names) for p in cut]
        got = [(d, c) for b in token_store._first_of_each(iter(batches)) for d, c in zip(b.column(3).to_pylist(), b.column(5).to_pylist())]
        assert got == [*rows[:3], (b"b", True), (b"c", True), (b"d", True)]


@pytest.fixture
def store(spark, tmp_path):
    return f"file://{tmp_path}/store"


def test_exact_round_trip(spark, small, store):
    docs = small.unionByName(small.where("doc_id % 7 = 0").withColumn("doc_id", small["doc_id"] + 10_000)).repartition(4)
    token_store.write_store(docs, store, PATH, 0)
    expected, start = [], 0
    for r in docs.orderBy("doc_id").collect():
        ids = np.array([*ids_of(r["text"]), 0], "<u4")
        expected.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        start += len(ids)
    got = token_store.verify(spark, store).orderBy("doc_id").select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert [tuple(r) for r in got] == [e[:4] for e in expected]
    back = {r["doc_id"]: bytes(r["ids"]) for r in token_store.read_documents(spark, store).collect()}
    assert back == {e[0]: e[4] for e in expected}
    one = token_store.read_documents(spark, store, ids=spark.createDataFrame([(7,)], "doc_id long")).collect()
    assert [(r["doc_id"], bytes(r["ids"])) for r in one] == [(7, back[7])]
    chunks = token_store.chunks(spark, store)
    assert chunks.count() == chunks.select("digest").distinct().count()
    kept = token_store.recipes(spark, store).orderBy("doc_id")
    assert [r["start"] for r in kept.collect()] == [e[1] for e in expected]
    manifest = spark.read.parquet(f"{store}/manifest")
    assert manifest.groupBy().sum("tokens").first()[0] == start
    for r in manifest.collect():
        roots = [bytes(x["root"]) for x in kept.where(f"file = {r['file']}").collect()]
        assert bytes(r["root"]) == token_store.merkle(roots)


@pytest.fixture
def damaged(spark, small, store):
    """A store of ten documents, and a copy of it with one of its three tables changed."""
    token_store.write_store(small.limit(10), store, PATH, 0)

    def copy(name, change):
        for k, table in enumerate(("staged", "recipes", "manifest")):
            df = spark.read.parquet(f"{store}/{table}")
            df = change(df) if table == name else df
            writer = df.write.partitionBy("chunk") if table == "staged" else df.write
            writer.parquet(f"{store}-{name}/{table}")
        return f"{store}-{name}"

    return copy


def test_a_changed_chunk_is_found(spark, damaged):
    change = lambda df: df.withColumn("payload", F.when(F.col("chunk").cast("boolean"), F.concat("payload", F.lit(bytearray(b"\0\0")))))
    with pytest.raises(Exception, match="does not hold what its digest says"):
        token_store.verify(spark, damaged("staged", change)).collect()


@pytest.mark.parametrize("change", [lambda df: df.where("start != 0"), lambda df: df.limit(0), lambda df: df.withColumn("n_tokens", F.col("n_tokens") + 1)])
def test_lost_and_changed_recipes_are_found(spark, damaged, change):
    with pytest.raises(ValueError, match="manifest states"):
        token_store.verify(spark, damaged("recipes", change))


def test_a_lost_manifest_is_found(spark, damaged):
    with pytest.raises(ValueError, match="manifest states"):
        token_store.verify(spark, damaged("manifest", lambda df: df.limit(0)))


def test_files_of_the_manifest(spark, store, monkeypatch):
    monkeypatch.setattr(token_store, "FILE_DOCS", 7)
    docs = spark.createDataFrame([(None if i % 3 == 0 else i, f"text {i % 5}") for i in range(40)], "doc_id long, text string")
    token_store.write_store(docs, store, PATH, 0, range_docs=9)
    rows = sorted(token_store.manifest(spark, store).collect(), key=lambda r: r["file"])
    assert [r["documents"] for r in rows] == [7, 7, 7, 7, 7, 5]
    assert [r["base"] for r in rows] == [sum(x["tokens"] for x in rows[:k]) for k in range(6)]
    assert token_store.verify(spark, store).count() == 40


def test_ids_wider_than_the_store_are_refused(spark, small, store):
    with pytest.raises(Exception, match="does not fit into 1 bytes"):
        token_store.write_store(small.limit(3), store, PATH, 0, width=1)


def test_chunks_of_a_stream_are_those_of_its_documents():
    r = np.random.default_rng(5)
    docs = [r.integers(0, 50_000, n).astype("<u4") for n in (1, 5_000, 128, 129, 3, 9_000, 2_048)]
    ends = np.cumsum([len(d) for d in docs])
    alone = [int(e - len(d) + c) for d, e in zip(docs, ends) for c in token_store.cuts(d)]
    assert token_store.cuts(np.concatenate(docs), ends) == alone
    slow = [sum((int(x) * 0x9E3779B1 + 1) * pow(0x5851F42D, k, 1 << 32) for k, x in enumerate(docs[1][i - 15 : i + 1][::-1])) % (1 << 32) for i in range(15, 60)]
    assert token_store.rolling(docs[1])[15:60].tolist() == slow


def test_store_of_odd_rows(spark, messy, messy_rows, nothing, store):
    token_store.write_store(messy, store, PATH, 0)
    got = token_store.verify(spark, store).collect()
    assert len(got) == len(messy_rows)
    assert sorted(r["n_tokens"] for r in got) == sorted(len(ids_of(t)) + 1 for _, t, *_ in messy_rows)
    assert sorted(r["start"] for r in got)[0] == 0
    token_store.write_store(nothing, store + "-empty", PATH, 0)
    assert token_store.verify(spark, store + "-empty").count() == 0
    assert token_store.read_documents(spark, store + "-empty").count() == 0


# --- markers in the text -----------------------------------------------------------

MARKED = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  don't", "日本 <|endoftext|> ½", "plain <|endoftext", "no marker here"]


def test_markers_have_the_ids_of_an_untouched_tokenizer():
    assert ENCODER.encode(["a <|endoftext|> b"], 1)[0].tolist() == [64, 220, 50256, 275, 1]
    check(*MARKED)


def test_store_and_packing_keep_markers(spark, store):
    docs = spark.createDataFrame(list(enumerate(MARKED)), "doc_id long, text string").coalesce(1)
    token_store.write_store(docs, store, PATH, end_id=0)
    stored = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_store.verify(spark, store).collect()}
    packed = {r["doc_id"]: bytes(r["ids"]) for r in packing.pack_documents(docs, PATH, 1).collect()}
    for i, text in enumerate(MARKED):
        ids = ids_of(text)
        assert stored[i] == (len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes()))
        assert packed[i] == np.array([*ids, 1], "<u4").tobytes()
