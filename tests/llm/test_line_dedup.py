from collections import defaultdict

import numpy as np
from tidewell.llm.line_dedup import CuckooFilter, LineIndex


def brute(rows, min_docs=3, min_chars=20):
    space = " \t\n\x0b\x0c\r"
    lower = {k: k + 32 for k in range(65, 91)}
    key = lambda line: line.strip(space).translate(lower)
    holders = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or len(holders[key(x)]) < min_docs or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=repr)


def test_equals_brute_force_on_odd_rows(messy, messy_rows):
    assert rows_of(LineIndex.build(messy).apply(messy)) == brute(messy_rows)


def test_equals_brute_force_on_prose(small):
    rows = [(r["doc_id"], r["text"]) for r in small.collect()]
    assert rows_of(LineIndex.build(small).apply(small)) == brute(rows)


def test_other_columns_stay(messy):
    out = LineIndex.build(messy).apply(messy)
    assert out.columns == [c for c in messy.columns if c != "kept_text"] + ["kept_text", "n_lines", "n_dropped"]


def test_insertions_in_parts_and_deletions_are_reversible(spark, small):
    one, two = small.where("doc_id % 2 = 0"), small.where("doc_id % 2 = 1")
    first = LineIndex.build(one, shards=3)
    both = first.insert(two)
    whole = LineIndex.build(small, shards=3)
    assert rows_of(both.apply(small)) == rows_of(whole.apply(small))
    back = both.delete(two.select("doc_id"))
    assert rows_of(back.apply(one)) == rows_of(first.apply(one))
    assert {tuple(r) for r in back.references().collect()} == {tuple(r) for r in first.references().collect()}
    keys = lambda x: {r["shard"]: r["keys"] for r in x.filters.collect()}
    assert keys(back) == keys(first)
    nobody = both.delete(spark.createDataFrame([(-5,)], "doc_id long"))
    assert rows_of(nobody.apply(small)) == rows_of(whole.apply(small))


def test_only_what_the_filters_report_is_looked_up(spark, small, monkeypatch):
    one, two = small.where("doc_id % 2 = 0"), small.where("doc_id % 2 = 1")
    first = LineIndex.build(one, shards=3)
    asked = []
    plain = LineIndex.lookup
    monkeypatch.setattr(LineIndex, "lookup", lambda self, digests: asked.append(digests.count()) or plain(self, digests))
    first.insert(two)
    old, new = ({bytes(r[0]) for r in first.lines(x).select("digest").collect()} for x in (one, two))
    assert len(old & new) <= asked[0] <= len(old & new) + max(3, 0.002 * len(new))
    assert asked[0] < 0.7 * len(new)


def test_decisions_rest_on_the_filters(spark):
    """A filter that denies what it holds would hide a line that is in three documents of three insertions."""
    docs = [spark.createDataFrame([(k, "a line that is long enough")], "doc_id long, text string") for k in range(3)]
    index = LineIndex.empty(spark, shards=1)
    blind = LineIndex.empty(spark, shards=1)
    for d in docs:
        index, blind = index.insert(d), blind.insert(d)
        blind.filters = spark.createDataFrame([(0, CuckooFilter.sized(10).dump(), 0)], blind.filters.schema)
    assert [r["n_docs"] for r in index.often().collect()] == [3]
    assert blind.often().collect() == []


def test_a_full_filter_is_built_again(spark, small):
    index = LineIndex.build(small.where("doc_id < 3"), shards=1).insert(small.where("doc_id >= 3"))
    held = CuckooFilter.load(index.filters.first()["filter"])
    keys = np.frombuffer(b"".join(bytes(r[0]) for r in index.references().select("digest").collect()), np.uint64)[::2]
    assert held.contains(keys).all()


def test_no_rows(nothing, small):
    assert LineIndex.build(nothing).apply(nothing).count() == 0
    assert LineIndex.build(nothing).insert(small).references().count() > 0


def test_cuckoo_filter_holds_what_was_inserted():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 2**63, 40_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    f = CuckooFilter.sized(len(keys))
    assert f.insert(keys) and f.contains(keys).all()
    other = rng.integers(0, 2**63, 40_000, dtype=np.uint64) * np.uint64(2)
    assert f.contains(other).mean() < 0.002
    f.remove(keys[:20_000])
    assert f.contains(keys[20_000:]).all()
    assert f.contains(keys[:20_000]).mean() < 0.002
    again = CuckooFilter.load(f.dump())
    assert (again.table == f.table).all()


def test_a_filter_that_is_full_says_so():
    f = CuckooFilter.sized(10)
    assert not f.insert(np.random.default_rng(1).integers(0, 2**63, 1_000, dtype=np.uint64), rounds=50)


def test_an_insertion_as_large_as_what_is_there_builds_no_filter_again(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    index = LineIndex.empty(spark, shards=16)
    sizes = []
    for part in (0, 1):
        index = index.insert(docs.where(f"pmod(xxhash64(doc_id), 2) = {part}"))
        sizes.append({r["shard"]: len(r["filter"]) for r in index.filters.collect()})
    assert sizes[0] == sizes[1] and len(sizes[0]) == 16
