import importlib.util
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"


def entry():
    spec = importlib.util.spec_from_file_location("__spark_entry__", ROOT / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_all_queries_and_the_pipeline_are_registered():
    names = set(entry().queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", ["op3_line_dedup", "op6_hyperminhash", "op9_warc_zst", "op10_exact_dedup", "op11_prefix_shards", "op13_hirschberg_repair"])
def test_oracles(spark, name):
    e = entry()
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = e.queries()[name](spark, SF)
    want = con.execute(e.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    assert sorted(map(repr, map(tuple, got.select(*cols).collect()))) == sorted(map(repr, want.fetchall()))


def test_pipeline_stages(spark, small):
    sys.path.insert(0, str(ROOT))
    import corpus_pipeline

    docs, seen = small, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == small.columns
        docs = spark.createDataFrame(out.collect(), small.schema)
        seen[name] = docs
    # Language: all of these have letters and stay; the column holds the prediction.
    assert seen["language_id"].count() == small.count()
    # Near duplicates: no two kept documents have equal text.
    kept = seen["near_dedup"].where("trim(text) != ''")
    assert kept.count() == kept.select("text").distinct().count()
    assert seen["near_dedup"].select("doc_id").exceptAll(small.select("doc_id")).count() == 0
    # Mixing: copies of what near dedup kept, twice at most.
    assert seen["mixing"].groupBy("doc_id").count().where("count > 2").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_stages_equal_brute_force(spark, small, messy, messy_rows):
    from tidewell.llm import packing, queries

    from .test_hyperminhash import brute as near
    from .test_line_dedup import brute as lines
    from .test_tokens import check_packed, ids_of

    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (small, messy.select(*cols)):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = queries.stage_line_dedup(spark, docs, SF).collect()
        assert sorted(((r["doc_id"], r["text"]) for r in out), key=repr) == sorted(((i, kept) for i, _, _, kept in lines(rows)), key=repr)
        assert all(r["n_chars"] == len(r["text"]) for r in out)
        stay = {i for i, _, _, kept in near(rows, 5, 80) if kept}
        got = queries.stage_near_dedup(spark, docs, SF).collect()
        assert sorted((r["doc_id"] for r in got), key=repr) == sorted((i for i, _ in rows if i in stay), key=repr)
        told = {r["doc_id"] for r in queries.stage_language_id(spark, docs, SF).collect()}
        assert not told & {i for i, t in rows if i is not None and not any(map(str.isalpha, t or ""))}
    docs = small.limit(60).coalesce(1)
    expected = {r["doc_id"]: [*ids_of(r["text"]), 1] for r in docs.collect()}
    packed = queries.stage_packing(spark, docs, SF).collect()
    assert check_packed(packed, expected, packing.Limits())[0] < 2048


def test_pipeline_runs(spark):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, SF).count() > 0


def test_pipeline_stages_take_odd_rows(spark, messy, nothing):
    import corpus_pipeline

    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (messy.select(*cols), nothing.select(*cols)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == cols
            docs = spark.createDataFrame(out.collect(), docs.schema)
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()


def test_mixing_stage_gives_each_row_its_own_copies(spark, messy, messy_rows):
    from collections import Counter

    from tidewell.llm import mixing, queries

    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    hot = spark.createDataFrame([(77, f"hot row {k}", "en", "a", 9) for k in range(40)], messy.select(*cols).schema)
    docs = messy.select(*cols).unionByName(hot).repartition(3)
    rows = Counter([r[0] for r in messy_rows] + [77] * 40)
    copies = Counter()
    for r in mixing.mix(docs).collect():
        copies[r["doc_id"]] += r["copies"]
    out = queries.stage_mixing(spark, docs, SF).collect()
    got = Counter(r["doc_id"] for r in out)
    assert got == +copies and got[None] and got[8] and got[77]
    assert all(got[i] <= 2 * n for i, n in rows.items())
    assert max(Counter(r["text"] for r in out if r["doc_id"] == 77).values()) <= 2
