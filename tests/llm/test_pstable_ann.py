import re

import numpy as np
import pytest
from tidewell.llm import pstable_ann as ann


def brute(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    out = {}
    for q in queries:
        d = ann.distances(x[ids == q][0], x)
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall_of(got, want):
    return float(np.mean([len({j for j, _ in got.get(i, [])} & {j for j, _ in w}) / 10 for i, w in want.items()]))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_hashing_alone_on_the_tables(spark, sf, monkeypatch):
    """All from the buckets: nothing is scanned."""
    monkeypatch.setattr(ann, "scan", None)
    v = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in v.collect()]
    q = [i for i, _ in rows if i % 20 == 0]
    got, want = found(ann.nearest(v, v.where("vec_id % 20 = 0"))), brute(rows, q, 10)
    assert {i: len(x) for i, x in got.items()} == dict.fromkeys(q, 10)
    exact = {i: dict(brute(rows, [i], len(rows))[i]) for i in q[:5]}
    assert all(s == pytest.approx(exact[i][j], abs=1e-12) for i in q[:5] for j, s in got[i])
    assert recall_of(got, want) >= 0.9


def test_the_fit_follows_the_distances():
    sets = ann.perturbations(16, 400)
    chance = ann.chances(32, 10, 16, sets)
    assert chance[0] == 1 and (np.diff(chance) <= 0).all() and chance[-1] < 0.05
    near = np.random.default_rng(2).uniform(0.5, 1.0, (50, 10))
    slots = [ann.fitted_slot(near * f, chance, 0.95) for f in (1, 3)]
    assert slots[1] / slots[0] == pytest.approx(3, rel=1e-6)
    assert np.interp(near / slots[0], ann._TRIED, chance).mean() == pytest.approx(0.95, abs=0.01)
    # A sample's neighbours are further than those of all rows; the local dimension tells how much.
    x = np.random.default_rng(3).uniform(size=(20_000, 3))
    full, part = ann.near_distances(x, 10, 200, len(x)), ann.near_distances(x[:2_000], 10, 200, len(x))
    assert part.mean() == pytest.approx(full.mean(), rel=0.15)


def test_hot_vectors_and_salts(spark):
    r = np.random.default_rng(1)
    rows = [(k, [1.0, 2.0, 3.0, 4.0] if k % 3 == 0 else r.normal(size=4).round(2).tolist()) for k in range(900)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    rows = [(i, np.array(x, np.float32).astype(float).tolist()) for i, x in rows]
    for shard_rows in (20_000, 40):
        got = found(ann.nearest(v, v.where("vec_id % 100 = 0"), shard_rows=shard_rows, fit_recall=1.0, recall=1.0))
        assert got == brute(rows, [i for i, _ in rows if i % 100 == 0], 10)


def test_probes_of_hot_buckets_do_not_travel_through_the_driver(spark):
    """Few queries make many probes; what a join with the salts broadcasts is read from the hot buckets."""
    r = np.random.default_rng(4)
    rows = [(k, [1.0, 2.0, 3.0, 4.0] if k % 3 == 0 else r.normal(size=4).tolist()) for k in range(600)]
    kept = ann.materialize(spark.createDataFrame(rows, "vec_id long, v array<double>"), "test-base")
    asked = ann.materialize(kept.where("vec_id % 20 = 0").withColumnsRenamed({"vec_id": "query_id", "v": "q"}), "test-asked")
    out = ann._level(kept, asked, 10, ann.Hashes.drawn(4, 2.0, 2, 4), ann.perturbations(4, 20), 3, 40)
    plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(re.match(r"[\s:+|-]*", x)[0]) for x in plan]
    sent = []
    for i, x in enumerate(plan):
        if "BroadcastExchange" in x:
            end = next((j for j in range(i + 1, len(plan)) if depth[j] <= depth[i]), len(plan))
            sent.append("\n".join(plan[i:end]))
    assert [x for x in sent if "MapInArrow" in x] == []
    assert len(sent) == 2 and all("salts" in x for x in sent)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (None, [1.0, 1.0]), (7, [1.0, 0.5]), (7, [1.0, 0.5]), (100, [0.0, 0.0]), (200, [1.0, 0.0])]
    v = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, rank int, score string")
    got = found(ann.nearest(v, v.where("vec_id % 100 = 0")))
    assert got == {0: [(200, 0.0), (7, 0.5)], 200: [(0, 0.0), (7, 0.5)]}
    assert ann.nearest(v.limit(0), v.limit(0)).count() == 0


def test_probes_are_different_buckets_best_first():
    h = ann.Hashes.drawn(8, 1.0, 1, 6)
    sets = ann.perturbations(6, 80)
    x = np.random.default_rng(3).normal(size=(20, 8))
    keys = ann.probe_keys(x, h, 0, sets)
    assert len(sets) == 80 and len(sets[0]) == 0
    assert all(len(set(k.tolist())) == 80 for k in keys)
    assert (keys[:, 0] == ann.key_of(np.floor(h.slots(x, 0)), 0)).all()


def mixed(seed, tight, loose):
    """Unit vectors, two thirds in tight clusters and a third in loose ones or spread (0); queries from the thin third."""
    r = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    dense = unit(np.repeat(unit(r.normal(size=(40, 64))), 50, axis=0) + tight * r.normal(size=(2_000, 64)))
    middle = np.repeat(unit(r.normal(size=(20, 64))), 50, axis=0)
    thin = unit(middle + loose * r.normal(size=(1_000, 64)) if loose else r.normal(size=(1_000, 64)))
    return [(i, x.tolist()) for i, x in enumerate(np.concatenate([dense, thin]))], list(range(2_000, 3_000, 50))


@pytest.mark.parametrize(("tight", "loose"), [(0.05, 0), (0.02, 0.06)])
def test_mixed_density_by_hashing_alone(spark, tight, loose, monkeypatch):
    monkeypatch.setattr(ann, "scan", None)
    rows, thin = mixed(7, tight, loose)
    asked = thin + list(range(0, 2_000, 100))
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got, want = found(ann.nearest(v, v.where(v.vec_id.isin(asked)))), brute(rows, asked, 10)
    assert {q: len(x) for q, x in got.items()} == dict.fromkeys(asked, 10)
    assert recall_of(got, {q: want[q] for q in thin}) >= 0.9 and recall_of(got, {q: want[q] for q in asked if q < 2_000}) >= 0.9


def test_only_queries_short_of_rows_are_scanned(spark, monkeypatch):
    rows, _ = mixed(9, 0.02, 0.06)
    far = [(5_000 + i, (40 * np.eye(64)[i]).tolist()) for i in range(3)]
    v = spark.createDataFrame(rows + far, "vec_id long, embedding array<double>").repartition(3)
    asked, scanned, real = [0, 500, 2_000, 5_000, 5_001, 5_002], [], ann.scan

    def counted(kept, short, k):
        scanned.extend(r["query_id"] for r in short.collect())
        return real(kept, short, k)

    monkeypatch.setattr(ann, "scan", counted)
    got = found(ann.nearest(v, v.where(v.vec_id.isin(asked))))
    want = brute(rows + far, asked, 10)
    assert set(scanned) <= {5_000, 5_001, 5_002} and scanned
    assert all([j for j, _ in got[q]] == [j for j, _ in want[q]] for q in scanned)
    assert {q: len(x) for q, x in got.items()} == dict.fromkeys(asked, 10)


def test_vectors_of_two_lengths_are_refused(spark):
    v = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="one length"):
        ann.nearest(v, v)


def test_scan_is_exact_in_blocks_and_with_ids_on_several_vectors(spark):
    r = np.random.default_rng(5)
    rows = [(k % 150, (1e3 + r.integers(0, 4, size=3)).tolist()) for k in range(300)]
    kept = spark.createDataFrame(rows, "vec_id long, v array<double>").distinct().repartition(4)
    asked = spark.createDataFrame(rows[:150], "query_id long, q array<double>")
    got = {}
    for x in ann.scan(kept, asked, 7, block_rows=40).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    for i, q in rows[:150]:
        near = {}
        for j, x in rows:
            if j != i:
                near[j] = min(near.get(j, np.inf), float(ann.distances(np.array(q), np.array([x]))[0]))
        assert got[i] == sorted(near.items(), key=lambda t: (t[1], t[0]))[:7]
