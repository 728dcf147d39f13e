import re
from collections import defaultdict

import pytest
from tidewell.llm.mixing import chance, mix, pivot, targets


def targets_of(spark, sizes, weights=(5, 2, 1), times=1.5):
    rows = [(f"s{k:04}", n) for k, n in enumerate(sizes)]
    got = targets(spark.createDataFrame(rows, "source string, size long"), weights, times, 2.0).collect()
    return [r["target"] for r in sorted(got, key=lambda r: r["source"])]


def test_targets_share_again_what_a_full_source_cannot_take(spark):
    assert targets_of(spark, [10, 10, 10]) == [20, pytest.approx(50 / 3), pytest.approx(25 / 3)]
    assert targets_of(spark, [1, 100, 100])[0] == 2
    assert sum(targets_of(spark, [7, 0, 90])) == pytest.approx(1.5 * 97)
    assert targets_of(spark, [4, 4], times=3.0) == [8, 8]
    assert targets_of(spark, []) == []


def test_targets_of_many_sources(spark, monkeypatch):
    from tidewell.llm import mixing
    from tidewell.operators import prefix

    monkeypatch.setattr(mixing, "running_sums", lambda df, by, cols: prefix.running_sums(df, by, cols, range_rows=90))
    sizes = [k * 7919 % 613 if k % 5 else 0 for k in range(700)]
    want = slow_targets(sizes, [[5, 2, 1][k % 3] for k in range(700)], 1.5 * sum(sizes))
    assert targets_of(spark, sizes) == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("bad", [{"most": 1.5}, {"weights": (1, 0)}])
def test_odd_parameters_are_refused(messy, bad):
    with pytest.raises(ValueError):
        mix(messy, **bad)


def test_pivot_keeps_the_mass():
    sizes = [17, 3, 90, 41, 5, 66, 8, 120] * 20
    shares = [(k % 9 + 1) / 10 for k in range(len(sizes))]
    took, at, p = pivot(range(len(sizes)), sizes, shares, seed=3)
    mass = sum(s * (t or 0) for s, t in zip(sizes, took, strict=True)) + (sizes[at] * p if at >= 0 else 0)
    assert mass == pytest.approx(sum(s * q for s, q in zip(sizes, shares, strict=True)))
    assert sum(t is None for t in took) == (at >= 0)


def test_pivot_is_fair():
    n = [0] * 4
    for seed in range(4_000):
        took, at, p = pivot("abcd", [10, 30, 20, 5], [0.3, 0.6, 0.5, 0.2], seed)
        for k, t in enumerate(took):
            n[k] += t if t is not None else int(chance(seed, "last") < p)
    assert [round(x / 4_000, 1) for x in n] == [0.3, 0.6, 0.5, 0.2]


def test_words_come_near_their_targets_and_reruns_agree(spark):
    df = spark.range(6_000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'hot', concat('s', id % 7)) AS source", "repeat('w ', int(1 + id * 7919 % 50)) AS text")
    first = mix(df, bucket_rows=200, fan_in=3)
    by = first.groupBy("source").agg({"taken": "sum", "target": "first", "source_size": "first"}).collect()
    for r in by:
        assert abs(r["sum(taken)"] - r["first(target)"]) <= 60
    assert sum(r["first(target)"] for r in by) == pytest.approx(1.5 * sum(r["first(source_size)"] for r in by))
    assert first.where("taken > 2 * size").count() == 0
    again = mix(df.repartition(7), bucket_rows=200, fan_in=3)
    assert first.exceptAll(again).count() == 0


def test_odd_rows(messy, messy_rows, nothing):
    got = mix(messy)
    assert got.count() == len(messy_rows)
    sizes = defaultdict(int)
    for _, t, _, s, *_ in messy_rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert {r["source"]: r["source_size"] for r in got.collect()} == sizes
    assert got.where("source IS NULL").count() == 3
    assert mix(nothing).count() == 0


def slow_targets(sizes, weights, total):
    """The level at which min(level * weight, 2 * size) adds up to the total, by bisection."""
    if total >= 2 * sum(sizes):
        return [2.0 * s for s in sizes]
    lo, hi = 0.0, 4.0 * (total + 1)
    for _ in range(200):
        level = (lo + hi) / 2
        lo, hi = (level, hi) if sum(min(level * w, 2 * s) for s, w in zip(sizes, weights)) < total else (lo, level)
    return [min(hi * w, 2 * s) for s, w in zip(sizes, weights)]


def slow_copies(rows, ratio, seed):
    """The rule itself: two open fractions meet, mass moves one way or the other, until one of them is 0 or 1."""
    done, open_ = {}, None
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    for k, (i, size) in enumerate(order):
        frac = ratio - int(ratio)
        done[i] = int(ratio)
        if not size or frac == 0:
            continue
        if open_ is None:
            open_ = [i, size, frac, i]
            continue
        a, b = open_, [i, size, frac, i]
        gain = min((1 - a[2]) * a[1], b[2] * b[1])
        loss = min(a[2] * a[1], (1 - b[2]) * b[1])
        moved = gain if chance(seed, a[0], i, k) * (gain + loss) < loss else -loss
        left = []
        for x, d in ((a, moved / a[1]), (b, -moved / b[1])):
            x[2] += d
            if min(abs(x[2]), abs(1 - x[2])) < 1e-9:
                done[x[0]] += round(x[2])
            else:
                left.append(x)
        open_ = left[0] if left else None
    if open_:
        done[open_[0]] += int(chance(seed, "last", open_[0]) < open_[2])
    return done


def test_equals_targets_and_rounding_by_hand(spark):
    docs = [(k, ["web", "book", "code", None, "zoo"][k * 7 % 5], "w " * (k * 37 % 90 if k % 11 else 0)) for k in range(400)] + [(900 + k, "tiny", "x") for k in range(4)]
    got = mix(spark.createDataFrame(docs, "doc_id long, source string, text string"), seed=9).collect()
    names = sorted({s for _, s, _ in docs if s is not None}) + [None]
    sizes = [sum(len(t.split()) for _, s, t in docs if s == n) for n in names]
    targets = slow_targets(sizes, [[5, 2, 1][k % 3] for k in range(len(names))], 1.5 * sum(sizes))
    for n, size, target in zip(names, sizes, targets):
        mine = [(i, len(t.split())) for i, s, t in docs if s == n]
        rows = [r for r in got if r["source"] == n]
        assert all(r["source_size"] == size and r["target"] == pytest.approx(target, rel=1e-6) for r in rows)
        if target / size < 2 - 1e-9:
            assert {r["doc_id"]: r["copies"] for r in rows} == slow_copies(mine, rows[0]["target"] / size, 9)
        else:
            assert all(r["copies"] == 2 for r in rows)
        assert abs(sum(r["taken"] for r in rows) - target) <= 90
