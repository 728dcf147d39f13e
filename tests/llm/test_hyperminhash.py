import re
from itertools import combinations

import numpy as np
import pytest
from tidewell.llm import hyperminhash as hm

from .conftest import prose


def brute(rows, width, percent):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        s = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        sets[i] = s
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations([i for i in sets if i is not None], 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return sorted(((i, len(sets[i]), find(i), i is None or find(i) == i) for i, *_ in rows), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_equals_brute_force_on_odd_rows(messy, messy_rows, width, percent):
    assert rows_of(hm.near_duplicates(messy, width, percent)) == brute(messy_rows, width, percent)


def test_equals_brute_force_on_prose(small):
    rows = [(r["doc_id"], r["text"]) for r in small.collect()]
    assert rows_of(hm.near_duplicates(small, 3, 85)) == brute(rows, 3, 85)


def family(n):
    """Variants of one text that differ by one to eight words: pairs on both sides of the threshold."""
    base, out = prose(5, 120).split(), []
    r = np.random.default_rng(4)
    for i in range(n):
        w = list(base)
        for at in r.integers(0, len(w), int(r.integers(0, 9))):
            w[at] = f"v{i}"
        out.append((i, " ".join(w)))
    return out + [(1_000 + k, f"{a} {b} {c}") for k, (a, b, c) in enumerate(["abc", "abc", "abd", "xyz"])]


@pytest.mark.parametrize("block_docs", [4_000, 40])
def test_large_near_groups_lose_no_link(spark, block_docs):
    rows = family(150)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(hm.near_duplicates(df, 3, 85, block_docs=block_docs)) == brute(rows, 3, 85)


@pytest.mark.parametrize("slack", [-1.0, 0.0, 0.17, 1.0])
def test_no_link_hangs_on_the_estimate(slack):
    """Whatever the estimate says, from nothing is likely to all is, the same sets are tied."""
    r = np.random.default_rng(6)
    sets, want = [], {}
    for family_ in range(12):
        base = np.unique(r.integers(0, 2**63, int(r.integers(3, 300)), dtype=np.uint64))
        for _ in range(int(r.integers(1, 9))):
            other = np.unique(r.integers(0, 2**63, max(1, len(base) // 9), dtype=np.uint64))
            sets.append(np.unique(np.concatenate([r.choice(base, max(1, int(len(base) * r.uniform(0.85, 1))), replace=False), other[: int(r.integers(0, len(other) + 1))]])))
    near = [(i, j) for i, j in combinations(range(len(sets)), 2) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]

    def tied(links):
        root = list(range(len(sets)))
        for i, j in links:
            a, b = root[i], root[j]
            root = [a if x == b else x for x in root]
        return [root.index(x) for x in root]

    got = hm.link_group(sets, 80, slack=slack)
    assert set(got) <= set(near) and tied(got) == tied(near) and len(near) > 20
    side = np.arange(len(sets)) % 2
    assert tied(hm.link_group(sets, 80, side=side, slack=slack)) == tied([(i, j) for i, j in near if side[i] != side[j]])
    label = np.array(tied(near[::2]))
    assert tied([*near[::2], *hm.link_group(sets, 80, label=label, slack=slack)]) == tied(near)


@pytest.mark.parametrize("blocks", [{"block_docs": 30}, {"block_hashes": 2_500}])
def test_a_large_cluster_with_stragglers(spark, blocks):
    """Most of a coarse component is near its smallest document; others near each other, or near one of its edge, are found too."""
    r, base = np.random.default_rng(3), prose(8, 100).split()
    rows = []
    for i in range(260):
        w = list(base)
        for at in r.integers(0, 100, 2 if i < 200 else int(r.integers(3, 14))):
            w[at] = f"x{i % 37}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(hm.near_duplicates(df, 3, 85, **blocks)) == brute(rows, 3, 85)


def test_no_rows(nothing):
    assert hm.near_duplicates(nothing).count() == 0


def test_estimates_come_near():
    r = np.random.default_rng(2)
    both = r.integers(0, 2**63, 3_000, dtype=np.uint64) * np.uint64(2)
    for share in (0.3, 0.6, 0.9):
        k = int(3_000 * share)
        extra = (3_000 - k) // 2
        a, b = np.unique(both[: k + extra]), np.unique(np.concatenate([both[:k], both[k + extra :]]))
        true = k / (len(a) + len(b) - k)
        got = hm.estimate(hm.registers(a), len(a), hm.registers(b)[None], np.array([len(b)]))[0]
        assert abs(got - true) < 0.15


def test_chance_collisions_are_as_expected():
    r = np.random.default_rng(8)
    sets = [np.unique(r.integers(0, 2**63, 20_000, dtype=np.uint64) * np.uint64(2) + np.uint64(k % 2)) for k in range(60)]
    regs = np.stack([hm.registers(s) for s in sets])
    equal = np.mean([(regs[a] == regs[b]).mean() for a, b in combinations(range(60), 2)])
    assert equal == pytest.approx(float(hm.chance_rate(20_000, 20_000)), rel=0.35)
