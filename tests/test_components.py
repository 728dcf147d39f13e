from collections import defaultdict

import pytest
from tidewell.operators.components import connected_components


def brute(edges):
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    out = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            n = todo.pop()
            if n not in out:
                out[n] = start
                todo += near[n]
    return out


CHAIN = [(k, k + 1) for k in range(40)]
STAR = [(100, k) for k in range(101, 160)]
ODD = [(7, 7), (None, 3), (4, None), (200, 201), (201, 200), (200, 201)]


@pytest.mark.parametrize("edges", [CHAIN, STAR, ODD, CHAIN[::-1] + STAR + ODD, []], ids=["chain", "star", "odd", "all", "none"])
def test_equals_brute_force(spark, edges):
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["component"] for r in got} == brute(edges)


def test_a_star_of_many_and_chains_into_it(spark):
    """A centre that all edges meet, with a chain of 64 on some of its rays."""
    star = spark.range(1, 100_000).selectExpr("id + 1000000 AS a", "5000000 AS b")
    chains = spark.range(64 * 20).selectExpr("1000001 + id % 20 * 100 AS ray", "id DIV 20 AS step", "id % 20 AS n")
    chains = chains.selectExpr("IF(step = 0, ray, 9000000 + n * 1000 + step) AS a", "9000000 + n * 1000 + step + 1 AS b")
    got = connected_components(star.unionByName(chains))
    r = got.groupBy("component").count().collect()
    assert [(x["component"], x["count"]) for x in r] == [(1_000_001, 99_999 + 1 + 64 * 20)]
