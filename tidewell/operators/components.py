"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewell.storage import materialize


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an edge; ``component`` is the smallest node reachable.

    Each round links every node to the smallest of its neighbours and is two
    aggregations and joins; it ends when a round changes nothing. The edge list is a
    written table after each round, so lineage stays short. What a node learns is a written
    table too: both sides of each join are then shuffled as they are read, and Spark splits the edges of a node that a
    large part of all edges meet. Null ends and self loops are ignored; repeated edges count
    once; no edges give no rows.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    e = materialize(e.where(F.col("u") > F.col("v")).distinct(), "cc")
    for _ in range(max_rounds):
        # Large star: each node sends its larger neighbours to its smallest one.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
        large = e.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u > v").distinct(), "cc-large")
        # Small star: each node sends its smaller neighbours, and itself, to the smallest.
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = materialize(small, "cc")
        mark = [F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
        same = tuple(new.agg(*mark).first()) == tuple(e.agg(*mark).first())
        e = new
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def extend_components(labels: DataFrame, edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """The labels that change, ``(node, component)``, when edges are added to a graph whose components are known.

    ``labels`` is ``connected_components``'s result so far. New edges meet the labels of their own ends only and become edges between
    components, which are far fewer; where components merge, the members of those that lose their label follow. A large component that
    keeps its label is not rewritten, and labels that no new edge meets are not touched. Rows to put in place of, or add to, ``labels`` by node.
    """
    e = materialize(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a != b").distinct(), "new-edges")
    ends = e.select(F.col("a").alias("node")).unionByName(e.select(F.col("b").alias("node"))).distinct()
    known = materialize(labels.select("node", "component").join(ends, "node", "left_semi"), "known-ends")
    at = lambda end: known.select(F.col("node").alias(end), F.col("component").alias(f"{end}_of"))
    lifted = e.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b"))
    roots = materialize(connected_components(lifted), "new-roots")
    fresh = ends.join(known, "node", "left_anti").join(roots, "node")
    lost = roots.where("node != component").select(F.col("node").alias("component"), F.col("component").alias("into"))
    moved = labels.select("node", "component").join(lost, "component").select("node", F.col("into").alias("component"))
    return moved.unionByName(fresh.select("node", "component"))
