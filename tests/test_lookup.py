import pytest
from pyspark.sql import functions as F
from tidewell.operators import lookup

N = 200_000


def leaf(df):
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics()


@pytest.fixture(scope="module")
def keys(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("keys") / "by-key")
    df = spark.range(N).select(F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit("@acme.example")).alias("key"), F.col("id").cast("string").alias("lead_id"))
    lookup.write_by_key(df, path, "key", ranges=8)
    return spark.read.parquet(path)


def test_a_key_is_read_from_its_own_range(keys):
    known = keys.where("lead_id = '77'").first()["key"]
    hit = keys.where(F.col("key").isin(known))
    assert [r["lead_id"] for r in hit.collect()] == ["77"]
    assert 0 < leaf(hit).apply("numOutputRows").value() <= N / 8


def test_bloom_filters_deny_keys_that_nobody_has(spark, keys):
    # Inside the ranges of the files, so that the smallest and largest keys rule nothing out.
    absent = [r["k"] for r in spark.range(50).select(F.concat(F.sha2(F.concat(F.lit("absent"), "id"), 256), F.lit("@acme.example")).alias("k")).collect()]
    read = []
    for k in absent[:10]:
        df = keys.where(F.col("key") == k)
        assert df.collect() == []
        read.append(leaf(df).apply("numOutputRows").value())
    assert read.count(0) >= 8


def test_files_are_sorted_and_hold_every_row(keys):
    parts = keys.groupBy(F.input_file_name().alias("f")).agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("n")).orderBy("lo").collect()
    assert len(parts) == 8 and sum(r["n"] for r in parts) == N
    assert all(a["hi"] < b["lo"] for a, b in zip(parts, parts[1:], strict=False))


PEOPLE = [("a", "a", False), ("b", "a", False), ("c", "c", False), ("x", "x", True)]
NAMED = [("ada@acme.example", "a"), ("old@acme.example", "b"), ("linkedin.com/in/cy", "c"), ("gone@acme.example", "nobody")]


@pytest.fixture(scope="module")
def few(spark):
    live = spark.createDataFrame(PEOPLE, "lead_id string, live_id string, cycle boolean")
    return lookup.person_keys(live, spark.createDataFrame(NAMED, "key string, lead_id string"))


CASES = [
    (" ADA@acme.example ", "a"), ("old@acme.example", "a"), ("b", "a"), ("https://www.linkedin.com/in/Cy/?x=1", "c"), ("c", "c"), ("x", "x"),
    ("gone@acme.example", None), ("nobody", None), ("", None), (None, None), ("https://www.linkedin.com/in/", None), ("ada@acme.example" * 9_000, None),
]


def test_one_person(few):
    for raw, lead in CASES:
        if raw is not None:
            assert lookup.find_person(few, raw, unicode=False) == ([lead] if lead else []), raw


def test_many_people_keep_their_rows(spark, few):
    rows = [(k, raw, "old") for k, (raw, _) in enumerate([*CASES, *CASES])]
    asked = spark.createDataFrame(rows, "n int, raw string, lead_id string")  # a column that clashes is replaced
    got = {r["n"]: r["lead_id"] for r in lookup.find_people(few, asked, "raw", unicode=False).collect()}
    assert got == {k: lead for k, (_, lead) in enumerate([*CASES, *CASES])}
    assert lookup.find_people(few.limit(0), asked, "raw", unicode=False).where("lead_id IS NOT NULL").isEmpty()
    assert lookup.find_people(few, asked.limit(0), "raw", unicode=False).isEmpty()


def test_rows_with_one_key_or_none_are_spread(spark, few):
    """Nulls and rows without a second key do not meet in one task; what is joined is a hash of the row."""
    asked = spark.range(4_000).select("id", F.when(F.col("id") % 3 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("p"), F.col("id").cast("string"))).alias("raw"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        got = lookup.find_people(few, asked, "raw", unicode=False).withColumn("part", F.spark_partition_id())
        found = got.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max("lead_id"))  # without lead_id Spark leaves the joins out
        sizes = [r["n"] for r in found.collect()]
        assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()
        assert sum(sizes) == 4_000 and max(sizes) < 1.3 * 4_000 / int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
