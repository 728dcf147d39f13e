import hashlib
import re
from collections import defaultdict

from tidewell.llm.exact_dedup import exact_dedup, winners


def brute(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def test_equals_brute_force_on_odd_rows(messy, messy_rows):
    got = [tuple(r) for r in exact_dedup(messy, salts=3).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=repr) == brute(messy_rows)


def test_hot_text_is_one_group(spark):
    df = spark.range(5_000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'same  text', concat('own ', id)) AS text")
    got = exact_dedup(df)
    assert got.count() == 5_000
    assert got.where("kept").count() == 5_000 - 1_666
    assert {r[0] for r in got.where("group_size > 1").select("keep_id").distinct().collect()} == {0}


def test_no_rows(nothing):
    assert exact_dedup(nothing).count() == 0


def test_texts_of_one_digest_are_told_apart(spark):
    rows = [(k, f"text {k % 3}", bytearray([k % 3 // 2])) for k in range(30)]
    got = winners(spark.createDataFrame(rows, "doc_id long, content string, digest binary")).collect()
    assert len(got) == 30
    assert all((r["keep_id"], r["group_size"]) == (r["doc_id"] % 3, 10) for r in got)
