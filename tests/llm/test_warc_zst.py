import base64
import hashlib

import pytest
import zstandard
from tidewell.llm import warc_zst as w
from tidewell.storage import work_path

HEAD = {"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:1>", "WARC-Date": "2024-01-01T00:00:00Z"}


def archive(*blocks, dictionary=b"some words that the dictionary holds" * 30):
    x = w.Writer(dictionary)
    return x.head + b"".join(x.record(HEAD, b) for b in blocks)


def test_records_come_back_one_frame_each():
    blocks = [b"", b"a", b"words that the dictionary holds" * 9, bytes(range(256)) * 700]
    assert [b for _, b in w.read_archive(archive(*blocks))] == blocks


def test_a_trained_dictionary_is_read_from_the_head():
    samples = [f"<html><body>page number {k} of the site</body></html>".encode() * 3 for k in range(300)]
    d = w.train_dictionary(samples, 4_096)
    assert int.from_bytes(d[:4], "little") == w.RAW_DICTIONARY_MAGIC
    data = archive(*samples[:5], dictionary=d)
    assert int.from_bytes(data[:4], "little") == w.DICTIONARY_MAGIC
    assert [b for _, b in w.read_archive(data)] == samples[:5]
    raw = zstandard.ZstdCompressor(dict_data=w._dictionary(d)).compress(b"x")
    bare = w.DICTIONARY_MAGIC.to_bytes(4, "little") + len(d).to_bytes(4, "little") + d  # not compressed itself
    assert raw and [b for _, b in w.read_archive(bare + data[8 + int.from_bytes(data[4:8], "little") :])] == samples[:5]


def test_archives_without_dictionary_and_other_skippable_frames():
    one = zstandard.ZstdCompressor().compress(b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: x\r\nWARC-Date: y\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n")
    skip = (0x184D2A50).to_bytes(4, "little") + (3).to_bytes(4, "little") + b"abc"
    assert [b for _, b in w.read_archive(one + skip + one)] == [b"hi", b"hi"]
    assert list(w.read_archive(b"")) == []


@pytest.mark.parametrize(
    ("change", "what"),
    [
        (lambda d: d[:-3], "cut off|damaged"),
        (lambda d: d[:6], "no frame|cut off"),
        (lambda d: d + b"junk", "no frame"),
        (lambda d: d[:-9] + bytes([d[-9] ^ 255]) + d[-8:], "damaged|fit|cut off"),
    ],
)
def test_damage_is_found(change, what):
    with pytest.raises(w.WarcError, match=what):
        list(w.read_archive(change(archive(b"hello", b"world"))))


@pytest.mark.parametrize(
    ("record", "what"),
    [
        (b"HTTP/1.1\r\n\r\n", "not a WARC record"),
        (b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: 0\r\n\r\n\r\n\r\n", "missing"),
        (b"WARC/1.1\r\nWARC-Type: x\r\nWARC-Record-ID: x\r\nWARC-Date: x\r\nContent-Length: 5\r\n\r\nhi\r\n\r\n", "does not fit"),
        (b"WARC/1.1\r\nno header\r\n\r\n\r\n\r\n", "not a header"),
    ],
)
def test_headers_and_lengths_are_checked(record, what):
    with pytest.raises(w.WarcError, match=what):
        list(w.read_archive(zstandard.ZstdCompressor().compress(record)))


def brute(rows, least=0):
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == payload and p is not None]
        ref = min(same) if page is not None and len(payload) >= least and min(same) != page else None
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page, len(payload), digest, "response" if ref is None else "revisit", ref))
    return sorted(out, key=repr)


ROWS = [(1, "u", None), (2, None, ""), (3, "u\r\nX: y", "a"), (4, "u", "é" * 5_000), (5, "u", "a"), (6, "u", "A"), (7, "u", "x" * 300_000), (None, "u", "alone"), *[(10 + k, "u", "hot page") for k in range(50)]]


@pytest.mark.parametrize("least", [0, 2])
def test_equals_brute_force(spark, least):
    pages = spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, refers_to string").repartition(3)
    path = work_path(spark, "warc-test")
    assert w.write_archives(pages, path, least_bytes=least, target_bytes=2_000) > 1
    got = w.read_archives(spark, path)
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.select(*cols).collect()), key=repr) == brute(ROWS, least)
    texts = {r["page_id"]: bytes(r["payload"]).decode() for r in got.where("record_type = 'response'").collect()}
    assert texts[4] == "é" * 5_000 and texts[1] == ""


def test_no_rows(spark):
    path = work_path(spark, "warc-none")
    assert w.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path) == 0
    assert w.read_archives(spark, path).count() == 0


def test_repeated_page_ids_with_other_payloads_lose_nothing(spark, tmp_path):
    rows = [(1, "u", "first"), (2, "u", "second"), (5, "u", "first"), (5, "u", "only here"), (5, "u", "second")]
    w.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w")
    got = w.read_archives(spark, f"file://{tmp_path}/w").collect()
    have = sorted((r["page_id"], r["record_type"], r["refers_to"] or 0, bytes(r["payload"] or b"").decode()) for r in got)
    assert have == [(1, "response", 0, "first"), (2, "response", 0, "second"), (5, "response", 0, "only here"), (5, "revisit", 1, ""), (5, "revisit", 2, "")]


def test_only_files_of_the_manifest_are_read(spark, tmp_path):
    """What an attempt left behind that did not count changes nothing; repeated ids and payloads stay one record each."""
    folder = f"file://{tmp_path}/w"
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3)
    w.write_archives(pages, folder, target_bytes=2_000)
    want = sorted(map(repr, w.read_archives(spark, folder).collect()))
    first = sorted((tmp_path / "w").glob("*.warc.zst"))[0]
    (tmp_path / "w" / "000000-000000-999999.warc.zst").write_bytes(first.read_bytes())
    (tmp_path / "w" / "000001-000000-999998.warc.zst.draft").write_bytes(b"half a")
    assert sorted(map(repr, w.read_archives(spark, folder).collect())) == want
    named = {r["file"]: r["records"] for r in w.manifest(spark, folder).collect()}
    assert sum(named.values()) == len(ROWS) and set(named) <= {f.name for f in (tmp_path / "w").iterdir()}
