import base64
import gzip
import hashlib
import json
import os

from mullion.llm import warc as m
from mullion.llm.common import fresh_path
from tests.compare import both

SCHEMA = "page_id bigint, url string, html string, digest string"
ROWS = [(5, "http://a", "same é", "x"), (2, "http://b", "same é", None), (9, "http://c", "same é", None), (1, None, None, None), (3, "u\r\nX: y", "", None), (7, "http://d", "z" * 300_000, None), (7, "http://d", "other", None), (None, "http://e", "other", None)]


def files(path):
    local = path.removeprefix("file://")
    return {n: open(f"{local}/{n}", "rb").read() for n in sorted(os.listdir(local)) if not n.startswith(".")}


def test_records_read_back(spark):
    path = m.write_warc(spark.createDataFrame(ROWS, SCHEMA), fresh_path(spark, "w"), roll=500)
    got = {(r.page_id, r.payload_digest): (r.record_type, r.refers_to, r.payload_bytes) for r in m.read_warc(spark, path).collect()}
    sha = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    assert got[2, sha("same é")] == ("response", None, 7) and got[5, sha("same é")] == ("revisit", 2, 7) == got[9, sha("same é")][:0] + ("revisit", 2, 7)
    assert got[1, sha("")] == ("response", None, 0) and got[3, sha("")] == ("revisit", 1, 0)
    assert got[7, sha("z" * 300_000)] == ("response", None, 300_000) and got[7, sha("other")][0] == "response"
    assert len(got) == 8


def test_same_rows_same_bytes_and_manifest(spark):
    a = files(m.write_warc(spark.createDataFrame(ROWS, SCHEMA), fresh_path(spark, "w"), roll=400))
    b = files(m.write_warc(spark.createDataFrame(ROWS[::-1], SCHEMA).repartition(3), fresh_path(spark, "w"), roll=400))
    assert a == b
    listed = [json.loads(x) for x in a["manifest.jsonl"].splitlines()]
    assert {x["file"] for x in listed} == set(a) - {"manifest.jsonl"} and sum(x["records"] for x in listed) == 8
    assert all(len(a[x["file"]]) == x["bytes"] for x in listed) and len(listed) > 2
    assert gzip.decompress(a[listed[0]["file"]]).startswith(b"WARC/1.1\r\n")


def test_left_over_files_do_not_count(spark):
    path = m.write_warc(spark.createDataFrame(ROWS, SCHEMA), fresh_path(spark, "w"))
    with open(path.removeprefix("file://") + "/part-99999999-00000.warc.gz", "wb") as f:
        f.write(b"of a lost attempt")
    assert m.read_warc(spark, path).count() == 8


def test_small_payloads_are_responses(spark):
    path = m.write_warc(spark.createDataFrame(ROWS, SCHEMA), fresh_path(spark, "w"), min_bytes=8)
    assert {r.record_type for r in m.read_warc(spark, path).collect()} == {"response"}


def test_empty_table(spark):
    path = m.write_warc(spark.createDataFrame([], SCHEMA), fresh_path(spark, "w"))
    assert m.read_warc(spark, path).count() == 0


def test_equals_its_sql(spark):
    ours, theirs = both(spark, "/root/testdata/sf0.001", m.op2_warc, m.OP2_SQL)
    assert ours == theirs


def test_extreme_and_outlying_ids(spark):
    rows = [(i, f"http://{i}", f"<p>{i % 7} {'x' * (i % 50)}</p>") for i in [-(2**63), -9 * 10**18, *range(200), 2**60, 9 * 10**18, 2**63 - 1]]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    path = m.write_warc(pages, fresh_path(spark, "w"), shard_bytes=10_000)
    got = {r.page_id: (r.record_type, r.refers_to) for r in m.read_warc(spark, path).collect()}
    first = {}
    for i, _, html in sorted(rows):
        first.setdefault(html, i)
    assert got == {i: ("response", None) if first[h] == i else ("revisit", first[h]) for i, _, h in rows}
    sizes = [json.loads(x)["records"] for x in files(path)["manifest.jsonl"].splitlines()]
    assert len(sizes) > 10 and max(sizes) < 20


def test_shards_depend_on_the_rows_alone(spark):
    rows = [(i * i, "u", "x" * (25_000 if i % 60 == 7 else i % 90)) for i in range(500)]
    make = lambda r, n: spark.createDataFrame(r, "page_id bigint, url string, html string").repartition(n)
    want, at, last = [], 0, -9000
    for i, _, html in rows:
        if at // 9000 > last // 9000:
            want.append(i)
        at, last = at + len(html) + m.RECORD_BYTES, at
    for some in (make(rows, 1), make(rows[::-1], 5), make(rows, 3)):
        assert m.shard_starts(some, 9000).tolist() == want


def test_rows_without_id_are_spread(spark):
    rows = [(None, f"u{i}", f"p{i}") for i in range(100)] + [(1, "a", "p0")]
    path = m.write_warc(spark.createDataFrame(rows, "page_id bigint, url string, html string"), fresh_path(spark, "w"), shard_bytes=10_000)
    assert {r.record_type for r in m.read_warc(spark, path).collect()} == {"response"} and m.read_warc(spark, path).count() == 101
    assert len(files(path)) > 8


def test_revisits_name_their_original(spark):
    path = m.write_warc(spark.createDataFrame(ROWS, SCHEMA), fresh_path(spark, "w"))
    records = [h for n, data in files(path).items() if n.endswith(".gz") for h, _ in m.read_records(iter([data]))]
    by_id = {h["WARC-Record-ID"]: h for h in records}
    revisits = [h for h in records if h["WARC-Type"] == "revisit"]
    assert len(revisits) == 3
    for h in revisits:
        original = by_id[h["WARC-Refers-To"]]
        assert original["WARC-Payload-Digest"] == h["WARC-Payload-Digest"] and original["WARC-Target-URI"] == h["WARC-Refers-To-Target-URI"]
