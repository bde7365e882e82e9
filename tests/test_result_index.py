import json
import os

import pytest

from mullion.sources import result_index as ix


def row(task, n, **more):
    return json.dumps({"task_id": task, "ordinal": n, "free": {"pass": n % 2 == 0, "err": f"é{n}", "total_tokens": n}} | more, ensure_ascii=False)


@pytest.fixture
def folder(tmp_path):
    path = tmp_path / "results.jsonl"
    path.mkdir()
    lines = [[], [], []]
    for n in range(3000):
        lines[n % 3].append(row(f"t{n // 2}", n))
    lines[1][5:5] = ["", "no json", '{"free": {"pass": true}}']
    lines[2][7] += "\r"
    lines[0].insert(0, row(77, 5000, fsm={"pass": True}))
    lines[2].append(row("t0", 9000))
    for k, part in enumerate(lines):
        (path / f"part-0000{k}.json").write_text("\n".join(part) + ("\n" if k else ""), newline="")
    (path / "_SUCCESS").write_text("")
    return str(path)


def first(spark, path, task, mode="free"):
    r = ix.find_result(spark, path, task, mode).first()
    return r.task_id, r.total_tokens, r.err


def test_index_and_scan_say_the_same(spark, folder, monkeypatch):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # several parts a file
    try:
        asked = ["t0", "t1", "t499", "t1499", "t700"]
        by_scan = [first(spark, folder, t) for t in asked]
        ix.build_index(spark, folder)
        monkeypatch.setattr(ix, "scan_for", lambda *a: pytest.fail("scanned"))
        assert [first(spark, folder, t) for t in asked] == by_scan
        assert by_scan[0] == ("t0", 0, "é0")  # the first file's row, not the last one's
        assert ix.find_result(spark, folder, 77, "fsm").first()["pass"] is True
        with pytest.raises(LookupError, match="'t5000' not found"):
            ix.find_result(spark, folder, "t5000", "free")
        with pytest.raises(LookupError, match="'t3' has no mode 'fsm'"):
            ix.find_result(spark, folder, "t3", "fsm")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_every_line_is_where_the_index_says(spark, folder):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        ix.build_index(spark, folder)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    places = spark.read.parquet(f"{ix.index_path(folder)}/places").collect()
    whole = {n: open(f"{folder}/{n}", "rb").read() for n in {p.file for p in places}}
    assert len(places) == 3002
    for p in places:
        assert str(json.loads(whole[p.file][p.offset : p.offset + p.size])["task_id"]) == p.task_id


def test_a_stale_index_is_not_used(spark, folder):
    ix.build_index(spark, folder)
    name = f"{folder}/part-00000.json"
    before = os.stat(name)
    text = open(name).read()
    open(name, "w").write(row("t0", 4242) + "\n" + text)
    assert first(spark, folder, "t0")[1] == 4242  # another length
    with pytest.raises(LookupError, match="other files"):
        ix.place_of(spark, folder, "t0")
    ix.build_index(spark, folder)
    assert ix.place_of(spark, folder, "t0")[:2] == ("part-00000.json", 0)
    os.utime(name, ns=(before.st_atime_ns, before.st_mtime_ns + 5_000_000_000))
    with pytest.raises(LookupError, match="other files"):
        ix.place_of(spark, folder, "t0")  # another time
    os.remove(name)
    assert first(spark, folder, "t1")[1] == 2


def test_what_a_lookup_reads_does_not_grow(spark, tmp_path, monkeypatch):
    """The rows that the lookup's scan of the index lets through, and the files it opens, at two sizes."""
    monkeypatch.setattr(ix, "BUCKET_LINES", 500)
    opened = []
    for n in (1000, 16_000):
        path = tmp_path / f"r{n}"
        path.mkdir()
        (path / "part-0.json").write_text("\n".join(row(f"t{k}", k) for k in range(n)))
        ix.build_index(spark, str(path))
        places = spark.read.parquet(f"{ix.index_path(str(path))}/places")
        buckets = places.select("bucket").distinct().count()
        size = max(os.path.getsize(f.removeprefix("file://")) for f in places.inputFiles())
        opened.append((buckets, size))
        assert first(spark, str(path), f"t{n - 1}")[1] == n - 1
    assert opened[1][0] >= 8 * opened[0][0] and opened[1][1] < 2 * opened[0][1]


def test_no_rows_and_one_file(spark, tmp_path):
    path = tmp_path / "one.jsonl"
    path.write_text(row("a", 1) + "\n" + row("b", 2))
    assert first(spark, str(path), "b") == ("b", 2, "é2")
    ix.build_index(spark, str(path))
    assert first(spark, str(path), "b") == ("b", 2, "é2")
    empty = tmp_path / "empty"
    empty.mkdir()
    ix.build_index(spark, str(empty))
    with pytest.raises(LookupError, match="not found"):
        ix.find_result(spark, str(empty), "a", "free")
