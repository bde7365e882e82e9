import pyarrow as pa

from mullion.llm import url_filters as m
from tests.compare import both

CASES = {
    None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "http://A.Net": ("a.net", "", None, "allow"), "http://a.net/": ("a.net", "/", "net/", "block"),
    "http://x.EXAMPLE.net/en/1?a/b#c": ("x.example.net", "/en/1", "example.net/en/", "allow"), "http://example.net/enx": ("example.net", "/enx", "net/", "block"),
    "http://a.com?x=/de/": ("a.com", "", None, "allow"), "http://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"), "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
    "http://org/fr/": ("org", "/fr/", "org/fr/", "allow"), "http://free-bets.example.com/x": ("free-bets.example.com", "/x", None, "block"), "http://É.net/": ("É.net", "/", "net/", "block"), "a://b://c.net/": ("b:", "//c.net/", None, "allow"),
}


def test_cases(spark):
    rows = list(enumerate(CASES))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in m.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    assert got == {i: CASES[u] for i, u in rows}


def test_collisions_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(m.xxhash, "xxh64_intdigest", lambda s: len(s))
    with open(f"{tmp_path}/a", "wb") as f:
        m.DigestArray.write([("block", "abc", "/"), ("allow", "xyz", "/"), ("block", "q", "/longer")], f)
    array = m.DigestArray(f"{tmp_path}/a")
    found = array.probe([b"abc/", b"xyz/", b"nnn/", b"q/longer", b""])
    assert [array.text[array.offsets[i] : array.offsets[i + 1]].tobytes() if i >= 0 else None for i in found] == [b"abc/", b"xyz/", None, b"q/longer", None]


def test_many_keys_equal_a_dictionary(tmp_path):
    rules = [("block" if k % 3 else "allow", f"h{k % 500}.t{k}", "/") for k in range(5000)]
    with open(f"{tmp_path}/a", "wb") as f:
        m.DigestArray.write(rules, f)
    array = m.DigestArray(f"{tmp_path}/a")
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array([f"http://w.{h}/p" if k % 2 else f"http://{h}x/p" for k, (_, h, _) in enumerate(rules)])], ["page_id", "url"])
    out = next(m.judge_batches(iter([batch]), array, "none")).column("verdict").to_pylist()
    assert out == [v if k % 2 else "none" for k, (v, _, _) in enumerate(rules)]


def test_no_rules_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "http://a/")], "page_id bigint, url string")
    assert [r.verdict for r in m.filter_urls(docs, ()).collect()] == ["allow"]
    assert m.filter_urls(docs.where("false")).count() == 0


def test_equals_its_sql(spark):
    ours, theirs = both(spark, "/root/testdata/sf0.01", m.op10_url_filters, m.OP10_SQL)
    assert ours == theirs


def plain(url, rules):
    """(rule, verdict) by trying every rule."""
    host, path = m.split_url(url)
    fits = [(len(h + p), h + p, v) for v, h, p in rules if v != "listed" and (host == h or host.endswith("." + h)) and path.startswith(p)]
    listed = any(v == "listed" and (host == h or host.endswith("." + h)) and path.startswith(p) for v, h, p in rules)
    return max(fits)[1:] if fits else (None, "block" if listed else "allow")


def test_hostile_hosts_and_deep_rules(spark):
    rules = [("block", "a.b.c.d", "/"), ("allow", "d", "/x/"), ("block", "c.d", ""), ("listed", "e.f.g.h.i", "/"), ("allow", "z.a.b.c.d", "/x/y")]
    hosts = ["a.b.c.d", "q.a.b.c.d", "z.a.b.c.d", "b.c.d", "c.d", "xc.d", "d", ".d", "..c.d", "e.f.g.h.i", "w.e.f.g.h.i", "f.g.h.i", "x." * 50_000 + "a.b.c.d", "y" * 100_000 + ".d", "." * 100_000]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/x/", "/x/y/z", "/" + "x/" * 5000)]
    got = {r.page_id: (r.rule, r.verdict) for r in m.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), rules).collect()}
    assert got == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_null_ids_repeats_and_clashing_names(spark):
    rows = [(None, "http://a.net/", "h", 1), (1, "http://a.net/", "h", 2), (1, "http://a.net/", "h", 2), (2, None, None, None)]
    got = m.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string, host string, verdict int"))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted((r.page_id or 0, r.host, r.verdict) for r in got.collect()) == [(0, "a.net", "block"), (1, "a.net", "block"), (1, "a.net", "block"), (2, "", "allow")]
