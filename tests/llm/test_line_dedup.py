import numpy as np
import pytest

from mullion.llm import line_dedup as m
from mullion.llm.queries import oracle_sql
from tests.compare import both

SF = "/root/testdata/sf0.001"


def plain_drop(rows, least):
    """Per row by counting lines in sets."""
    fold = lambda line: line.strip(b" \t\n\r\x0b\x0c").lower()
    split = [(i, (t or "").encode().split(b"\n")) for i, t in rows]
    found = {}
    for _, lines in split:
        for key in {fold(x) for x in lines}:
            found[key] = found.get(key, 0) + 1
    gone = {k for k, n in found.items() if k and n >= least}
    return sorted((i if i is not None else -1, len(x), sum(fold(y) in gone for y in x), b"\n".join(y for y in x if fold(y) not in gone)) for i, x in split)


def told(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_lines, r.n_dropped, bytes(r.kept)) for r in df.collect())


def test_query_equals_its_sql(spark):
    ours, theirs = both(spark, SF, m.op11_line_dedup, oracle_sql()["op11_line_dedup"])
    assert ours == theirs


@pytest.mark.parametrize("least", [1, 2, 10])
def test_equals_counting_lines(small_docs, spark, least):
    docs, texts = small_docs
    assert told(m.drop_lines(docs, m.build_index(docs, least=least), least)) == plain_drop(list(texts.items()), least)


def test_folding_blanks_nulls_and_repeats(spark):
    same = ["Line\nown{}", " \tLINE \r\nown{}", "line\x0b\n\n\nown{}", "lİne\nline\nline", "\x85line\nxline"]
    rows = [(i, same[i % 5].format(i)) for i in range(40)] + [(None, None), (None, "line"), (7, "line"), (7, "line"), (8, ""), (9, "\n\n"), (10, "  \n\t")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, a string, n int").repartition(6)
    for least in (10, 26, 27, 28, 29):
        assert told(m.drop_lines(docs, m.build_index(docs, least=least), least)) == plain_drop(rows, least)


def test_one_index_serves_several_thresholds_and_other_documents(spark):
    rows = [(i, "\n".join(f"l{k}" for k in range(i, 30))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    index = m.build_index(docs, least=2)
    for least in (2, 5, 30, 31):
        assert told(m.drop_lines(docs, index, least)) == plain_drop(rows, least)
    other = spark.createDataFrame([(1, "l29\nnew\nl0")], "doc_id bigint, text string")
    assert told(m.drop_lines(other, index, 20)) == [(1, 3, 1, b"new\nl0")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert m.drop_lines(docs, m.build_index(docs)).count() == 0
    only = spark.createDataFrame([(1, "x")], "doc_id bigint, text string")
    assert told(m.drop_lines(only, m.build_index(docs))) == [(1, 1, 0, b"x")]


def test_long_texts_little_memory_and_many_shards(spark, monkeypatch):
    rows = [(i, "\n".join(f"line {k * (i + 1) % 5000}" for k in range(20_000))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    monkeypatch.setattr(m, "HELD_BYTES", 20_000)
    monkeypatch.setattr(m, "COUNTED", 700)
    monkeypatch.setattr(m, "BLOCK_BYTES", 100_000)
    assert told(m.drop_lines(docs, m.build_index(docs, shard_keys=100))) == plain_drop(rows, 10)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash_is_minimal(n):
    halves = np.random.default_rng(n).integers(0, 1 << 63, (n, 2), np.uint64)
    halves[: n // 2, 1] = 5  # equal in one half
    hashed = m.PerfectHash.of(halves)
    assert sorted(hashed.slots(halves).tolist()) == list(range(n))
    foreign = hashed.slots(np.random.default_rng(99).integers(0, 1 << 63, (1000, 2), np.uint64))
    assert foreign.min() >= -1 and foreign.max() < max(n, 1)


def test_foreign_keys_are_refused():
    rng = np.random.default_rng(5)
    halves = rng.integers(0, 1 << 63, (3000, 2), np.uint64)
    counts = rng.integers(1, 70_000, 3000).astype(np.uint64)
    shard = m.Shard(m.pack_shard(0, halves, counts).to_pylist()[0])
    assert (shard.count(halves) == counts.astype(np.int64)).all()
    assert not shard.count(rng.integers(0, 1 << 63, (100_000, 2), np.uint64)).any()
