import itertools
import random

import pytest
from pyspark.sql import functions as F

from mullion.llm import decontaminate as m
from tests.compare import both


@pytest.fixture
def planted(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = {i: [word() for _ in range(rng.randint(15, 50))] for i in range(8)}
    docs, leaky = [], set()
    for k in range(60):
        own = [word() for _ in range(80)]
        if k % 3 == 0:
            part = list(items[k % 8])
            for j in rng.sample(range(len(part)), len(part) // 10):
                part[j] = "changed"
            own[20:20] = part
            leaky.add((k, k % 8))
        elif k % 3 == 1:
            own[5:5] = items[k % 8][:4]
        docs.append((k, " ".join(own).title(), None))
    docs += [(100, None, 1), (101, "", 2), (None, " ".join(items[1]), 3), (102, " ".join(items[2][3:]), 4)]
    bench = [(i, " ".join(w) + ".") for i, w in items.items()] + [(50, None), (None, "a b"), (51, "too short")]
    return spark.createDataFrame(docs, "doc_id bigint, text string, item_id int"), spark.createDataFrame(bench, "item_id bigint, text string"), leaky


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_planted_passages(planted, monkeypatch, limit):
    monkeypatch.setattr(m, "BROADCAST_SEEDS", limit)
    docs, bench, leaky = planted
    assert {(r.doc_id, r.item_id) for r in m.leaks(docs, bench).collect()} == leaky | {(None, 1), (102, 2)}
    left = m.clean(docs, bench)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {r for r in range(60)} - {d for d, _ in leaky} | {100, 101}


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_equals_its_sql(spark, monkeypatch, limit):
    monkeypatch.setattr(m, "BROADCAST_SEEDS", limit)
    ours, theirs = both(spark, "/root/testdata/sf0.01", m.op5_decontaminate, m.OP5_SQL)
    assert ours == theirs and ours


def test_empty_tables(planted):
    docs, bench, _ = planted
    assert m.leaks(docs.where("false"), bench).count() == 0 and m.leaks(docs, bench.where("false")).count() == 0
    assert m.clean(docs, bench.where("false")).count() == docs.count()


def overlaps(texts, items):
    """{(doc, item): (agreed, stretch, places)} by laying every item along every place of every text."""
    out = {}
    for d, t in texts.items():
        own = t.lower().split()
        for i, text in items.items():
            words = text.lower().split()
            stretch = min(len(words), 16)
            best, places = 0, 0
            for at in range(1 - len(words), len(own)):
                same = [0 <= at + k < len(own) and own[at + k] == w for k, w in enumerate(words)]
                agreed = max(sum(same[p : p + stretch]) for p in range(len(words) - stretch + 1))
                if 100 * agreed >= 75 * stretch:
                    best, places = max(best, agreed), places + 1
            if places and len(words) >= 4:
                out[d, i] = best, stretch, places
    return out


def test_no_overlap_is_missed(spark):
    """Items of all lengths, with as many substitutions as the threshold allows: at random, and at every fourth word."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    items = {n: [word() for _ in range(n)] for n in [*range(1, 25), 40]}
    texts, k = {}, 0
    for n, words in items.items():
        for how in range(8):
            part = list(words)
            gone = range(how, n, 4) if how < 4 else rng.sample(range(n), min(n, n * 25 // 100 if n < 16 else 4) + (how == 7))
            for j in gone:
                part[j] = word()
            texts[k] = " ".join([word() for _ in range(rng.randint(0, 9))] + part + [word() for _ in range(rng.randint(0, 9))])
            k += 1
    items = {n: " ".join(w) for n, w in items.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.agreed, r.stretch, r.n_places) for r in m.leaks(docs, bench).collect()}
    assert got == overlaps(texts, items) and len(got) > 100


def test_masks_lose_nothing():
    for n in range(12, 17):
        for gone in itertools.combinations(range(n), n // 4):
            assert any(all(s + o not in gone for o in mask) for mask in m.MASKS for s in range(n - mask[-1]))


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_items_that_share_an_id_and_clashing_names(spark, monkeypatch, limit):
    monkeypatch.setattr(m, "BROADCAST_SEEDS", limit)
    a, b = (" ".join(f"{x}{k}" for k in range(20)) for x in "ab")
    bench = spark.createDataFrame([(1, a), (1, b), (1, b), (2, b)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, a, 5, "k", "g"), (2, "x " + b, 6, None, "g"), (3, "z", 7, "k", "g")], "doc_id bigint, text string, __doc int, __key string, row string")
    got = {(r.doc_id, r.item_id, r.n_places) for r in m.leaks(docs, bench).collect()}
    assert got == {(1, 1, 1), (2, 1, 1), (2, 2, 1)}
    assert [tuple(r) for r in m.clean(docs, bench).collect()] == [(3, "z", 7, "k", "g")] and m.clean(docs, bench).columns == docs.columns


def test_long_items_are_broadcast_without_their_words(spark):
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(1500))) for i in range(30)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "only four words here"), (2, " ".join(f"w7x{k}" for k in range(400, 440)))], "doc_id bigint, text string")
    found = m.leaks(docs, items)
    assert [(r.doc_id, r.item_id) for r in found.collect()] == [(2, 7)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    built = m.seeds(items.select("item_id", m.word_keys("text").alias("item_words"), F.lit(1).alias("item_size")), "item_words", [(x, None) for x in m.MASKS], "item_id", "item_size", items=True)
    assert built.count() > 150_000 and "item_words" not in built.columns
