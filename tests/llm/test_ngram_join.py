import random
import threading
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mullion.llm import ngram_join as m
from tests.llm import plain


@pytest.mark.parametrize("how", [{}, {"block_shingles": 400, "chunk_bytes": 20_000}, {"block_shingles": 150, "hot_list": 2, "held": 1000}])
def test_equals_all_pairs(small_docs, how):
    docs, texts = small_docs
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in m.components(docs, **how).collect()}
    assert got == plain.components(list(texts.items()))


@pytest.mark.parametrize("ids", [0, 1000])
def test_keep_one_and_columns(small_docs, monkeypatch, ids):
    monkeypatch.setattr(m, "BROADCAST_IDS", ids)
    docs, texts = small_docs
    kept = m.keep_one(docs)
    assert kept.columns == docs.columns
    want = {i for i, (_, c) in plain.components(list(texts.items())).items() if i == c}
    assert {r.doc_id for r in kept.collect()} == want


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "A b c d e f"), (5, None)], "doc_id bigint, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in m.components(docs).collect())
    assert got == [(-1, 2, None), (3, 2, 3), (3, 2, 3), (5, 0, 5), (9, 2, 3)]
    assert m.components(docs.where("false")).count() == 0
    kept = sorted((r.doc_id or -1, r.text) for r in m.keep_one(docs).select("doc_id", F.coalesce("text", F.lit("-")).alias("text")).collect())
    assert kept == [(-1, "a b c d e f"), (3, "a b c d e f"), (5, "-")]


def test_keep_one_of_repeated_and_missing_ids(spark):
    rows = [(1, "p q r s t", {"a": 1}), (1, "z y x", {"b": 2}), (1, "z y x", {"b": 2}), (None, "u v", {"c": 3}), (None, "u v", {"c": 3}), (None, " ", None), (None, None, None), (2, None, None), (2, None, None), (4, "P q r s t", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `__alike` map<string,int>").repartition(3)
    kept = m.keep_one(docs)
    assert kept.columns == docs.columns
    got = Counter((r[0], r[1]) for r in kept.collect())
    assert got == Counter([(1, "p q r s t"), (None, "u v"), (None, " "), (None, None), (2, None)])


def test_needed_overlap():
    for n in range(1, 40):
        for k in range(1, 40):
            need = m.overlap_needed(n, k)
            assert 100 * need >= 75 * (n + k - need) and 100 * (need - 1) < 75 * (n + k - need + 1)


def test_divide_skip_equals_counting():
    rng = random.Random(2)
    sets = [np.unique(np.array(rng.sample(range(60), rng.randint(1, 30)), np.uint64)) for _ in range(120)]
    sets += [np.unique(np.append(s[: max(1, len(s) - 1)], np.uint64(rng.randrange(60)))) for s in sets]
    codes = m.Codes(sets, 1)
    coded = [codes.of(s) for s in sets]
    growing = m.DivideSkip(m.GrowingLists(), [])
    for c in coded:
        growing.add(c)
    fixed = m.DivideSkip(m.FixedLists(coded), coded)
    for i, c in enumerate(coded):
        want = [k for k, s in enumerate(sets) if 100 * len(np.intersect1d(s, sets[i])) >= 75 * len(np.union1d(s, sets[i]))]
        assert growing.search(c) == want == fixed.search(c)
        assert fixed.search(c, {i}) == [k for k in want if k != i]


def test_chain_is_one_component(spark):
    base = [f"w{i}" for i in range(100)]
    rows = []
    for k in range(12):  # each links to the next alone
        rows.append((k, " ".join(base)))
        base[8 * k % 90] = f"x{k}"
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in m.components(docs).collect()}
    assert got == {i: c for i, (_, c) in plain.components(rows).items()}


def test_lists_are_cut_by_size(spark):
    rows = [(1, 10, 100, False), (1, 11, 101, True), (1, 12, 300, True), (2, 10, 100, True), (2, 12, 100, True), (3, 7, 5, False)]
    postings = spark.createDataFrame(rows, "h bigint, doc_id bigint, n bigint, larger boolean").coalesce(1)
    assert [tuple(r) for r in m.star_edges(postings).collect()] == [(10, 11)]


def lists_of(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").select("doc_id", F.encode("text", "UTF-8").alias("text"))
    src = m.chunked(docs, "texts", 5000)
    return src, m.prefixes(src, m.list_lengths(src, 10_000, 24, 1 << 20), 24)


def test_list_lengths_are_exact(spark, small_docs):
    _, texts = small_docs
    src, _ = lists_of(spark, list(texts.items()))
    path = m.list_lengths(src, 10_000, 63, 1 << 20)
    count = Counter(h for t in texts.values() for h in set(m.shingles([t.encode() if t else t])[0].tolist()))
    for chunk in {r.chunk for r in src.select("chunk").collect()}:
        told = m.Told(path, 63)
        told.turn_to(chunk)
        for r in src.where(F.col("chunk") == chunk).collect():
            own = m.shingles([bytes(r.text) if r.text else r.text])[0]
            assert told.count(own).tolist() == [n if n > 1 else 0 for n in (count[h] for h in own.tolist())]


def test_boilerplate_makes_no_cluster(spark):
    """Four fifths of each text in common with all others: too little to link, and nothing of it is moved as the smaller side."""
    common = [f"c{i}" for i in range(160)]
    rows = [(i, " ".join(common + [f"u{i}x{k}" for k in range(44)])) for i in range(3000)]
    src, table = lists_of(spark, rows)
    assert table.agg(F.sum("n_index")).first()[0] == 0
    assert m.similar_links(src, table).count() == 0
    got = {r.component_id for r in m.components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(got) == len(rows)


def test_an_id_with_two_texts_joins_their_classes(spark):
    a, b = "a b c d e f g", "p q r s t u v"
    for parts in (1, 3):
        docs = spark.createDataFrame([(3, a), (5, a), (5, b), (7, b)], "doc_id bigint, text string").repartition(parts)
        assert {(r.doc_id, r.component_id) for r in m.components(docs).collect()} == {(3, 3), (5, 3), (7, 3)}


def test_a_chain_does_not_ask_all_blocks(spark, monkeypatch):
    """Each document is like its neighbours alone: its text doesn't go to all blocks of the cluster."""
    words = [f"w{i}" for i in range(900)]
    rows = [(i, " ".join(words[10 * i : 10 * i + 100])) for i in range(80)]
    asked, search = [], m._search_blocks

    def counted(df, n, percent, between):
        if between:
            own = df.where("asked")
            asked.append((own.count(), own.select("doc_id").distinct().count() * df.select("block").distinct().count()))
        return search(df, n, percent, between)

    monkeypatch.setattr(m, "_search_blocks", counted)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in m.components(docs, block_shingles=400).collect()}
    assert got == plain.components(rows) and {c for _, c in got.values()} == {0}
    assert 0 < asked[0][0] < asked[0][1]


@pytest.mark.parametrize("order", [10, 13])
def test_words_built_to_collide_make_no_link(spark, order):
    one, other = "a", "b"
    for _ in range(order):
        one, other = one + other, other + one
    rows = [(1, one), (2, other), (3, f"{one} x y z w v"), (4, f"{other} x y z w v")]
    got = {r.doc_id: r.component_id for r in m.components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: c for i, (_, c) in plain.components(rows).items()} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_keep_one_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 1, 2), (2, "a b c d e f", 3, 4), (3, "z", 5, 6)], "doc_id bigint, text string, __gone int, row int")
    got = m.keep_one(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [(1, "a b c d e f", 1, 2), (3, "z", 5, 6)]


def test_two_runs_in_two_threads_of_an_application(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    alone = {tuple(r) for r in m.components(docs).collect()}
    found = {}

    def run(k):
        time.sleep(2 * k)
        found[k] = {tuple(r) for r in m.components(docs).collect()}

    threads = [threading.Thread(target=run, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert found == {0: alone, 1: alone}
