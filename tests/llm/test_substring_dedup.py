import hashlib

import numpy as np
import pytest

from mullion.llm import exchange
from mullion.llm import substring_dedup as m
from tests.llm import plain


def digests(df):
    return {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in df.collect()}


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 20_000, "held": 1000}])
def test_equals_counting_all_windows(small_docs, sizes):
    docs, texts = small_docs
    assert digests(m.remove_repeats(docs, **sizes)) == plain.kept_words(list(texts.items()))


def test_nulls_repeats_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(None, text + " x"), (1, text), (1, text), (2, None), (3, text[:100])], "doc_id bigint, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed) for r in m.remove_repeats(docs).collect())
    assert got == [(-1, 41, 40), (1, 40, 40), (1, 40, 40), (2, 0, 0), (3, len(text[:100].split()), 0)]
    assert m.remove_repeats(docs.where("false")).count() == 0


def test_repeat_within_a_text(spark):
    text = " ".join(f"w{i % 36}" for i in range(108))
    rows = [(1, text), (2, "a " * 36)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert digests(m.remove_repeats(docs)) == plain.kept_words(rows)


def test_long_texts_and_a_passage_in_all(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(i, f"{' '.join(f'{i}x{k}' for k in range(i))} {passage} {' '.join(f'{i}y{k}' for k in range(30 + i))}") for i in range(40)]
    rows += [(99, " ".join(f"z{k % 70_000}" for k in range(140_000)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert digests(m.remove_repeats(docs)) == plain.kept_words(rows)


@pytest.mark.parametrize("bits", [16, 33, 63])
def test_packed_values_come_back(bits):
    values = np.unique(np.random.default_rng(1).integers(0, 1 << bits, 1000, np.uint64))
    counts, marks = np.arange(1, len(values) + 1, dtype=np.uint64) % 300, values % 3 == 0
    for got, want in zip(exchange.unpack(exchange.pack(values, counts, marks)), (values, counts, marks), strict=True):
        assert (got == want).all()
    assert not len(exchange.unpack(exchange.pack(values[:0], counts[:0], marks[:0]))[0])


def test_what_comes_back_is_what_occurs_twice_at_any_width(spark, tmp_path):
    """Few bits let more hashes through, and lose none."""
    rng = np.random.default_rng(2)
    own = {c: rng.integers(0, 3000, 700).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for c in range(6)}
    src = spark.createDataFrame([(b"x", c) for c in own], "text binary, chunk bigint").repartition(3)

    def of(batches):
        for chunk, _ in exchange.runs(batches):
            yield chunk, own[chunk], own[chunk] % np.uint64(2) == 0

    values, n = np.unique(np.concatenate(list(own.values())), return_counts=True)
    wanted = set(values[n > 1].tolist())
    for bits in (8, 20, 63):
        path = exchange.tell(src, of, lambda n, _: n > 1, 4200, bits, "test")
        for chunk, mine in own.items():
            back = exchange.Told(path, bits)
            back.turn_to(chunk)
            got = set(mine[back.count(mine) > 0].tolist())
            assert got >= wanted & set(mine.tolist())
            assert bits < 63 or got == wanted & set(mine.tolist())


def thue_morse(order, first="a", second="b"):
    """Two words whose polynomial hashes modulo powers of two agree, whatever the base."""
    a, b = first, second
    for _ in range(order):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("order", [4, 10, 12, 13])
def test_words_built_to_collide_are_different(spark, order):
    one, other = thue_morse(order)
    before, after = (" ".join(f"{x}{k}" for k in range(20)) for x in "pq")
    rows = [(1, f"{before} {one} {after}"), (2, f"{before} {other} {after}")]
    got = m.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(1, 41, 0), (2, 41, 0)]


def test_windows_built_to_collide_are_different(spark):
    one, other = (" ".join("u" if c == "a" else "v" for c in w) for w in thue_morse(5))
    rows = [(1, f"s {one} t e"), (2, f"s {other} t e")]
    got = m.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (2, 0)]


def test_a_weak_first_hash_is_put_right_by_the_second(small_docs, monkeypatch):
    docs, texts = small_docs
    whole = m.window_hashes
    weak = np.uint64(0xFFFF << 48)
    monkeypatch.setattr(m, "window_hashes", lambda words, size, salt=0: whole(words, size, salt) if salt else whole(words, size) & weak)
    assert digests(m.remove_repeats(docs)) == plain.kept_words(list(texts.items()))
