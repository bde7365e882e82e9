import math
import random

import numpy as np
import pytest

from mullion.llm import vector_codes as m
from mullion.llm.queries import oracle_sql
from tests.compare import both

VECTORS = "vec_id bigint, embedding array<float>, label int, code string, error string, whole int, sums string"


def plain_codes(rows, parts, entries, rounds):
    """Lloyd's algorithm with a full scan in Python's whole numbers: [(vec_id, label, code, error)] and codebooks."""
    kept = [(i, [math.floor(4096 * float(x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for k in range(rounds + 1):
        codes = [[min(range(len(books[p])), key=lambda e: (far(v[p], books[p][e]), e)) for p in range(parts)] for v in cut]
        if k < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    own = [v[p] for v, c in zip(cut, codes, strict=True) if c[p] == e]
                    if own:
                        books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [(i, label, "".join(f"{x:02x}" for x in c), sum(far(v[p], books[p][c[p]]) for p in range(parts))) for (i, _, label), v, c in zip(kept, cut, codes, strict=True)], books


def frame(spark, rows, n=4):
    return spark.createDataFrame([(*r, "c", "e", 1, "s") for r in rows], VECTORS).repartition(n)


def told(df):
    order = lambda r: (r[0] is None, r[0] or 0, str(r[1:]))
    return sorted(((r.vec_id, r.label, bytes(r.code).hex(), r.error) for r in df.collect()), key=order)


def check(spark, rows, parts=2, entries=4, rounds=3, n=4):
    order = lambda r: (r[0] is None, r[0] or 0, str(r[1:]))
    coded, books, scans = m.compress(frame(spark, rows, n), parts=parts, entries=entries, rounds=rounds)
    want, plain_books = plain_codes(rows, parts, entries, rounds)
    assert books.tolist() == plain_books
    assert told(coded) == sorted(want, key=order)
    return scans


def test_query_equals_its_sql(spark):
    ours, theirs = both(spark, "/root/testdata/sf0.001", m.op12_vector_codes, oracle_sql()["op12_vector_codes"])
    assert ours == theirs


def test_few_distinct_values_make_many_ties(spark):
    rng = random.Random(2)
    rows = [(i, [rng.randint(-3, 3) / 4096 for _ in range(6)], rng.randint(0, 2)) for i in range(150)]
    check(spark, rows, parts=3, entries=5, rounds=6)


def test_bounds_save_scans_in_clusters(spark):
    rng = random.Random(3)
    rows = [(i, [float(np.float32(10.0 * (i % 4) * (-1) ** k + rng.random())) for k in range(4)], 0) for i in range(200)]
    scans = check(spark, rows, rounds=4)
    assert scans[0] == 400 and max(scans[2:]) < 100


def test_dropped_null_and_repeated_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [0.25, -0.5, 1.0, 2.0]
    rows = [(None, v, None), (3, v, None), (3, v, 1), (3, [1.0, 2.0, 3.0, -4.0], 1), (1, None, 1), (2, [nan, 1.0, 2.0, 3.0], 1), (4, [1.0, None, 2.0, 3.0], 1), (5, [1.0, -inf, 2.0, 3.0], 2), (6, [-0.0001, 0.0, -0.0, 0.0001], 2)]
    check(spark, rows)
    check(spark, rows[:3])
    assert m.compress(frame(spark, rows).where("vec_id in (1, 2)"), parts=2)[0].count() == 0
    assert m.compress(frame(spark, rows).where("false"))[0].count() == 0


def test_label_error_with_null_labels(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, [float(np.float32(rng.random())) for _ in range(4)], rng.choice([None, 1, 2])) for i in range(60)]
    for limit in (m.BROADCAST_LABELS, 0):
        monkeypatch.setattr(m, "BROADCAST_LABELS", limit)
        got = m.with_label_error(m.compress(frame(spark, rows), parts=2, entries=4, rounds=2)[0]).collect()
        sums = {}
        for r in got:
            sums[r.label] = sums.get(r.label, 0) + r.error
        assert len(got) == 60 and all(r.label_error == sums[r.label] for r in got)


def test_what_has_no_codes_is_an_error(spark):
    for rows, said in (([(1, [1.0, 2.0], 0), (2, [1.0, 2.0, 3.0, 4.0], 0)], "one length"), ([(1, [1.0, 2.0, 3.0], 0)], "divisible"), ([(1, [], 0)], "one length"), ([(1, [4e5, 0.0], 0)], "too large")):
        with pytest.raises(ValueError, match=said):
            m.compress(frame(spark, rows), parts=2)


def test_bounds_hold_after_any_step():
    """A code that bounds keep is the one that a full scan finds."""
    rng = np.random.default_rng(6)
    x, book = rng.integers(-50, 50, (500, 3)), rng.integers(-50, 50, (6, 3))
    code, upper, lower = m.scan(x, book)
    for k in range(8):
        moved = book + rng.integers(-4, 5, book.shape) * (k % 3 > 0)
        steps = m.outward(np.sqrt(((moved - book) ** 2).sum(1)), True)
        m.assign(x, moved, steps, code, upper, lower)
        far = m.squared(x, moved)
        assert (code == far.argmin(1)).all()
        assert (upper**2 >= far[np.arange(500), code]).all()
        others = far.astype(float)
        others[np.arange(500), code] = np.inf
        assert (np.maximum(lower, 0) ** 2 <= others.min(1)).all()
        book = moved
