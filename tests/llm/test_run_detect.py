import hashlib
import random
import zlib

import pytest

from mullion.llm import run_detect as m
from mullion.llm.common import word_hashes
from mullion.llm.queries import oracle_sql
from tests.compare import both


def plain_runs(words, least=6, times=4):
    """Runs by trying every period at every place."""
    found, n = [], len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(least, times * q) and not any(s <= start and s + size >= start + length for s, size, _ in found):
                found.append((start, length, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def some_words(rng, n):
    letters, out = "abcdefghij"[: rng.choice([1, 2, 2, 3, 10])], []
    while len(out) < n:
        out += [rng.choice(letters) for _ in range(rng.randint(1, 12))] * rng.randint(1, 9) if rng.random() < 0.6 else [rng.choice("klmnopq") for _ in range(rng.randint(1, 9))]
    return [w.encode() for w in out[:n]]


def test_query_equals_its_sql(spark):
    ours, theirs = both(spark, "/root/testdata/sf0.001", m.op13_run_detect, oracle_sql()["op13_run_detect"])
    assert ours == theirs


def test_random_words():
    rng = random.Random(8)
    for _ in range(1500):
        words = some_words(rng, rng.randint(0, 130))
        want = plain_runs(words)
        assert m.runs_of(words) == want
        apart = [(a + s, n, q) for _, a, b in m.stretches(*word_hashes([b" ".join(words)])) for s, n, q in m.runs_of(words[a:b])]
        assert sorted(apart, key=lambda r: (r[0], r[2])) == want


@pytest.mark.parametrize(("least", "times"), [(2, 2), (3, 3), (6, 4)])
def test_other_bounds(least, times):
    rng = random.Random(9)
    for _ in range(300):
        words = some_words(rng, rng.randint(0, 60))
        assert m.runs_of(words, least, times) == plain_runs(words, least, times)


def test_hashes_that_always_agree_change_nothing(monkeypatch):
    rng = random.Random(10)
    monkeypatch.setattr(m.Stretch, "alike", lambda self, i, j, n: (n + i) % 3 != 1 or self.words[i : i + n] == self.words[j : j + n])
    for _ in range(200):
        words = some_words(rng, rng.randint(0, 60))
        assert m.runs_of(words) == plain_runs(words)


def test_long_texts_in_linear_time():
    fibonacci = [b"a"], [b"a", b"b"]
    while len(fibonacci[1]) < 60_000:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    assert m.runs_of(fibonacci[1]) == []  # its repetitions stay below four periods
    assert m.runs_of([b"a"] * 100_000) == [(0, 100_000, 1)]
    assert m.runs_of([b"%d" % (i % 7001) for i in range(100_000)]) == [(0, 100_000, 7001)]


def test_table_of_texts(spark):
    rng = random.Random(12)
    texts = [None, "", " \n", "a " * 5, "a " * 6, "x\x1ca " * 9, "a b " * 4, "a b " * 3 + "a", "l é\n" * 30 + "l é n o " * 5, "A a " * 40]
    texts += [b" ".join(some_words(rng, rng.randint(1, 300))).decode() for _ in range(60)] + [" ".join(f"w{i % 9000}" for i in range(90_000))]
    rows = [(i if i % 7 else None, t, 1, "r") for i, t in enumerate(texts)] + [(3, texts[4], 1, "r")] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start int, runs string").repartition(5)

    def plain(i, text):
        words = (text or "").encode().split()
        runs = plain_runs(words) if len(words) < 1000 else [(0, 90_000, 9000)]
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        return (i if i is not None else -1, len(words), tuple(runs), b" ".join(w for k, w in enumerate(words) if k not in gone))

    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, tuple(tuple(x) for x in r.runs), bytes(r.collapsed)) for r in m.find_runs(docs).collect())
    assert got == sorted(plain(*r[:2]) for r in rows)
    assert m.find_runs(docs.where("false")).count() == 0


def test_query_in_plain_python(spark, tmp_path):
    rng = random.Random(13)
    rows = [(i, " ".join(rng.choice(["one", "Two", "thrée", "four", "5"]) + str(rng.randint(0, 9)) for _ in range(rng.randint(0, 80)))) for i in range(400)] + [(401, None), (402, "\t"), (None, "a a a a a a a b")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, text in rows:
        words, h = (text or "").encode().split(), zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if i is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = plain_runs(words)
        best = min(((-size, s, q) for s, size, q in runs), default=None)
        gone = {k for s, size, q in runs for k in range(s + q, s + size)}
        digest = lambda b: hashlib.sha256(b).hexdigest()
        want[i] = (len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4), digest("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()), digest(b" ".join(w for k, w in enumerate(words) if k not in gone)))
    assert {r.doc_id: tuple(r)[1:] for r in m.op13_run_detect(spark, str(tmp_path)).collect()} == want
    assert sum(v[0] > 0 for v in want.values()) > 10
