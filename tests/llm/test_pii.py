import random
import re
import time

from mullion.llm import pii as m
from tests.llm import plain

ODD = [
    None, "", "a@b.c%d@e.fg x@y.z", "1.2.3.4.5.6.7.8 256.1.1.1 0001.0.0.255", "4111 1111 1111 1111--4111-1111-1111-1111", "é😀 a@b.co 😀 1.1.1.1",
    "+1 (743) 555-3824 +44 20 7946 0958", "a@b..c@d.e a@b.c..d@e.f", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0", "99999999999999999999.1.1.1", "1" * 5000, "a@b" + ".c" * 5000,
    "+1" * 2000, ". ".join(["1.1.1.1"] * 1500), "a" * 3000 + "@x.y", "0 4111 1111 1111 1111",
]


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab@.%-+ 0123459()\n😀é") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    for r in m.find_pii(docs).collect():
        assert [(s.start, s.rank - 1, s.stop, s.kind) for s in r.base] == plain.base_spans(texts[r.doc_id]), texts[r.doc_id]
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}


def test_query(spark):
    rows = m.op3_pii(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and all(len(r.base_sha256) == 64 for r in rows)


def test_reliabilities_and_classifier():
    rng = random.Random(1)
    counts: dict = {}
    truth = {}
    for _ in range(4000):
        real = rng.random() < 0.4
        votes = tuple((1 if real else -1) if rng.random() < p else rng.choice((-1, 0, 1)) for p in (0.9, 0.7, 0.5, 0.3))
        counts[votes] = counts.get(votes, 0) + 1
        truth.setdefault(votes, []).append(real)
    table = sorted(("card", v, n) for v, n in counts.items())
    post, reliability, rate = m.estimate(table)
    assert abs(rate["card"] - 0.4) < 0.05
    assert reliability[0, 1, 2] > reliability[3, 1, 2]
    right = sum(sum(x == (p > 0.5) for x in truth[v]) for (_, v, _), p in zip(table, post, strict=True))
    assert right / 4000 > 0.93
    assert len(m.train(table)) == 1 + len(m.KINDS) + 2 * len(m.LABELERS) and m.train([]) == [0.0] * (1 + len(m.KINDS) + 2 * len(m.LABELERS))


def test_added_spans_and_clean_text(spark):
    secret = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [(i, f'some words token = "{secret[i:] + secret[:i]}" here') for i in range(30)] + [(100 + i, f"clean words of text number {i}, version 1.2 of 2024-01-02") for i in range(30)]
    got = {r.doc_id: [s.kind for s in r.spans] for r in m.find_pii(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[i] == ["secret"] for i in range(30)) and not any(got[100 + i] for i in range(30))


def test_short_and_long_secrets_are_candidates(spark):
    body = "a1b2c3d4e5f6g7h8i9j"
    said = [p + body[:n] for p in ("sk-", "ghp_", "xoxb-", "AKIA") for n in (16, 17, 19)] + ["24be64439e3e49cf" * 9, "sk-" + body * 8]
    rows = list(enumerate(f"é token = {x} here" for x in said))
    got = {r.doc_id: [(c.start, c.stop) for c in r.found if c.kind == "secret"] for r in m.candidates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: [(10, 10 + len(x))] for i, x in enumerate(said)}


def test_short_secrets_are_redacted(spark):
    secret = "a1b2c3d4e5f6g7h8"
    rows = [(i, f'some words token = "sk-{secret[i % 16:] + secret[:i % 16]}" here') for i in range(30)]
    assert {r.text for r in m.redact(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == {'some words token = "[SECRET]" here'}


def test_redact_keeps_columns(spark):
    schema = "doc_id bigint, text string, found string, votes int"
    rows = [(1, "é mail a@b.co, then 1.2.3.4!", "x", 1), (2, None, "y", 2), (3, "nothing here", None, 3), (4, "a@1.2.3.4", "z", 4)]
    out = m.redact(spark.createDataFrame(rows, schema))
    assert out.columns == ["doc_id", "text", "found", "votes"]
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {1: "é mail [EMAIL], then [IP]!", 2: None, 3: "nothing here", 4: "[EMAIL]"}
    assert m.redact(spark.createDataFrame([], schema)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = m.candidates(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_redact_equals_a_plain_version(spark, monkeypatch):
    """Pieces and blocks of any size, overlapping spans, code points of two units, and spans by the thousand."""
    rng = random.Random(4)
    bits = ["a@b.co", "a@1.2.3.4", "é😀", " ", "+1 (743) 555-3824", "4111 1111 1111 1111", "token = sk-a1b2c3d4e5f6g7h8", "x" * 9, "\n"]
    texts = [None, "", "x", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(80)), " ".join(["é a@b.co"] * 1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    weights = m.train(m.vote_counts(m.candidates(docs)))
    spans = {r.doc_id: [(x.start, x.rank, x.stop, x.kind) for x in r.spans] for r in m.find_pii(docs, weights=weights).collect()}
    for sizes in ((8192, 256), (7, 2)):
        for name, size in zip(("PIECE", "BLOCK"), sizes, strict=True):
            monkeypatch.setattr(m, name, size)
        some = docs if sizes[0] > 7 else docs.where("length(text) < 5000")
        got = {r.doc_id: r.text for r in m.redact(some, weights=weights).collect()}
        assert got == {i: None if texts[i] is None else plain.redacted(texts[i], spans[i]) for i in got}


def test_many_spans_in_a_long_text(spark):
    rows = [(1, " ".join(f"person{i}@example.com" for i in range(10_000)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    began = time.monotonic()
    assert m.redact(docs).first().text == " ".join(["[EMAIL]"] * 10_000)
    assert time.monotonic() - began < 30


def added(text, votes_of):
    """What the added kinds' candidates are, by plain patterns."""
    return [(x.start(), x.end(), kind) for kind, pattern in votes_of.items() for x in re.finditer(pattern, text)]


def test_added_candidates_equal_plain_patterns(spark):
    plain_patterns = {
        "spelled_email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[a-z0-9-]{1,63} ?(?:\(dot\)|\[dot\]| dot ) ?[a-z]{2,10}(?![a-z])",
        "name": rf"(?<![^\W\d_])(?:{'|'.join(m.GIVEN_NAMES)}) [A-Z][a-z]{{2,20}}(?![^\W\d_])",
    }
    texts = ["write john.doe (at) mail (dot) com now", "a.b[at]c[dot]org, x at y dot net", "look at the dot com", "Mary Smith and Peter Schmidt met Anna Street", "xMary Smith", "Karen O", "James Universityx", "é Paul Meyer."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in m.candidates(docs).collect():
        got = sorted((c.start, c.stop, c.kind) for c in r.found if c.kind in plain_patterns)
        assert got == sorted(added(texts[r.doc_id], plain_patterns)), texts[r.doc_id]


def test_labelers_of_added_kinds_say_no_as_well(spark):
    texts = {1: "Mary Smith", 2: "Anna Street", 3: "Peter Brown University", 4: "John was", 5: "jane.roe (at) mail (dot) org", 6: "look at the dot com"}
    docs = spark.createDataFrame([(i, f"so {t} is") for i, t in texts.items()], "doc_id bigint, text string")
    votes = {r.doc_id: [tuple(c.votes[:2]) for c in r.found] for r in m.candidates(docs).collect()}
    assert votes[1] == [(1, 1)] and votes[2] == [(-1, -1)] and votes[3][0][0] == -1 and votes[4] == []
    assert votes[5][0][0] == 1 and votes[6][0][0] == -1
