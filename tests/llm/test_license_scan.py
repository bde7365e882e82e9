import random

from mullion.llm import license_scan as m


def common(a, b):
    """The length of a longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_is_in_order_and_no_longer_than_the_best():
    rng = random.Random(7)
    for _ in range(400):
        a, b = ([b"%d" % rng.randrange(12) for _ in range(rng.randint(0, 25))] for _ in range(2))
        pairs = m.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(set(pairs))
        assert all(x < i and y < j for (x, y), (i, j) in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) <= common(a, b)


def test_alignment_of_distinct_words_is_best():
    rng = random.Random(8)
    for _ in range(200):
        a, b = ([b"%d" % x for x in rng.sample(range(30), rng.randint(1, 25))] for _ in range(2))
        assert len(m.align(a, b)) == common(a, b)


def test_increasing():
    assert [[5, 1, 4, 2, 3][i] for i in m.increasing([5, 1, 4, 2, 3])] == [1, 2, 3] and m.increasing([]) == []


def test_every_template_is_found_whole_and_edited():
    scanner = m.Scanner()
    filler = "the quick of and to in a is that for it as was with be by on not he at but are " * 3
    for name, text in m.TEMPLATES.items():
        found = scanner.scan(f"{filler}{text} {filler}\n{text.upper()}".encode())
        assert [f.license for f in found] == [name, name] and all(f.coverage == 1 for f in found), name
    assert scanner.scan(filler.encode()) == [] and scanner.scan(b"") == []


def plain_finds(text, templates, least):
    """Every template aligned at every place of the text; the best of what overlaps."""
    words, found = m.fold(text.encode()), set()
    for name, body in templates.items():
        t = m.fold(body.encode())
        slack = max(2, len(t) // 5)
        for p in range(len(words)):
            lo = max(0, p - slack)
            pairs = m.align(words[lo : p + len(t) + slack], t)
            if pairs and len(pairs) >= least * len(t):
                found.add((len(pairs) / len(t), len(pairs), name, lo + pairs[0][0], lo + pairs[-1][0] + 1))
    out = []
    for c, n, name, a, b in sorted(found, key=lambda f: (-f[0], -f[1], *f[2:])):
        if all(b <= x or y <= a for *_, x, y in out):
            out.append((c, n, name, a, b))
    return sorted((a, b, name) for _, _, name, a, b in out)


def test_equals_every_template_at_every_place():
    """Whichever words were changed, dropped or put in: no notice over the threshold is missed."""
    rng = random.Random(5)
    scanner = m.Scanner()
    hits = 0
    for name, body in m.TEMPLATES.items():
        for _ in range(2 if len(body) > 500 else 6):
            words = body.split()
            for _ in range(rng.randint(0, max(1, len(words) // 5))):
                k = rng.randrange(len(words))
                words[k : k + 1] = rng.choice([["changed"], [], [words[k], "more"], ["the"]])
            text = " ".join([*rng.choices(["the", "of", "license", "software", "x"], k=rng.randint(0, 12)), *words, *rng.choices(["under", "a", "version", "y"], k=rng.randint(0, 12))])
            got = [(f.start, f.stop, f.license) for f in scanner.scan(text.encode())]
            assert got == plain_finds(text, m.TEMPLATES, m.LEAST_COVERAGE)
            hits += len(got)
    assert hits > 40


def test_notices_with_their_rarest_words_changed_are_found():
    scanner = m.Scanner()
    for name in ("MIT-text", "GPL-text", "BSD-text", "ISC-text", "MPL-2.0", "AGPL-3.0", "LGPL-3.0"):
        t = next(t for t in scanner.templates if t.name == name)
        rare = sorted(t.counts, key=lambda w: (sum(w in o.counts for o in scanner.templates), -len(w), w))[: (len(t.words) - t.need)]
        gone, words = 0, []
        for w in t.words:
            change = w in rare and gone < len(t.words) - t.need
            gone += change
            words.append("changed" if change else w.decode())
        assert [f.coverage >= m.LEAST_COVERAGE for f in scanner.scan(" ".join(words).encode())] == [True], name


def test_very_long_text():
    text = ("the work is licensed of version 3 " * 30_000) + m.TEMPLATES["AGPL-3.0"]
    assert m.Scanner().scan(text.encode())[-1].license == "AGPL-3.0"


def test_common_is_the_longest_common_subsequence():
    rng = random.Random(9)
    t = next(t for t in m.Scanner().templates if t.name == "MIT-full")
    for _ in range(40):
        window = [rng.randrange(-5, len(t.counts)) if rng.random() < 0.5 else t.coded[k] for k in range(rng.randint(0, len(t.coded)))]
        assert t.common(window) == common(window, t.coded)


def test_work_on_license_like_texts_is_bounded(monkeypatch):
    """10 MB of one notice, and as many words drawn from one: neither is aligned place by place."""
    made = []
    monkeypatch.setattr(m, "align", lambda a, b, real=m.align: made.append(1) or real(a, b))
    notice = m.TEMPLATES["MIT-full"]
    copies = 10_000_000 // len(notice)
    assert [f.license for f in m.Scanner().scan(f"{notice}\n".encode() * copies)] == ["MIT-full"] * copies and len(made) < 2_000
    made.clear()
    drawn = random.Random(11).choices(m.fold(notice.encode()), k=100_000)
    assert m.Scanner().scan(b" ".join(drawn)) == [] and not made


def test_piles_of_notices_equal_every_template_at_every_place(monkeypatch):
    rng = random.Random(12)
    monkeypatch.setattr(m, "HELD_BYTES", 5_000)
    names = ("MIT-full", "MIT-text", "ISC-text", "GPL-3.0", "AGPL-3.0", "CC-BY-4.0")
    few = {k: m.TEMPLATES[k] for k in names}
    scanner = m.Scanner(few)
    for _ in range(4):
        words = [w for k in rng.choices(names, k=7) for w in few[k].split() if rng.random() > 0.05]
        text = " ".join(words)
        assert [(f.start, f.stop, f.license) for f in scanner.scan(text.encode())] == plain_finds(text, few, m.LEAST_COVERAGE)


def test_query_finds_all_notices(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    found = {r.doc_id for r in m.op7_license_scan(spark, "/root/testdata/sf0.01").collect()}
    assert found == {i for i, t in docs.items() if "License" in t or "icensed under" in t}


def test_tables(spark, small_docs):
    docs = spark.createDataFrame([(None, "Released under the MIT License.", 1), (1, None, 2), (2, "Released under the MIT License.", 3), (2, "Released under the MIT License.", 3)], "doc_id bigint, text string, start int")
    assert sorted((r.doc_id or 0, r.license, r.coverage) for r in m.scan_licenses(docs).collect()) == [(0, "MIT", 1.0), (2, "MIT", 1.0), (2, "MIT", 1.0)]
    assert m.scan_licenses(docs.where("false")).count() == 0 and m.scan_licenses(small_docs[0]).count() == 0
