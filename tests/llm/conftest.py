import random

import pytest

DOCS = "doc_id bigint, lang string, source string, text string, n_chars bigint, ids int, `key` string, cluster string"


@pytest.fixture(scope="session")
def small_docs(spark):
    """Copies, near copies, shared passages, short, empty, null and long texts; extra columns with clashing names."""
    rng = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "Re", "su", "té") for b in ("n", "r", "s", "t", "la", "mo", "vi")]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = [None, "", "  \n\t", "one", "one", "One two", "one two three four", "a b c d e", "A  b\nc d E", "a b c d e f", "x\x1cy \xa0z"]
    passage = some(60)
    for _ in range(12):
        base = some(rng.randint(60, 140))
        texts += [" ".join(base)] * rng.randint(1, 4)
        for _ in range(4):
            near = list(base)
            for _ in range(rng.randint(0, 6)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            if rng.random() < 0.4:
                near.insert(rng.randrange(len(near)), "extra")
            texts.append(" ".join(near))
    for _ in range(10):
        own = some(40)
        texts.append(" ".join(own[:20] + passage[rng.randint(0, 10) :] + own[20:]))
    texts += [" ".join(some(30) * 4), "w " * 200, " ".join(some(20_000)), "\n".join([" ".join(some(8))] * 30)]
    rows = [(i, "en", "s", t, len(t or ""), 7, "k", "c") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(5), dict(enumerate(texts))
