"""The pipeline against plain versions of its stages."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from mullion.llm import pii
from mullion.llm.quality_rules import OP6_SQL
from tests.compare import duck
from tests.llm import plain

SF = "/root/testdata/sf0.001"


def split(text):
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def leaky(text, items):
    """Whether some stretch of an item agrees with the text along some diagonal in three quarters of its words."""
    own = split(text)
    places = defaultdict(list)
    for p, w in enumerate(own):
        places[w].append(p)
    for item in items:
        size = min(16, len(item))
        met = Counter(p - k for k, w in enumerate(item) for p in places.get(w, ()))
        for d in (d for d, n in met.items() if 100 * n >= 75 * size):
            same = [0 <= d + k < len(own) and own[d + k] == w for k, w in enumerate(item)]
            if any(sum(same[s : s + size]) * 100 >= 75 * size for s in range(len(item) - size + 1)):
                return True
    return False


def test_run_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    broken = {i for i, kept in duck(SF).execute(f"SELECT doc_id, kept FROM ({OP6_SQL}) x").fetchall() if not kept}
    assert all(plain.quality(texts[i])[-1] is False for i in texts if i not in broken)
    left = {i: t for i, t in texts.items() if i not in broken}
    left = {i: left[i] for i, (_, c) in plain.components(list(left.items())).items() if i == c}
    items = [split(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {i: t for i, t in left.items() if not leaky(t, items)}
    spans = {r.doc_id: [(x.start, x.rank, x.stop, x.kind) for x in r.spans] for r in pii.find_pii(docs.where(docs.doc_id.isin(*left))).collect()}
    # base spans are those of the plain patterns; what the classifier adds is its own to say
    assert all({(a, b, kind) for a, _, b, kind in plain.base_spans(t)} <= {(a, b, kind) for a, _, b, kind in spans[i]} for i, t in left.items())
    clean = {i: plain.redacted(t, spans[i]) for i, t in left.items()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert {i: r.text for i, r in got.items()} == clean
    assert all(r.n_tokens == len(r.ids) and r.n_chars == len(r.text) for r in got.values())
    for i, r in got.items():
        assert not plain.base_spans(r.text), i


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name


def test_stages_with_clashing_names_and_a_long_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = spark.createDataFrame([(10**9, " ".join(f"w{k * k % 9973} of the" for k in range(30_000)))], "doc_id bigint, text string")
    docs = docs.unionByName(long, allowMissingColumns=True)
    for c in ("__doc", "__key", "__gone", "__row", "__alike", "ids", "row", "key"):
        docs = docs.withColumn(c, docs.doc_id % 7)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        rows = out.select("doc_id", "__doc", "__gone", "ids").collect()
        assert out.columns == docs.columns and rows and all(r[1] == r[2] == r[3] == r[0] % 7 for r in rows), name


def test_stages_of_empty_and_null_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    nulls = spark.createDataFrame([(None,) * len(docs.columns)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0, name
        assert stage(spark, nulls, SF).count() in (0, 1), name
