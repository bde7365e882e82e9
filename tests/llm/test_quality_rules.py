from pyspark.sql import functions as F

from mullion.llm import quality_rules as m
from tests.compare import both
from tests.llm import plain


def test_measures_equal_plain_ones(small_docs):
    docs, texts = small_docs
    for r in m.judge(docs).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == plain.quality(texts[r.doc_id]), texts[r.doc_id]
        assert not (r.base_failed and r.kept)


def test_overlapping_windows_and_symbols(spark):
    rows = [(1, "a a a a"), (2, "a b c x a b c\n\na b\na b\n \n"), (3, "#*$%&|<> é#")]
    for r in m.judge(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain.quality(dict(rows)[r.doc_id])


def test_rules_and_clean_text(spark):
    clean = " ".join(f"the word{i} of thing{i} is plain{i}" for i in range(20))
    rows = [(1, clean), (2, " ".join(f"xq{i}" for i in range(80))), (3, " ".join(f"the a{i} ### $$$" for i in range(60))), (4, None)]
    got = {r.doc_id: (r.kept, tuple(r.broken)) for r in m.judge(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1] == (True, ()) and "stop_words" in got[2][1] and "symbols" in got[3][1] and not got[4][0]


def test_passing_keeps_columns_of_any_name(spark):
    clean = " ".join(f"the word{i} of thing{i} is plain{i}" for i in range(20))
    docs = spark.createDataFrame([(1, clean, 5, True), (2, "x", 6, None)], "doc_id bigint, text string, n_words int, broken boolean")
    out = m.passing(docs)
    assert out.columns == docs.columns and [r.n_words for r in out.collect()] == [5]
    assert m.passing(docs.where("false")).count() == 0


def test_one_projection_without_functions_of_ours(spark):
    plan = m.judge(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Exchange"))


def test_long_texts_are_exact(spark):
    distinct = " ".join(f"{i:x}" for i in range(400_000))
    rows = [(1, distinct), (2, distinct + " 1 2 3"), (3, " ".join(["a b"] * 30_000))]
    for r in m.judge(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        assert r.n_repeat_words == plain.quality(dict(rows)[r.doc_id])[4]


def test_windows_of_equal_hash_are_told_apart_by_their_words(spark, monkeypatch):
    """With a hash that is the same for all words, every window is a candidate."""
    monkeypatch.setattr(m, "WORD_HASH", lambda w: F.lit(7).cast("long"))
    texts = {1: "a b c d e f g", 2: "a b c x a b c y b c x", 3: "a a a a", 4: "p q"}
    for r in m.judge(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect():
        assert r.n_repeat_words == plain.quality(texts[r.doc_id])[4]


def test_verdicts_equal_sql(spark, small_docs, tmp_path):
    """All columns, verdicts too, over the given table and over texts made for each rule and its bounds."""
    docs, _ = small_docs
    clean = " ".join(f"the word{i} of thing{i} is plain{i}" for i in range(20))
    made = [clean, clean + " #" * 36, clean + " #" * 60, " ".join(f"xq{i}" for i in range(80)), "\n".join(f"- the a{i} b{i} c{i} d{i} e{i}" for i in range(12)), "\n".join(["the", clean, *["the"] * 5]), "the " + " ".join(f"{'w' * 15}{i}" for i in range(60)), "of the " * 30, " ".join(f"the {i} 77{i}" for i in range(60)), "• İ K " + clean, None]
    docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(made)], "doc_id bigint, text string")).coalesce(1).write.parquet(f"{tmp_path}/documents")
    file = next(tmp_path.glob("documents/*.parquet"))
    file.rename(tmp_path / "documents.parquet")
    for folder in (str(tmp_path), "/root/testdata/sf0.001"):
        ours, theirs = both(spark, folder, m.op6_quality_rules, m.OP6_SQL)
        assert ours == theirs and {r[2] for r in ours} == {False, True}
