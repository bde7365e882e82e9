from pyspark.sql import functions as F

from mullion.operators import aggregate as a
from mullion.operators import buckets, report
from mullion.plans.catalogue import results

SF = "/root/testdata/sf0.001"


def test_lines_and_ranks_equal_the_lists(spark):
    rows = results(spark, SF)
    whole = a.outcome_breakdown(rows)
    lines = lambda df: sorted(tuple(r) for r in df.collect())
    assert lines(buckets.head_lines(buckets.bucket_heads(buckets.members(rows)))) == lines(report.breakdown_lines(whole))
    got = buckets.ranked(buckets.members(rows), page=7).collect()
    assert all(r.page == (r["rank"] - 1) // 7 for r in got)
    want = {(r.check, r.bucket, k + 1): t for r in whole.collect() for k, t in enumerate(r.task_ids)}
    assert {(r.check, r.bucket, r["rank"]): r.task_id for r in got} == want


def test_a_million_tasks_in_a_bucket(spark):
    n = 1_000_000
    rows = spark.range(n).select(F.when(F.col("id") >= 0, "free_vs_fsm").alias("check"), F.when(F.col("id") >= 0, "both_pass").alias("bucket"), (n - F.col("id")).alias("ordinal"), F.concat(F.lit("t"), n - F.col("id")).alias("task_id"))
    heads = buckets.bucket_heads(rows)
    assert [len(r.ids) for r in heads.collect() if r.bucket == "both_pass"] == [16]
    assert "t16, ... (+999984)" in [r.line for r in buckets.head_lines(heads).collect() if r.bucket_ix == 0][0]
    plan = heads._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan  # limited before the shuffle
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        r = buckets.ranked(rows)
        assert r.agg(F.count_if(F.concat(F.lit("t"), F.col("rank")) == F.col("task_id")), F.max("page"), F.countDistinct("rank")).first()[:] == (n, 999, n)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_members(spark):
    rows = buckets.members(results(spark, SF).where("false"))
    assert buckets.bucket_heads(rows).count() == 0 and buckets.ranked(rows).count() == 0
