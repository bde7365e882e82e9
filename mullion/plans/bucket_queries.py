"""Queries over buckets of any size, with their SQL. The catalogue adds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mullion.operators import buckets
from mullion.plans.oracles import _RES, _W, _overlap
from mullion.sources.fixtures import fixture


def q_bucket_lines(spark: SparkSession, d: str) -> DataFrame:
    """The console lines of both checks."""
    return buckets.head_lines(buckets.bucket_heads(buckets.members(fixture(spark, d, "results")))).select("check", F.col("bucket_ix").cast("bigint").alias("bucket_ix"), "line")


def q_bucket_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Every member of every bucket with its rank and page of a hundred."""
    return buckets.ranked(buckets.members(fixture(spark, d, "results")), page=100)


QUERIES = {f.__name__: f for f in (q_bucket_lines, q_bucket_ranks)}

_NAMES = {"free_vs_fsm": ("both_pass", "both_fail", "fsm_only_pass", "free_only_pass"), "prompt_terse_checks": ("all_pass", "all_fail", "prompt_terse_only_pass", "prompt_terse_only_fail", "prompt_terse_matches_free_not_fsm", "prompt_terse_matches_fsm_not_free")}
_IX = "CASE bucket " + " ".join(f"WHEN '{b}' THEN {k}" for names in _NAMES.values() for k, b in enumerate(names)) + " END"
_ALL = f"SELECT * FROM ({_overlap('free_vs_fsm')}) UNION ALL SELECT * FROM ({_overlap('prompt_terse_checks')})"
ORACLES = {
    "q_bucket_lines": f"""{_RES}, {_W.format(src='r')}, o AS ({_ALL}), l AS (SELECT *, CASE WHEN task_ids = '' THEN [] ELSE string_split(task_ids, ',') END AS ids FROM o)
SELECT "check", CAST({_IX} AS BIGINT) AS bucket_ix, rpad(bucket, CASE WHEN "check" = 'free_vs_fsm' THEN 18 ELSE 34 END, ' ') || ' ' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INTEGER), ' ') || '  ' ||
  CASE WHEN n = 0 THEN '-' ELSE array_to_string(ids[:16], ', ') || CASE WHEN n > 16 THEN ', ... (+' || (n - 16) || ')' ELSE '' END END AS line FROM l""",
    "q_bucket_ranks": f"""{_RES}, {_W.format(src='r')}, o AS ({_ALL}), l AS (SELECT *, string_split(task_ids, ',') AS ids FROM o WHERE n > 0)
SELECT "check", bucket, rank, (rank - 1) // 100 AS page, ids[rank] AS task_id FROM l, unnest(range(1, n + 1)) AS u(rank)""",
}
