"""Queries that run whole tables through a stream, with their SQL. The catalogue adds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mullion.sources import fixtures as fx
from mullion.sources.scratch import scratch_folder
from mullion.streaming import overlap

#: Event time counts ordinals as seconds from here on: Spark's first watermark is 1970, so what happened then is late.
BEGIN = 1_735_689_600
#: Seconds of event time after which a task is given up in q_stream_missing.
PATIENCE = 100


def _results(spark: SparkSession, d: str) -> DataFrame:
    return fx.fixture(spark, d, "results").select("ordinal", "task_id", "mode", "pass", F.timestamp_seconds(F.col("ordinal") + BEGIN).alias("at"))


def q_stream_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The bucket of each task and check, told by a stream that gets all results in several batches, a third of them twice."""
    rows = _results(spark, d)
    again = rows.where(F.col("mode") == "fsm")
    out = overlap.replay(rows.unionByName(again).repartition(4), scratch_folder(spark, "overlap"), late="1000 days", files_per_trigger=2)
    return overlap.told(out).select("ordinal", "task_id", "check", "bucket")


def q_stream_missing(spark: SparkSession, d: str) -> DataFrame:
    """Tasks that a stream gave up, with the modes that hadn't come; what came within the patience of the last event still waits."""
    out = overlap.replay(_results(spark, d), scratch_folder(spark, "missing"), patience=f"{PATIENCE} seconds", late="0 seconds", files_per_trigger=1000)
    return overlap.missing(out).select("ordinal", "task_id", F.array_join("missing", ",").alias("missing"))


QUERIES = {f.__name__: f for f in (q_stream_overlap, q_stream_missing)}

_W = f"""WITH r AS ({fx.RESULTS}),
w AS (SELECT ordinal, task_id, bool_or(pass) FILTER (mode = 'free') AS f, bool_or(pass) FILTER (mode = 'fsm') AS s, bool_or(pass) FILTER (mode = 'prompt_terse') AS t FROM r GROUP BY ordinal, task_id)"""
ORACLES = {
    "q_stream_overlap": f"""{_W}
SELECT ordinal, task_id, 'free_vs_fsm' AS "check", CASE WHEN f AND s THEN 'both_pass' WHEN f THEN 'free_only_pass' WHEN s THEN 'fsm_only_pass' ELSE 'both_fail' END AS bucket
FROM w WHERE f IS NOT NULL AND s IS NOT NULL
UNION ALL SELECT ordinal, task_id, 'prompt_terse_checks', CASE WHEN f = s THEN CASE WHEN t = f THEN CASE WHEN t THEN 'all_pass' ELSE 'all_fail' END WHEN t THEN 'prompt_terse_only_pass' ELSE 'prompt_terse_only_fail' END
  WHEN t = f THEN 'prompt_terse_matches_free_not_fsm' ELSE 'prompt_terse_matches_fsm_not_free' END
FROM w WHERE f IS NOT NULL AND s IS NOT NULL AND t IS NOT NULL""",
    "q_stream_missing": f"""{_W}
SELECT ordinal, task_id, concat_ws(',', CASE WHEN f IS NULL THEN 'free' END, CASE WHEN s IS NULL THEN 'fsm' END, CASE WHEN t IS NULL THEN 'prompt_terse' END) AS missing
FROM w WHERE (f IS NULL OR s IS NULL OR t IS NULL) AND ordinal + {PATIENCE} <= (SELECT max(ordinal) FROM r)""",
}
