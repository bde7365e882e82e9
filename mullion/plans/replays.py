"""Queries that replay two runs, with their SQL. The catalogue adds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mullion.operators import compare, replay
from mullion.plans.oracles import _PANE
from mullion.sources.fixtures import fixture

STEP = 2.5


def q_replay_frames(spark: SparkSession, d: str) -> DataFrame:
    """Free beside fsm of every task, frame by frame up to the later end."""
    made = compare.pane(F.upper("mode"), F.col("mode"), F.col("raw_response"), F.lit("gen_error: x"), F.col("completion_tokens"), F.when(F.col("ordinal") % 2 == 0, F.lit(12.5)), 40.0)
    panes = fixture(spark, d, "responses").select("task_id", "mode", made.alias("pane"))
    return replay.replay_frames(panes.where("mode = 'free'"), panes.where("mode = 'fsm'"), STEP)


def q_pane_script(spark: SparkSession, d: str) -> DataFrame:
    """The whole payload of each pane as a script holds it."""
    made = compare.pane(F.upper("mode"), F.col("mode"), F.col("raw_response"), F.lit("gen_error: x"), F.col("completion_tokens"), F.when(F.col("ordinal") % 2 == 0, F.lit(12.5)), 40.0)
    return fixture(spark, d, "responses").select("ordinal", "mode", compare.script_payload(F.struct(made["label"].alias("label"), made["total_tokens"].alias("total_tokens"), made["chunks"].alias("chunks"))).alias("payload"))


QUERIES = {f.__name__: f for f in (q_replay_frames, q_pane_script)}
ORACLES = {
    "q_replay_frames": f"""{_PANE}, both_ AS (SELECT 'P' || l.ordinal AS task_id, l.seconds AS ls, l.c AS lc, r.seconds AS rs, r.c AS rc FROM pane l JOIN pane r ON l.ordinal = r.ordinal AND l.mode = 'free' AND r.mode = 'fsm'),
frames AS (SELECT *, unnest(range(0, CAST(ceil(greatest(ls, rs) / {STEP}::DOUBLE) AS BIGINT) + 1)) AS frame FROM both_)
SELECT task_id, frame, frame * {STEP}::DOUBLE AS at,
  length(array_to_string(lc[: CAST(floor(least(1.0::DOUBLE, frame * {STEP}::DOUBLE / greatest(ls, 0.001)) * len(lc)) AS BIGINT)], '')) AS left_length,
  length(array_to_string(rc[: CAST(floor(least(1.0::DOUBLE, frame * {STEP}::DOUBLE / greatest(rs, 0.001)) * len(rc)) AS BIGINT)], '')) AS right_length
FROM frames""",
    "q_pane_script": f"{_PANE} SELECT ordinal, mode, replace(CAST(to_json(struct_pack(label := upper(mode), total_tokens := total, chunks := c)) AS VARCHAR), '</', '<\\/') AS payload FROM pane",
}
