"""Queries by a results file and its index, with their SQL. The catalogue adds them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mullion.operators.aggregate import results_wide
from mullion.sources import fixtures as fx
from mullion.sources.result_index import build_index, find_result
from mullion.sources.scratch import scratch_folder
from mullion.sources.sinks import write_results

ASKED = (("P0", "free"), ("P8", "fsm"), ("P100", "prompt_terse"), ("P150", "fsm"))


def q_indexed_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Some results out of the file of all, each by the index beside it."""
    path = scratch_folder(spark, "results")
    rows = fx.fixture(spark, d, "results").select("ordinal", "task_id", "mode", "pass", "err", "think_tokens", "total_tokens", "extraction_issue")
    write_results(results_wide(rows), path)
    build_index(spark, path)
    return reduce(DataFrame.unionByName, [find_result(spark, path, *a).select("task_id", "mode", "pass", "err", F.col("total_tokens"), "extraction_issue") for a in ASKED])


QUERIES = {"q_indexed_lookup": q_indexed_lookup}
ORACLES = {
    "q_indexed_lookup": f"WITH r AS ({fx.RESULTS}) SELECT task_id, mode, pass, err, total_tokens, extraction_issue FROM r WHERE (task_id, mode) IN ({', '.join(f'({t!r}, {m!r})' for t, m in ASKED)})",
}
