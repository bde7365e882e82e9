"""Queries by a written report, with their SQL. The catalogue adds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mullion.functions.classify import failure_type
from mullion.functions.text import BLOAT_THRESHOLD, COMMENT_BLOAT_THRESHOLD, bloated
from mullion.operators import report
from mullion.plans.oracles import ORACLES as SQL
from mullion.sources import sinks
from mullion.sources.fixtures import fixture
from mullion.sources.scratch import scratch_folder


def q_report_file(spark: SparkSession, d: str) -> DataFrame:
    """The sections of the whole report, as they are read back from its parts."""
    rows = fixture(spark, d, "results").withColumn("failure_type", failure_type(F.col("pass"), F.col("err"), F.col("extraction_issue"), F.col("entry_point_found")))
    rows = rows.withColumns({"answer_channel_bloat": bloated(F.col("post_think_tokens"), BLOAT_THRESHOLD), "comment_bloat": bloated(F.col("code_comment_tokens"), COMMENT_BLOAT_THRESHOLD)})
    path = scratch_folder(spark, "report")
    sinks.write_report(report.report_sections(rows, fixture(spark, d, "problems")), "", path)
    back = sinks.read_report(spark, path)
    return back.select(F.substring_index("value", "\n", 1).alias("heading"), F.md5(F.concat("value", F.lit("\n---\n"))).alias("markdown"))


QUERIES = {"q_report_file": q_report_file}
ORACLES = {"q_report_file": f"SELECT heading, markdown FROM ({SQL['q_report_sections']}) sections"}
