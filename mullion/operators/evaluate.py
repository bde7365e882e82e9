"""A whole run: responses join their problems, are scored and tested, and become results, a summary and a report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mullion.operators import aggregate, report, sandbox, verdicts
from mullion.operators.scoring import TESTS, mode_dimension, score, with_tests, with_verdict
from mullion.sources import sinks
from mullion.sources.problems import require_rows
from mullion.sources.scratch import scratch_folder


def scored(responses: DataFrame, problems: DataFrame, **thresholds: int) -> DataFrame:
    """score() of responses, with the whole code, as a table in the shared folder: extraction runs once, for tests and results."""
    spark = responses.sparkSession
    rows = score(responses, require_rows(problems), whole_code=True, **thresholds)
    own = [c for c in TESTS if c in responses.columns]
    rows = rows.select("ordinal", "task_id", "mode", *[f.name for f in aggregate_columns(rows)], "full_extracted_code", "entry_point", "test_kind", *own)
    path = scratch_folder(spark, "scored")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def programs(rows: DataFrame, problems: DataFrame) -> DataFrame:
    """What there is to run of scored(): the code of each response that has one, with its problem's tests, which join no other."""
    found = rows.where(~F.col("extraction_method").isin("empty", "not_run")).withColumn("code", F.col("full_extracted_code"))
    return with_tests(found.select("task_id", "mode", "entry_point", "test_kind", "code", *[c for c in TESTS if c in rows.columns]), problems)


def run_programs(rows: DataFrame, timeout: float = sandbox.TIMEOUT, known: str | None = None) -> DataFrame:
    """(task_id, mode, pass, err) of programs(), each by the kind of test that its problem has; `known` is a table of verdicts."""
    functional = F.col("test_kind").eqNullSafe("functional")
    if known:
        return verdicts.run_known(sandbox.test_rows(rows.where(functional), contest=True).unionByName(sandbox.test_rows(rows.where(~functional))), known, timeout)
    return sandbox.run_tests(rows.where(functional), timeout, contest=True).unionByName(sandbox.run_tests(rows.where(~functional), timeout))


def judged(rows: DataFrame, problems: DataFrame, judge: Callable[[DataFrame], DataFrame] = run_programs) -> DataFrame:
    """Results in long form of scored() rows. `judge` gets programs() and gives (task_id, mode, pass, err); what it says nothing of failed."""
    said = judge(programs(rows, problems)).select("task_id", "mode", F.col("pass").alias("__passed"), F.col("err").alias("__said"))
    rows = with_verdict(rows.join(said, ["task_id", "mode"], "left"), F.coalesce("__passed", F.lit(False)), F.coalesce("__said", F.lit("")))
    kept = [f.name for f in aggregate_columns(rows)]
    return rows.select("ordinal", "task_id", "mode", *kept).join(F.broadcast(mode_dimension(rows.sparkSession).select("ix", "mode")), "mode")


def evaluate(responses: DataFrame, problems: DataFrame, judge: Callable[[DataFrame], DataFrame] = run_programs, **thresholds: int) -> DataFrame:
    """Results in long form of responses (ordinal, task_id, mode, raw_response, completion_tokens) to problems.

    `judge` is that of judged(), the thresholds are those of score(). Scores when called, and tests when the result is read.
    """
    return judged(scored(responses, problems, **thresholds), problems, judge)


def aggregate_columns(rows: DataFrame) -> list:
    """The columns of a mode's result, of those that rows have, in the order of the results file."""
    from mullion.sources.schemas import MODE_RESULT

    return [f for f in MODE_RESULT.fields if f.name in rows.columns]


def write_run(results: DataFrame, problems: DataFrame, folder: str, args: dict, elapsed: float | None = None, seconds: dict[str, float] | None = None, results_too: bool = True, funnel: dict[str, int] | None = None) -> dict:
    """results.jsonl and report.md (folders of parts) and summary.json of a run; the summary is given back.

    `seconds` are those of the stages so far, `funnel` is how many problems each filter left; without `results_too` the results file is there already.
    """
    if results_too:
        sinks.write_results(aggregate.results_wide(results), f"{folder}/results.jsonl")
    summary = aggregate.summary_document(results, args, elapsed)
    if seconds is not None:
        summary["stage_seconds"] = seconds
    if funnel is not None:
        summary["funnel"] = funnel
    sinks.write_summary(results.sparkSession, summary, f"{folder}/summary.json")
    labels = [r.label for r in aggregate.modes_present(results).collect()]
    header = report.report_header(str(args.get("dataset", "")), summary["n"], str(args.get("model", "")), labels, int(args.get("max_tokens", 0)), str(args.get("grammar_file", "")))
    sinks.write_report(report.report_sections(results, problems), header, f"{folder}/report.md")
    return summary
