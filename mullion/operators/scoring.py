"""From responses to results: one projection of extraction, metrics and labels a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mullion.functions import patterns as p
from mullion.functions.classify import failure_type
from mullion.functions.extract import extract_think, with_code
from mullion.functions.text import BLOAT_THRESHOLD, COMMENT_BLOAT_THRESHOLD, bloated, comment_metrics, count_tokens, cut_error, entry_point_found, function_name, post_think_tokens

#: What a test run needs of a problem besides its entry point.
TESTS = ("test", "metadata", "starter_code", "public_test_cases")


def modes_to_run(only: str) -> list[str]:
    """'both' is free and fsm, 'all' the three, anything else itself."""
    return {"both": ["free", "fsm"], "all": [m for _, m, _ in p.MODES]}.get(only, [only])


def mode_dimension(spark) -> DataFrame:
    return spark.createDataFrame(list(p.MODES), "ix int, mode string, label string")


def with_metrics(
    responses: DataFrame, entry_point: Column | None = None, contest: bool | Column = False, bloat: int = BLOAT_THRESHOLD, comment_bloat: int = COMMENT_BLOAT_THRESHOLD, whole_code: bool = False
) -> DataFrame:
    """responses (raw_response, completion_tokens, ...) with everything that doesn't need a test run.

    Metrics are of the whole texts; the stored ones are cut to 500 characters afterwards. With `whole_code` the code
    stays as full_extracted_code too.
    """
    df = with_code(responses, "raw_response", "full_")
    df = df.withColumn("__score_think", F.when(F.col("raw_response").isNotNull(), extract_think(F.col("raw_response"))))
    df = df.withColumns({"think_tokens": count_tokens(F.col("__score_think")), "total_tokens": F.coalesce(F.col("completion_tokens").cast("bigint"), count_tokens(F.col("raw_response"))), "__score_comments": comment_metrics(F.col("full_extracted_code"))})
    df = df.withColumns({n: F.coalesce(F.col(f"__score_comments.{n}"), F.lit(0)) for n in ("code_lines", "code_comment_lines", "code_comment_tokens")})
    df = df.withColumns({"total_tokens": F.when(F.col("raw_response").isNotNull(), F.col("total_tokens")), "post_think_tokens": F.coalesce(post_think_tokens(F.col("total_tokens"), F.col("think_tokens")), F.lit(0))})
    code, name = F.col("full_extracted_code"), entry_point if entry_point is not None else F.lit("candidate")
    if isinstance(contest, Column):
        found = F.when(contest, entry_point_found(code, name, True)).otherwise(entry_point_found(code, name, False))
    else:
        found = entry_point_found(code, name, contest)
    df = df.withColumns({
        "answer_channel_bloat": bloated(F.col("post_think_tokens"), bloat),
        "comment_bloat": bloated(F.col("code_comment_tokens"), comment_bloat),
        "entry_point_found": F.coalesce(found, F.lit(False)),
        "extracted_think": F.left("__score_think", F.lit(500)),
        "extracted_code": F.left("full_extracted_code", F.lit(500)),
    })
    return df.drop("__score_think", "__score_comments", *([] if whole_code else ["full_extracted_code"]))


def with_verdict(df: DataFrame, passed: Column, stderr: Column) -> DataFrame:
    """df with pass, err and failure_type; code that wasn't found isn't run, and an error is classified as it is cut."""
    empty = F.col("extraction_issue").eqNullSafe("empty_code")
    failed = F.col("extraction_issue").eqNullSafe("generation_error")
    df = df.withColumn("pass", F.when(empty | failed, F.lit(False)).otherwise(passed))
    df = df.withColumn("err", F.when(failed, F.left(F.concat(F.lit("gen_error: "), F.coalesce(stderr, F.lit(""))), F.lit(300))).when(empty, "empty_code").when(F.col("pass"), "").otherwise(F.coalesce(cut_error(stderr), F.lit(""))))
    return df.withColumn("failure_type", failure_type(F.col("pass"), F.col("err"), F.col("extraction_issue"), F.col("entry_point_found")))


def latest(problems: DataFrame, *columns: str | Column) -> DataFrame:
    """task_id and those columns of the last problem by ordinal that has it; partial aggregation over no more than that."""
    return problems.groupBy("task_id").agg(F.max_by(F.struct(*columns), "ordinal").alias("problem"))


def with_problem(responses: DataFrame, problems: DataFrame) -> DataFrame:
    """Responses with what scoring needs of their problem: data set, entry point and kind of test.

    Of problems that share a task id the last one by ordinal counts; a response without a problem keeps nulls. A data set
    that the responses have already is the responses' own.
    """
    contest = F.col("dataset") == "livecodebench"
    name = F.when(contest, function_name(F.col("metadata"), F.col("starter_code"))).otherwise(F.col("entry_point")).alias("entry_point")
    kind = F.when(contest, "functional").otherwise("check").alias("test_kind")
    of = latest(problems, name, kind, *[c for c in ("dataset",) if c not in responses.columns])
    return responses.join(of, "task_id", "left").select(*responses.columns, "problem.*")


def with_tests(responses: DataFrame, problems: DataFrame) -> DataFrame:
    """Responses with the tests of their problem, chosen as in with_problem(); columns that they have already are their own."""
    of = latest(problems, *[c for c in TESTS if c not in responses.columns])
    return responses.join(of, "task_id", "left").select(*responses.columns, "problem.*")


def score(responses: DataFrame, problems: DataFrame, **options: int | bool) -> DataFrame:
    """Responses joined with their problems, with metrics; the entry point is looked for as the problem's data set asks."""
    return with_metrics(with_problem(responses, problems), F.coalesce("entry_point", F.lit("")), F.col("test_kind").eqNullSafe("functional"), **options)
