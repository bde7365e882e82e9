"""The registered queries. Each reads whole tables; each has a counterpart in SQL in mullion.plans.oracles, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mullion.functions import patterns as p
from mullion.functions import text as t
from mullion.functions.classify import failure_type
from mullion.functions.extract import extract_think, with_code
from mullion.functions.plan_grammar import plan_fields, plan_kind
from mullion.functions.prompts import request, rewritten_prompt, system_prompt, test_program, user_prompt
from mullion.operators import aggregate as a
from mullion.operators import compare, report
from mullion.operators.scoring import mode_dimension, modes_to_run, score, with_metrics, with_verdict
from mullion.plans import bucket_queries, grammars, json_values, lookups, replays, reports, streams
from mullion.plans.oracles import ORACLES
from mullion.sources import problems as src
from mullion.sources.fixtures import fixture

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CUTOFF, PLATFORM = "2025-01-01", "leetcode"
GRAMMARS = {"closed": "code ::= [a-z]+", "open": r"code ::= [\x09\x0A\x0D\x20-\x7E]+"}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixture(spark, sf_dir, "results")
    df = df.withColumn("failure_type", failure_type(F.col("pass"), F.col("err"), F.col("extraction_issue"), F.col("entry_point_found")))
    return df.withColumns({"answer_channel_bloat": t.bloated(F.col("post_think_tokens"), t.BLOAT_THRESHOLD), "comment_bloat": t.bloated(F.col("code_comment_tokens"), t.COMMENT_BLOAT_THRESHOLD)})


# -- sources -----------------------------------------------------------------------------------------------------------


@query
def q_scan_filter_date_platform(spark, d):
    rows = fixture(spark, d, "problems").where(src.since(CUTOFF)).where(src.on_platform(PLATFORM))
    return rows.select("ordinal", "task_id", "platform", "contest_date")


@query
def q_functional_tests_only(spark, d):
    return src.select_problems(fixture(spark, d, "problems"), CUTOFF, PLATFORM).select("ordinal", "task_id", F.size(src.parsed_tests(F.col("public_test_cases"))).cast("bigint").alias("n_tests"))


@query
def q_filter_funnel(spark, d):
    return src.funnel(fixture(spark, d, "problems"), CUTOFF, PLATFORM)


@query
def q_head_n(spark, d):
    return src.head(src.select_problems(fixture(spark, d, "problems"), CUTOFF, PLATFORM), 10).select("ordinal", "task_id")


@query
def q_fn_name(spark, d):
    return fixture(spark, d, "problems").select("ordinal", t.function_name(F.col("metadata"), F.col("starter_code")).alias("fn_name"))


@query
def q_test_counts(spark, d):
    return fixture(spark, d, "problems").select("ordinal", t.test_count(F.col("public_test_cases")).alias("n_tests"))


@query
def q_parse_test_args(spark, d):
    cases = fixture(spark, d, "problems").select("ordinal", F.posexplode(src.parsed_tests(F.col("public_test_cases"))).alias("case_ix", "case"))
    args = F.filter(F.split("case.input", "\n"), lambda x: t.strip(x) != "")
    return cases.select("ordinal", F.col("case_ix").cast("bigint").alias("case_ix"), F.size(args).cast("bigint").alias("n_args"), F.array_join(F.transform(args, lambda x: F.coalesce(F.get_json_object(x, "$"), x)), "|").alias("args"), F.coalesce(F.get_json_object("case.output", "$"), "case.output").alias("expected"))


# -- prompts -----------------------------------------------------------------------------------------------------------


def _prompt(df: DataFrame) -> DataFrame:
    return df.withColumn("user_prompt", user_prompt("livecodebench", F.col("prompt"), F.col("question_content"), F.col("starter_code")))


@query
def q_user_prompt(spark, d):
    df = fixture(spark, d, "problems")
    parts = [df.select("ordinal", F.lit(s).alias("dataset"), user_prompt(s, F.coalesce("prompt", F.lit("")), F.col("question_content"), F.col("starter_code")).alias("prompt")) for s in ("humaneval", "mbpp", "livecodebench")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def q_prompt_rewrite(spark, d):
    return _prompt(fixture(spark, d, "problems")).select("ordinal", *[rewritten_prompt(F.col("user_prompt"), F.lit(g)).alias(k) for k, g in GRAMMARS.items()])


@query
def q_system_prompt(spark, d):
    return fixture(spark, d, "problems").select("ordinal", system_prompt(F.when(F.col("ordinal") % 2 == 0, GRAMMARS["closed"]).otherwise(GRAMMARS["open"])).alias("prompt"))


@query
def q_request_rows(spark, d):
    rows = _prompt(fixture(spark, d, "problems")).crossJoin(F.broadcast(mode_dimension(spark)))
    rows = rows.select("ordinal", "mode", request(F.col("mode"), F.col("user_prompt"), F.lit(GRAMMARS["closed"]), 8192).alias("r"))
    return rows.select("ordinal", "mode", F.col("r.messages")[0]["content"].alias("system"), F.md5(F.col("r.messages")[1]["content"]).alias("user_md5"), F.col("r.max_tokens").alias("max_tokens"), F.col("r.temperature").alias("temperature"), F.col("r.grammar").alias("grammar"))


@query
def q_message_text(spark, d):
    return fixture(spark, d, "messages").select("ordinal", t.message_text(F.col("content"), F.col("reasoning_content"), F.col("reasoning")).alias("text"))


# -- responses ---------------------------------------------------------------------------------------------------------


def _answered(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "responses").where("raw_response is not null")


@query
def q_strip_think_tags(spark, d):
    x = F.col("raw_response")
    return _answered(spark, d).select("ordinal", "mode", F.md5(t.strip_think_tags(x)).alias("stripped"), F.md5(t.after_last(x, p.THINK_CLOSE)).alias("after"), F.md5(t.before_first(x, p.THINK_CLOSE)).alias("before"), t.occurrences(x, p.THINK_CLOSE).alias("closes"))


@query
def q_extract_think(spark, d):
    return _answered(spark, d).select("ordinal", "mode", extract_think(F.col("raw_response")).alias("think"))


@query
def q_extract_code(spark, d):
    return with_code(_answered(spark, d), "raw_response").select("ordinal", "mode", F.col("extracted_code").alias("code"), "extraction_method", "extraction_issue")


@query
def q_extraction_methods(spark, d):
    return a.extraction_methods(with_code(fixture(spark, d, "responses"), "raw_response"))


@query
def q_extraction_issues(spark, d):
    return a.extraction_issues(with_code(fixture(spark, d, "responses"), "raw_response"))


@query
def q_token_counts(spark, d):
    return with_metrics(fixture(spark, d, "responses")).select("ordinal", "mode", "think_tokens", "total_tokens", "post_think_tokens")


@query
def q_comment_metrics(spark, d):
    return with_metrics(fixture(spark, d, "responses")).select("ordinal", "mode", "code_lines", "code_comment_lines", "code_comment_tokens")


@query
def q_bloat_flags(spark, d):
    rows = with_metrics(fixture(spark, d, "responses"), bloat=1024, comment_bloat=1)
    return rows.groupBy("mode").agg(F.count_if("answer_channel_bloat").cast("bigint").alias("answer_channel_bloat"), F.count_if("comment_bloat").cast("bigint").alias("comment_bloat"))


@query
def q_entry_point_found(spark, d):
    code = with_code(_answered(spark, d), "raw_response")
    return code.select("ordinal", "mode", t.entry_point_found(F.col("extracted_code"), F.lit("f"), False).alias("plain"), t.entry_point_found(F.col("extracted_code"), F.lit("h"), True).alias("contest"))


@query
def q_scoring_join(spark, d):
    """Responses with their problem's data set, entry point and kind of test, and whether the code shows that entry point."""
    dataset = F.when(F.col("ordinal") % 2 == 0, "livecodebench").otherwise("humaneval")
    known = fixture(spark, d, "problems").withColumns({"dataset": dataset, "entry_point": F.lit("f"), "test": F.lit("")})
    return score(fixture(spark, d, "responses"), known).select("ordinal", "mode", "dataset", "entry_point", "test_kind", "entry_point_found")


@query
def q_verdicts(spark, d):
    """Verdicts of responses whose code a test would pass at every other problem: what has no code isn't run, and failed."""
    rows = with_metrics(fixture(spark, d, "responses"), F.lit("f"))
    rows = with_verdict(rows, F.col("ordinal") % 2 == 0, F.lit("AssertionError: test 0"))
    return rows.select("ordinal", "mode", "pass", "err", "failure_type")


@query
def q_test_program(spark, d):
    code = with_code(_answered(spark, d), "raw_response")
    name = F.when(F.col("ordinal") % 2 == 0, "f").otherwise("")
    return code.select("ordinal", "mode", F.md5(test_program(F.col("extracted_code"), F.lit("def check(g):\n    assert g(1) == 1"), name)).alias("program"))


@query
def q_modes_to_run(spark, d):
    asked = ("both", "all", "free", "fsm", "prompt_terse")
    return spark.createDataFrame([(only, i, m) for only in asked for i, m in enumerate(modes_to_run(only))], "asked string, ix bigint, mode string")


@query
def q_prelude(spark, d):
    code = with_code(_answered(spark, d), "raw_response").withColumn("code", F.concat(F.when(F.col("ordinal") % 2 == 0, F.lit("from __future__ import annotations\n")).otherwise(""), F.col("extracted_code")))
    return code.select("ordinal", "mode", t.with_prelude(F.col("code")).alias("program"))


@query
def q_tokenize_chunks(spark, d):
    pieces = _answered(spark, d).select("ordinal", "mode", "raw_response", t.chunks(F.col("raw_response")).alias("c"))
    return pieces.select("ordinal", "mode", F.size("c").cast("bigint").alias("n"), F.array_join("c", "|").alias("chunks"), (F.array_join("c", "") == F.col("raw_response")).alias("lossless"))


def _pane(spark: SparkSession, d: str) -> DataFrame:
    rows = fixture(spark, d, "responses")
    made = compare.pane(F.upper("mode"), F.col("mode"), F.col("raw_response"), F.lit("gen_error: x"), F.col("completion_tokens"), F.when(F.col("ordinal") % 2 == 0, F.lit(12.5)), 40.0)
    return rows.select("ordinal", "mode", made.alias("pane"))


@query
def q_pane_payload(spark, d):
    return _pane(spark, d).select("ordinal", "mode", "pane.label", "pane.total_tokens", "pane.seconds", F.size("pane.chunks").cast("bigint").alias("n_chunks"), F.contains(compare.script_payload(F.col("pane")), F.lit("</")).alias("unsafe"))


@query
def q_tps(spark, d):
    rows = _pane(spark, d)
    return rows.groupBy("ordinal").agg(F.max(t.tokens_per_second(F.col("pane.total_tokens"), F.col("pane.seconds"))).alias("tps"), F.max("pane.seconds").alias("horizon"))


@query
def q_replay_prefix(spark, d):
    return _pane(spark, d).select("ordinal", "mode", *[t.replay_prefix(F.col("pane.chunks"), F.lit(8.0), F.lit(at)).alias(name) for name, at in (("at_0", -1.0), ("at_3", 3.0), ("at_9", 9.0))])


@query
def q_split_close(spark, d):
    parts = _answered(spark, d).select("ordinal", "mode", t.split_at_close(F.col("raw_response")).alias("s"))
    return parts.select("ordinal", "mode", F.md5("s.think").alias("think"), F.md5(t.escape_html(F.col("s.rest"))).alias("rest"))


@query
def q_plan_conforms(spark, d):
    return fixture(spark, d, "plans").select("ordinal", plan_kind(F.col("raw_response")).alias("plan"))


@query
def q_plan_fields(spark, d):
    rows = fixture(spark, d, "plans").select("ordinal", plan_fields(F.col("raw_response"), p.PLAN_3).alias("three"), plan_fields(F.col("raw_response"), p.PLAN_5).alias("five"))
    return rows.where("three is not null or five is not null").select("ordinal", F.coalesce("three.goal", "five.goal").alias("goal"), "three.approach", "five.state", "five.algo", F.coalesce("three.edge", "five.edge").alias("edge"), "five.verify")


# -- results -----------------------------------------------------------------------------------------------------------


@query
def q_classify_failure(spark, d):
    long = F.concat(F.repeat(F.lit("x"), 400), F.col("err"))
    return results(spark, d).select("ordinal", "mode", "failure_type", failure_type(F.col("pass"), t.cut_error(long), F.col("extraction_issue"), F.col("entry_point_found")).alias("as_cut"))


@query
def q_failure_types(spark, d):
    return a.failure_types(results(spark, d))


@query
def q_mode_summary(spark, d):
    return a.mode_summary(results(spark, d))


@query
def q_mode_summary_big(spark, d):
    return a.mode_summary(fixture(spark, d, "outcomes"))


@query
def q_accuracy_delta_compression(spark, d):
    return a.comparison(a.mode_summary(results(spark, d)))


@query
def q_failure_accounting(spark, d):
    return a.failure_accounting(results(spark, d))


def _joined(overlap: DataFrame) -> DataFrame:
    return overlap.select("check", "bucket", "n", F.array_join("task_ids", ",").alias("task_ids"))


@query
def q_overlap_pair(spark, d):
    return _joined(a.pair_overlap(results(spark, d)))


@query
def q_overlap_triple(spark, d):
    return _joined(a.triple_overlap(results(spark, d)))


@query
def q_outcome_breakdown(spark, d):
    return a.outcome_breakdown(results(spark, d)).select("check", "bucket", "n")


@query
def q_golden_overlap(spark, d):
    return _joined(a.outcome_breakdown(fixture(spark, d, "golden")))


@query
def q_pass_set_algebra(spark, d):
    return a.pass_sets(results(spark, d))


@query
def q_outcome_tag(spark, d):
    return a.outcome_tags(results(spark, d))


@query
def q_format_ids(spark, d):
    return report.breakdown_lines(a.pair_overlap(results(spark, d))).select("check", F.col("bucket_ix").cast("bigint").alias("bucket_ix"), "line")


@query
def q_format_counts(spark, d):
    return report.count_lines(a.counts_by_mode(a.failure_types(results(spark, d)), "failure_type"))


@query
def q_modes_present(spark, d):
    return a.modes_present(results(spark, d)).select(F.col("ix").cast("bigint").alias("ix"), "mode", "label")


@query
def q_problem_lookup(spark, d):
    rows = report.with_problem(results(spark, d), fixture(spark, d, "problems"))
    return rows.select("ordinal", "mode", F.md5("statement").alias("statement"))


@query
def q_report_markdown(spark, d):
    return report.section(results(spark, d)).select("ordinal", "mode", "markdown")


@query
def q_report_sections(spark, d):
    rows = report.report_sections(results(spark, d), fixture(spark, d, "problems"))
    return rows.select("ordinal", "task_id", (F.size(F.split("markdown", "\n### ")) - 1).cast("bigint").alias("sections"), F.contains("markdown", F.lit("_think compression_")).alias("compared"), F.substring_index("markdown", "\n", 1).alias("heading"), F.md5("markdown").alias("markdown"))


@query
def q_summary_lines(spark, d):
    return report.summary_lines(a.mode_summary(results(spark, d))).select(F.col("ix").cast("bigint").alias("ix"), "line")


@query
def q_accounting_lines(spark, d):
    return report.accounting_lines(results(spark, d)).select(F.col("ix").cast("bigint").alias("ix"), F.col("part").cast("bigint").alias("part"), "line")


@query
def q_status_lines(spark, d):
    return report.status_line(results(spark, d))


@query
def q_think_compression_per_task(spark, d):
    return a.think_compression(results(spark, d))


@query
def q_results_lookup(spark, d):
    return compare.lookup(results(spark, d), "P8", "fsm").select("ordinal", "mode", "pass", "failure_type", "total_tokens")


@query
def q_pair_runs(spark, d):
    rows = results(spark, d)
    return compare.pair_runs(rows, rows, "free", "fsm", "pass", "total_tokens").select("task_id", "left_pass", "left_total_tokens", "right_pass", "right_total_tokens")


@query
def q_results_wide(spark, d):
    rows = a.results_wide(results(spark, d).select("ordinal", "task_id", "mode", "pass", "think_tokens", "failure_type"))
    cols = [F.col(f"{m}.{c}").alias(f"{m}_{c}") for m in a.MODE_NAMES for c in ("pass", "think_tokens", "failure_type")]
    return rows.select("ordinal", "task_id", *cols)


@query
def q_summary_json(spark, d):
    """A row a mode, its part of the summary as JSON."""
    rows = a.mode_summary(results(spark, d))
    return rows.select("mode", F.to_json(F.struct(*[c for c in rows.columns if c != "mode"])).alias("summary"))


# -- queries with a module of their own ---------------------------------------------------------------------------------

for _part in (bucket_queries, grammars, json_values, lookups, replays, reports, streams):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
