"""Sources, sinks, scoring, comparison, sandbox, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from mullion.operators import aggregate as a
from mullion.operators import compare, evaluate, report, sandbox
from mullion.operators.scoring import modes_to_run, with_metrics, with_verdict
from mullion.operators.tokenizer import token_counter
from mullion.plans.catalogue import results
from mullion.sources import problems as src
from mullion.sources import sinks
from mullion.sources.fixtures import fixture
from mullion.sources.schemas import PROBLEMS

SF = "/root/testdata/sf0.001"


def test_select_problems_and_traps(spark):
    case = '{"testtype":"functional"}'
    rows = [(i, f"t{i}", *[None] * 6, c, None, d, "leetcode", None, None) for i, (c, d) in enumerate([(f"[{case}]", "2025-01-02"), (case, "2025-01-02"), ("[]", "2025"), ("[1]", "2025"), ("bad", "2025"), (f"[{case},{{}}]", "2025-01-02"), (f"[{case}]", None), (f"[{case}]", "2024")])]
    df = spark.createDataFrame(rows, PROBLEMS)
    assert [r.ordinal for r in src.select_problems(df, "2025-01-01").orderBy("ordinal").collect()] == [0]
    assert {r.stage: r.n for r in src.funnel(df, "2025-01-01").collect()} == {"total": 8, "after_date": 3, "after_platform": 3, "after_functional": 1}
    with pytest.raises(ValueError, match="no problems"):
        src.require_rows(df.where("false"))
    with pytest.raises(ValueError, match="unknown dataset"):
        src.load_problems(spark, "x", "/nowhere")


def test_filters_reach_the_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    spark.createDataFrame([], PROBLEMS).write.parquet(f"{tmp_path}/p")
    plan = src.select_problems(src.load_problems(spark, "livecodebench", f"{tmp_path}/p"), "2025-01-01")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(contest_date,2025-01-01)" in plan and "EqualTo(platform,leetcode)" in plan


def test_scoring_end_to_end(spark, tmp_path):
    rows = with_verdict(with_metrics(fixture(spark, SF, "responses")), F.col("k") % 2 == 0, F.lit("Traceback NameError"))
    by = {r.failure_type: r.n for r in rows.groupBy("failure_type").agg(F.count("*").alias("n")).collect()}
    assert set(by) == {"pass", "extraction_empty_code", "generation_error", "missing_entry_point"}
    wide = a.results_wide(rows.select("ordinal", "task_id", "mode", "pass", "err", "failure_type", "total_tokens"))
    sinks.write_results(wide.drop("ordinal"), f"{tmp_path}/r")
    back = src.read_results(spark, f"{tmp_path}/r")
    assert back.count() == 200 and back.where("free.failure_type is not null").count() == 200
    assert modes_to_run("both") == ["free", "fsm"] and modes_to_run("fsm") == ["fsm"] and len(modes_to_run("all")) == 3


def test_summary_and_report(spark, tmp_path):
    rows = results(spark, SF)
    summary = a.summary_document(rows, {"model": "m"}, 1.0)
    pair = summary["outcome_breakdown"]["free_vs_fsm"]
    assert pair["n"] == sum(v["count"] for k, v in pair.items() if k != "n")
    assert all(x["passes"] + x["failures"] == x["n"] for x in summary["failure_accounting"].values())
    sinks.write_summary(spark, summary, f"{tmp_path}/o/summary.json")
    assert json.loads((tmp_path / "o/summary.json").read_text())["modes"] == ["free", "fsm", "prompt_terse"]
    sinks.write_report(report.report_sections(rows, fixture(spark, SF, "problems")), report.report_header("d", 200, "m", ["FREE"], 1, "g"), f"{tmp_path}/o/report.md")
    text = "".join(sinks.report_parts(spark, f"{tmp_path}/o/report.md"))
    assert text.count("\n## P") == 200 and text.count("\n### ") == rows.count()


def test_lookup(spark):
    rows = results(spark, SF)
    assert compare.require_result(rows, "P8", "fsm").count() == 1
    with pytest.raises(LookupError, match="has no mode"):
        compare.require_result(rows, "P13", "fsm")
    with pytest.raises(LookupError, match="not found"):
        compare.require_result(rows, "none", "fsm")


def test_sandbox(spark):
    ok = "def f(x):\n    return x + 1"
    check = "def check(g):\n    assert g(1) == 2"
    rows = [("a", "free", ok, check, "f"), ("b", "free", ok.replace("1", "3"), check, "f"), ("c", "free", "x = q", check, "f"), ("d", "free", "def (", check, "f"), ("e", "free", "while True: pass", check, "f")]
    df = spark.createDataFrame(rows, "task_id string, mode string, code string, test string, entry_point string")
    got = {r.task_id: (r["pass"], r.err) for r in sandbox.run_tests(df, 3).collect()}
    assert got["a"] == (True, "") and got["e"] == (False, "TIMEOUT")
    assert "AssertionError" in got["b"][1] and "NameError" in got["c"][1] and "SyntaxError" in got["d"][1]


def test_functional_sandbox(spark):
    cases = json.dumps([{"testtype": "functional", "input": "[1, 2]\n3", "output": "[1, 2, 3]"}])
    solution = "class Solution:\n    def f(self, a, b):\n        return (*a, b)"
    rows = [("a", "fsm", solution, '{"func_name": "f"}', None, cases), ("b", "fsm", "def f(a, b): return 1", '{"func_name": "f"}', None, cases), ("c", "fsm", solution, None, None, cases), ("d", "fsm", solution, '{"func_name": "f"}', None, "[]"), ("e", "fsm", solution, '{"func_name": "g"}', None, cases)]
    df = spark.createDataFrame(rows, "task_id string, mode string, code string, metadata string, starter_code string, public_test_cases string")
    got = {r.task_id: (r["pass"], r.err) for r in sandbox.run_tests(df, 10, contest=True).collect()}
    assert got["a"] == (True, "") and "AssertionError" in got["b"][1]
    assert got["c"] == (False, "no_entry_point") and got["d"] == (False, "no_tests") and "entry point g not found" in got["e"][1]


def test_pluggable_tokenizer(spark):
    count = token_counter("words", lambda: lambda text: len(text.split()))
    rows = spark.createDataFrame([("a b",), (None,)], "x string").select(count("x").alias("n")).collect()
    assert [r.n for r in rows] == [2, 0]


def test_stream_counts(spark, tmp_path):
    from mullion.streaming import live

    (tmp_path / "in").mkdir()
    rows = [{"ordinal": i, "task_id": f"t{i}", "mode": "free", "raw_response": "```python\nx = 1\n```", "completion_tokens": 5, "at": "2025-01-01T00:00:00Z"} for i in range(4)]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    made = live.live_metrics(live.read_responses(spark, f"{tmp_path}/in")).withColumn("pass", F.lit(True))
    run = live.live_accounting(made).writeStream.outputMode("complete").format("memory").queryName("accounting").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    run.awaitTermination(120)
    assert [(r["mode"], r.n, r.passes) for r in spark.table("accounting").collect()] == [("free", 4, 4)]


def test_a_whole_run(spark, tmp_path):
    cases = json.dumps([{"testtype": "functional", "input": "2", "output": "3"}])
    problems = spark.createDataFrame(
        [(0, "a", "humaneval", "f", "def check(g):\n    assert g(1) == 2", None, None), (1, "b", "livecodebench", None, None, cases, '{"func_name": "f"}'), (2, "b", "livecodebench", None, None, cases, '{"func_name": "h"}')],
        "ordinal bigint, task_id string, dataset string, entry_point string, test string, public_test_cases string, metadata string",
    ).withColumns({"starter_code": F.lit(None).cast("string"), "prompt": F.lit("do"), "question_content": F.lit("it")})
    code = "t</think>```python\ndef {0}(x):\n    return x + 1\n```"
    rows = [(0, "a", "free", code.format("f"), 9), (0, "a", "fsm", code.format("q"), None), (1, "b", "free", code.format("h"), 9), (1, "b", "fsm", "t</think>", 9), (1, "b", "prompt_terse", None, None)]
    responses = spark.createDataFrame(rows, "ordinal bigint, task_id string, mode string, raw_response string, completion_tokens bigint")
    made = evaluate.evaluate(responses, problems).persist()
    got = {(r.task_id, r["mode"]): (r["pass"], r.failure_type, r.entry_point_found) for r in made.collect()}
    assert got == {("a", "free"): (True, "pass", True), ("a", "fsm"): (False, "missing_entry_point", False), ("b", "free"): (True, "pass", True), ("b", "fsm"): (False, "extraction_empty_code", False), ("b", "prompt_terse"): (False, "generation_error", False)}
    summary = evaluate.write_run(made, problems, f"{tmp_path}/run", {"model": "m", "dataset": "d"})
    assert summary["free"]["pass_rate"] == 1.0 and json.loads((tmp_path / "run/summary.json").read_text())["n"] == 2
    assert any("## b" in part for part in sinks.report_parts(spark, f"{tmp_path}/run/report.md"))
    long = src.long_results(src.read_results(spark, f"{tmp_path}/run/results.jsonl"))
    assert {(r.ordinal, r.task_id, r["mode"], r["pass"]) for r in long.collect()} == {(0 if t == "a" else 1, t, m, p) for (t, m), (p, *_) in got.items()}
    assert compare.require_result(long, "b", "free").first().failure_type == "pass"
    pair = compare.require_pair(long, long, "b", "free", "fsm").collect()
    assert [(r.side, r["pass"]) for r in pair] == [("left", True), ("right", False)]
    with pytest.raises(LookupError, match="right run: task 'a' has no mode"):
        compare.require_pair(long, long, "a", "free", "prompt_terse")
    with pytest.raises(ValueError, match="no problems"):
        evaluate.evaluate(responses, problems.where("false"))


def test_lines_without_ordinal_keep_their_order(spark, tmp_path):
    lines = [{"task_id": t, "free": {"pass": p}} for t, p in (("x", False), ("y", True), ("x", True))]
    (tmp_path / "r.jsonl").write_text("\n\n".join(map(json.dumps, lines)) + "\n")
    long = src.long_results(src.read_results(spark, f"{tmp_path}/r.jsonl"))
    assert compare.require_result(long, "x", "free").first()["pass"] is False and long.count() == 3


def test_versions_and_grammar(spark, tmp_path):
    spark.createDataFrame([(0, "q")], "ordinal bigint, question_id string").write.parquet(f"{tmp_path}/p/version=v5")
    assert src.load_problems(spark, "livecodebench", f"{tmp_path}/p", "v5").first().task_id == "q"
    with pytest.raises(FileNotFoundError, match="version v6 .* there are v5"):
        src.load_problems(spark, "livecodebench", f"{tmp_path}/p", "v6")
    (tmp_path / "g").write_text("code ::= [a-z]")
    assert src.read_grammar(f"{tmp_path}/g", ["free", "fsm"]) == "code ::= [a-z]" and src.read_grammar("/nowhere", ["free"]) is None
    with pytest.raises(ValueError, match="grammar"):
        src.read_grammar(None, ["fsm"])


def test_bad_cases_are_that_rows_error():
    assert sandbox.functional_program("x", "f", '[{"input": 3}]')[1].startswith("bad_tests")
    assert sandbox.functional_program("x", "f", "{")[1].startswith("bad_tests")
