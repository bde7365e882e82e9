import json

import pytest
from pyspark.sql import functions as F

from mullion.operators.run import Run
from mullion.sources import sinks
from mullion.sources.schemas import PROBLEMS


def problems(spark, tmp_path):
    rows = [(k, f"t{k}", "humaneval", f"def f{k}(x):", None, None, "f", "def check(g):\n    assert g(1) == 2", None, None, None, None, None, None) for k in range(5)]
    spark.createDataFrame(rows, PROBLEMS).write.parquet(f"{tmp_path}/p")
    return f"{tmp_path}/p"


def test_a_run_from_its_parameters(spark, tmp_path):
    path = problems(spark, tmp_path)
    run = Run("humaneval", model="m", n_problems=3, bloat_threshold=1)
    assert run.modes == ["free", "fsm"] and [r.task_id for r in run.problems(spark, path).collect()] == ["t0", "t1", "t2"]
    code = "t</think>```python\ndef f(x):\n    return x + 1\n```"
    responses = spark.createDataFrame([(k, f"t{k}", m, code, 99) for k in range(3) for m in ("free", "fsm", "prompt_terse")], "ordinal bigint, task_id string, mode string, raw_response string, completion_tokens bigint")
    judge = lambda rows: rows.select("task_id", "mode", (F.col("task_id") != "t1").alias("pass"), F.lit("AssertionError").alias("err"))
    summary = run.execute(spark, path, responses, f"{tmp_path}/run", judge)
    stored = json.loads(sinks.get(spark, f"{tmp_path}/run/summary.json"))
    assert stored == json.loads(json.dumps(summary))
    assert stored["modes"] == ["free", "fsm"] and stored["n"] == 3 and stored["args"]["n_problems"] == 3 and stored["args"]["max_tokens"] == 8192
    assert list(stored["stage_seconds"]) == ["load", "extract", "tests", "results"] and all(v >= 0 for v in stored["stage_seconds"].values())
    assert stored["funnel"] == {"total": 5}
    assert stored["elapsed_sec"] >= sum(stored["stage_seconds"].values()) - 0.01
    assert stored["outcome_breakdown"]["free_vs_fsm"]["both_pass"]["task_ids"] == ["t0", "t2"]
    assert stored["failure_accounting"]["free"]["answer_channel_bloat"] == 3
    assert spark.read.json(f"{tmp_path}/run/results.jsonl").count() == 3
    assert "".join(sinks.report_parts(spark, f"{tmp_path}/run/report.md")).count("\n## ") == 3


def test_requests_of_the_runs_modes(spark, tmp_path):
    path = problems(spark, tmp_path)
    (tmp_path / "g").write_text("root ::= [a-z]+")
    run = Run("humaneval", n_problems=0, only="all", grammar_file=f"{tmp_path}/g", max_tokens=7)
    rows = run.requests(run.problems(spark, path)).collect()
    assert len(rows) == 15 and {r.request.max_tokens for r in rows} == {7}
    assert {r["mode"] for r in rows if r.request.grammar} == {"fsm"}
    with pytest.raises(ValueError, match="grammar file"):
        Run("humaneval").requests(run.problems(spark, path))


@pytest.mark.parametrize(("given", "said"), [({"dataset": "other"}, "dataset has to be"), ({"only": "two"}, "only has to be"), ({"n_problems": -1}, "n_problems"), ({"max_tokens": 0}, "max_tokens"), ({"timeout": 0}, "timeout"), ({"bloat_threshold": -1}, "bloat_threshold")])
def test_what_cannot_be_run_is_refused(given, said):
    with pytest.raises(ValueError, match=said):
        Run(**({"dataset": "mbpp"} | given))


def test_the_funnel_of_a_run_needs_no_pass_of_its_own(spark, tmp_path):
    from mullion.sources import problems as src

    case, other = '[{"testtype":"functional"}]', '[{"testtype":"stdin"}]'
    rows = [(k, f"t{k}", "livecodebench", *[None] * 5, other if k % 5 == 0 else case, None, None if k % 7 == 0 else f"2025-0{1 + k % 3}-01", "leetcode" if k % 2 else "atcoder", None, None) for k in range(60)]
    spark.createDataFrame(rows, PROBLEMS).write.parquet(f"{tmp_path}/p")
    run = Run("livecodebench", n_problems=4, date_cutoff="2025-02-01")
    table, left = run.problem_table(spark, f"{tmp_path}/p")
    loaded = src.load_problems(spark, "livecodebench", f"{tmp_path}/p")
    assert left == {r.stage: r.n for r in src.funnel(loaded, "2025-02-01").collect()} and left["total"] == 60 > left["after_date"] > left["after_platform"] > left["after_functional"] > 4
    assert [r.task_id for r in table.orderBy("ordinal").collect()] == [r.task_id for r in run.problems(spark, f"{tmp_path}/p").collect()]
    with pytest.raises(ValueError, match="no problems"):
        Run("livecodebench", date_cutoff="2026").problem_table(spark, f"{tmp_path}/p")


def test_tests_join_only_what_has_code(spark):
    from mullion.operators import evaluate, scoring

    problems = spark.createDataFrame([(0, "a", "humaneval", "f", "T0", None, None), (1, "a", "humaneval", "g", "T1", None, None)], "ordinal bigint, task_id string, dataset string, entry_point string, test string, metadata string, public_test_cases string").withColumn("starter_code", F.lit(None).cast("string"))
    responses = spark.createDataFrame([(0, "a", "free", "t</think>```python\ndef g(x):\n    return 'é'\n```", 9), (0, "a", "fsm", "t</think>", 9), (0, "b", "free", None, None)], "ordinal bigint, task_id string, mode string, raw_response string, completion_tokens bigint")
    rows = evaluate.scored(responses, problems)
    assert rows.count() == 3 and "test" not in scoring.with_problem(responses, problems).columns
    assert [(r.task_id, r["mode"], r.entry_point, r.test, r.code) for r in evaluate.programs(rows, problems).collect()] == [("a", "free", "g", "T1", "def g(x):\n    return 'é'\n")]
    plan = evaluate.programs(rows, problems)._jdf.queryExecution().executedPlan().toString().lower()
    assert "filescan parquet" in plan and "regexp" not in plan and "rlike" not in plan
