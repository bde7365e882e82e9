"""The published run, rebuilt from its failing ids."""

from mullion.operators import aggregate as a
from mullion.sources.fixtures import fixture

PASSES = {"free": 151, "fsm": 152, "prompt_terse": 153}
PAIR = {"both_pass": 146, "both_fail": 7, "fsm_only_pass": 6, "free_only_pass": 5}
TRIPLE = {"all_pass": 144, "all_fail": 6, "prompt_terse_only_pass": 1, "prompt_terse_only_fail": 2, "prompt_terse_matches_free_not_fsm": 6, "prompt_terse_matches_fsm_not_free": 5}


def test_passes_and_buckets(spark):
    rows = fixture(spark, "", "golden")
    assert {r["mode"]: r["n"] for r in rows.where("pass").groupBy("mode").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()} == PASSES
    assert {r.bucket: r.n for r in a.pair_overlap(rows).collect()} == PAIR
    assert {r.bucket: r.n for r in a.triple_overlap(rows).collect()} == TRIPLE
    assert {r.bucket: [x.split("/")[1] for x in r.task_ids] for r in a.triple_overlap(rows).collect()}["prompt_terse_only_pass"] == ["163"]


def test_breakdown_of_no_rows_is_empty(spark):
    assert a.outcome_breakdown(fixture(spark, "", "golden").where("mode = 'free'")).count() == 0


def test_empty_buckets_stay(spark):
    got = {r.bucket: (r.n, r.task_ids) for r in a.pair_overlap(fixture(spark, "", "golden").where("ordinal = 0")).collect()}
    assert got == {"both_pass": (1, ["HumanEval/0"]), "both_fail": (0, []), "fsm_only_pass": (0, []), "free_only_pass": (0, [])}
