"""Labels of results: why one failed, and how the modes of a problem compare."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def failure_type(passed: Column, err: Column, issue: Column, entry_found: Column) -> Column:
    """The first label whose test holds, over the error as it was cut."""
    err = F.coalesce(err, F.lit(""))
    has = lambda s: F.contains(err, F.lit(s))
    return (
        F.when(passed.eqNullSafe(True), "pass")
        .when(err.startswith("gen_error:"), "generation_error")
        .when(issue.eqNullSafe("empty_code"), "extraction_empty_code")
        .when(err == "TIMEOUT", "timeout")
        .when(has("SyntaxError") | has("IndentationError"), "syntax_error")
        .when(has("entry point") & has("not found"), "missing_entry_point")
        .when(entry_found.eqNullSafe(False), "missing_entry_point")
        .when(has("AssertionError"), "wrong_answer")
        .when(has("TypeError"), "type_error")
        .when(has("NameError"), "runtime_name_error")
        .when(err != "", "runtime_error")
        .otherwise("unknown_failure")
    )


def outcome_tag(free: Column, fsm: Column, terse: Column) -> Column:
    """The heading of a problem; null stands for a mode that didn't run."""
    yes, no, none = (lambda c: c.eqNullSafe(True)), (lambda c: c.eqNullSafe(False)), (lambda c: c.isNull())
    base = (
        F.when(yes(free) & yes(fsm), "🟰 both pass")
        .when(yes(free) & no(fsm), "🔻 FSM regression")
        .when(no(free) & yes(fsm), "🔺 FSM wins")
        .when(no(free) & no(fsm), "❌ both fail")
        .when(yes(free), "free only: ✓")
        .when(no(free), "free only: ✗")
        .when(yes(fsm), "fsm only: ✓")
        .when(no(fsm), "fsm only: ✗")
        .when(yes(terse), "prompt_terse only: ✓")
        .when(no(terse), "prompt_terse only: ✗")
        .otherwise("—")
    )
    all_three = free.isNotNull() & fsm.isNotNull() & terse.isNotNull()
    also = F.when(all_three, F.when(terse, "; prompt_terse=✓").otherwise("; prompt_terse=✗")).otherwise("")
    return F.when(yes(terse) & no(free) & no(fsm), "🟡 PROMPT_TERSE-only pass").when(no(terse) & yes(free) & yes(fsm), "🟠 PROMPT_TERSE-only fail").otherwise(F.concat(base, also))


def pair_bucket(free: Column, fsm: Column) -> Column:
    return F.when(free & fsm, "both_pass").when(~free & ~fsm, "both_fail").when(~free & fsm, "fsm_only_pass").when(free & ~fsm, "free_only_pass")


def triple_bucket(free: Column, fsm: Column, terse: Column) -> Column:
    return (
        F.when(free & fsm & terse, "all_pass")
        .when(~free & ~fsm & ~terse, "all_fail")
        .when(terse & ~free & ~fsm, "prompt_terse_only_pass")
        .when(~terse & free & fsm, "prompt_terse_only_fail")
        .when((terse == free) & (terse != fsm), "prompt_terse_matches_free_not_fsm")
        .when((terse == fsm) & (terse != free), "prompt_terse_matches_fsm_not_free")
    )


PAIR_BUCKETS = ("both_pass", "both_fail", "fsm_only_pass", "free_only_pass")
TRIPLE_BUCKETS = ("all_pass", "all_fail", "prompt_terse_only_pass", "prompt_terse_only_fail", "prompt_terse_matches_free_not_fsm", "prompt_terse_matches_fsm_not_free")
