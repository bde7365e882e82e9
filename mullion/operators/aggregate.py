"""Aggregates over results in long form: (ordinal, task_id, mode, pass, ...). Each is one shuffle, on mode or task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mullion.functions import patterns as p
from mullion.functions.classify import PAIR_BUCKETS, TRIPLE_BUCKETS, outcome_tag, pair_bucket, triple_bucket

MODE_NAMES = [m for _, m, _ in p.MODES]


def filled_mean(column: str) -> Column:
    """The mean with nulls as zeros: a row without a metric lowers it. 0 of no rows."""
    return F.coalesce(F.sum(F.coalesce(F.col(column), F.lit(0))).cast("double"), F.lit(0.0)) / F.greatest(F.count("*"), F.lit(1))


def mode_summary(results: DataFrame) -> DataFrame:
    """A row for each mode with a verdict: rate of passes and filled means."""
    judged = results.where("pass is not null")
    return judged.groupBy("mode").agg(
        F.count("*").cast("bigint").alias("n"),
        F.avg(F.col("pass").cast("double")).alias("pass_rate"),
        *[filled_mean(c).alias(f"{c}_mean") for c in ("think_tokens", "total_tokens", "post_think_tokens", "code_comment_tokens")],
    )


def comparison(summary: DataFrame) -> DataFrame:
    """One row: accuracy delta in points, and ratios of means."""
    of = lambda mode, c: F.max(F.when(F.col("mode") == mode, F.col(c)))
    ratio = lambda a, b, c: of(a, c) / F.greatest(of(b, c), F.lit(1.0))
    return summary.agg(
        ((of("fsm", "pass_rate") - of("free", "pass_rate")) * 100).alias("accuracy_delta_pp"),
        ratio("free", "fsm", "think_tokens_mean").alias("think_compression"),
        ratio("free", "fsm", "total_tokens_mean").alias("total_compression"),
        ratio("free", "prompt_terse", "think_tokens_mean").alias("prompt_only_compression"),
        ratio("prompt_terse", "fsm", "think_tokens_mean").alias("grammar_gain"),
    )


def failure_accounting(results: DataFrame) -> DataFrame:
    """A row a mode, over all rows: a missing verdict counts as a failure."""
    passed = F.coalesce(F.col("pass"), F.lit(False))
    flag = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False))).cast("bigint")
    return results.groupBy("mode").agg(
        F.count("*").cast("bigint").alias("n"),
        F.count_if(passed).cast("bigint").alias("passes"),
        F.count_if(~passed).cast("bigint").alias("failures"),
        filled_mean("post_think_tokens").alias("post_think_tokens_mean"),
        flag("answer_channel_bloat").alias("answer_channel_bloat"),
        filled_mean("code_comment_tokens").alias("code_comment_tokens_mean"),
        flag("comment_bloat").alias("comment_bloat"),
    )


def failure_types(results: DataFrame) -> DataFrame:
    failed = results.where(~F.coalesce(F.col("pass"), F.lit(False)))
    return failed.groupBy("mode", F.coalesce("failure_type", F.lit("unknown_failure")).alias("failure_type")).agg(F.count("*").cast("bigint").alias("n"))


def extraction_methods(results: DataFrame) -> DataFrame:
    return results.groupBy("mode", F.coalesce("extraction_method", F.lit("unknown")).alias("extraction_method")).agg(F.count("*").cast("bigint").alias("n"))


def extraction_issues(results: DataFrame) -> DataFrame:
    """Of issues that are there: a missing one is none.

    Counted, not filtered before: a filter would write the whole extraction out again below its projections.
    """
    there = F.coalesce(F.col("extraction_issue"), F.lit("none")) != "none"
    return results.groupBy("mode", "extraction_issue").agg(F.count_if(there).cast("bigint").alias("n")).where("n > 0")


def wide(results: DataFrame, *columns: str) -> DataFrame:
    """One row a task: for each mode whether it is there, and its columns, by conditional aggregation."""
    made = []
    for m in MODE_NAMES:
        mine = F.col("mode") == m
        made.append(F.count_if(mine).cast("bigint").alias(f"{m}_n"))
        made += [F.max(F.when(mine, F.col(c))).alias(f"{m}_{c}") for c in columns]
    return results.groupBy("ordinal", "task_id").agg(*made)


def results_wide(results: DataFrame) -> DataFrame:
    """One row a task with a struct for each mode; a missing mode is null, of repeated rows the least one counts."""
    names = [c for c in results.columns if c not in ("ordinal", "task_id", "mode", "ix")]
    one = [F.min(F.when(F.col("mode") == m, F.struct(*names))).alias(m) for m in MODE_NAMES]
    return results.groupBy("ordinal", "task_id").agg(*one)


#: The buckets of each check, in order.
CHECKS = {"free_vs_fsm": PAIR_BUCKETS, "prompt_terse_checks": TRIPLE_BUCKETS}


def _buckets(results: DataFrame, *checks: str) -> DataFrame:
    """(check, bucket, bucket_ix, n, task_ids): ids in order; empty buckets stay while the check has any task at all.

    One pivot by task serves all checks: a task goes to a bucket of each that it has the modes for. The ids are the
    result, so a bucket's are one row, as long as the run has problems.
    """
    tasks = wide(results, "pass")
    pair = F.when((F.col("free_n") > 0) & (F.col("fsm_n") > 0), pair_bucket(F.col("free_pass"), F.col("fsm_pass")))
    triple = F.when(pair.isNotNull() & (F.col("prompt_terse_n") > 0), triple_bucket(F.col("free_pass"), F.col("fsm_pass"), F.col("prompt_terse_pass")))
    of = {"free_vs_fsm": pair, "prompt_terse_checks": triple}
    each = tasks.select("ordinal", "task_id", F.explode(F.array(*[F.struct(F.lit(c).alias("check"), of[c].alias("bucket")) for c in checks])).alias("b"))
    found = each.where("b.bucket is not null").groupBy("b.check", "b.bucket").agg(F.array_sort(F.collect_list(F.struct("ordinal", "task_id"))).alias("rows"))
    by_check = found.groupBy("check").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "rows"))).alias("held"))
    names = F.create_map(*[x for c in checks for x in (F.lit(c), F.array(*[F.lit(n) for n in CHECKS[c]]))])
    rows = by_check.select("check", "held", F.posexplode(names[F.col("check")]).alias("bucket_ix", "bucket"))
    ids = F.coalesce(F.transform(F.col("held")[F.col("bucket")], lambda r: r["task_id"]), F.expr("cast(array() as array<string>)"))
    return rows.select("check", "bucket", "bucket_ix", F.size(ids).cast("bigint").alias("n"), ids.alias("task_ids"))


def pair_overlap(results: DataFrame) -> DataFrame:
    return _buckets(results, "free_vs_fsm")


def triple_overlap(results: DataFrame) -> DataFrame:
    return _buckets(results, "prompt_terse_checks")


def outcome_breakdown(results: DataFrame) -> DataFrame:
    return _buckets(results, *CHECKS)


def pass_sets(results: DataFrame) -> DataFrame:
    """Pass sets of free and fsm by set operators: what the pair buckets say in another way."""
    both = wide(results, "pass").where("free_n > 0 and fsm_n > 0")
    every = both.select("task_id")
    free, fsm = both.where("free_pass").select("task_id"), both.where("fsm_pass").select("task_id")
    sets = {"both_pass": free.intersect(fsm), "free_only_pass": free.subtract(fsm), "fsm_only_pass": fsm.subtract(free), "both_fail": every.subtract(free).subtract(fsm)}
    out = None
    for name, rows in sets.items():
        part = rows.select(F.lit(name).alias("bucket"), "task_id")
        out = part if out is None else out.unionByName(part)
    return out


def outcome_tags(results: DataFrame) -> DataFrame:
    tasks = wide(results, "pass")
    return tasks.select("ordinal", "task_id", outcome_tag(F.col("free_pass"), F.col("fsm_pass"), F.col("prompt_terse_pass")).alias("tag"))


def think_compression(results: DataFrame) -> DataFrame:
    """Per task, where both modes have tokens: free over fsm."""
    both = wide(results, "think_tokens").where("free_think_tokens > 0 and fsm_think_tokens > 0")
    return both.select("ordinal", "task_id", F.col("free_think_tokens").alias("free_tokens"), F.col("fsm_think_tokens").alias("fsm_tokens"), (F.col("free_think_tokens") / F.greatest("fsm_think_tokens", F.lit(1))).alias("ratio"))


def modes_present(results: DataFrame) -> DataFrame:
    """(ix, mode, label) of modes with a row, in order."""
    dimension = results.sparkSession.createDataFrame(list(p.MODES), "ix int, mode string, label string")
    return dimension.join(results.select("mode").distinct(), "mode").select("ix", "mode", "label").orderBy("ix")


def counts_by_mode(counts: DataFrame, key: str) -> DataFrame:
    """A histogram (mode, key, n) as a map for each mode."""
    return counts.groupBy("mode").agg(F.map_from_entries(F.collect_list(F.struct(key, "n"))).alias("counts"))


def summary_document(results: DataFrame, args: dict, elapsed: float | None = None) -> dict:
    """The run's summary, from aggregates of a few rows each."""
    out: dict = {"args": args, "modes": [r.mode for r in modes_present(results).collect()], "n": results.select("ordinal", "task_id").distinct().count(), "elapsed_sec": elapsed}
    for r in mode_summary(results).collect():
        out[r.mode] = {k: v for k, v in r.asDict().items() if k not in ("mode", "n")}
    breakdown: dict = {}
    for r in outcome_breakdown(results).orderBy("check", "bucket_ix").collect():
        part = breakdown.setdefault(r.check, {"n": 0})
        part["n"] += r.n
        part[r.bucket] = {"count": r.n, "task_ids": list(r.task_ids)}
    accounting = {r.mode: {k: v for k, v in r.asDict().items() if k != "mode"} for r in failure_accounting(results).collect()}
    for name, counts, key in (("failure_types", failure_types(results), "failure_type"), ("extraction_methods", extraction_methods(results), "extraction_method"), ("extraction_issues", extraction_issues(results), "extraction_issue")):
        for a in accounting.values():
            a[name] = {}
        for r in counts.collect():
            accounting[r["mode"]][name][r[key]] = r["n"]
    return out | {"outcome_breakdown": breakdown, "failure_accounting": accounting}
