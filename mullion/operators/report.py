"""Reports: a Markdown section for each problem, console lines, and lookups of problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mullion.functions import patterns as p
from mullion.functions.classify import outcome_tag
from mullion.functions.text import counts_line, fixed, ids_line, padded, snippet, strip
from mullion.operators.aggregate import comparison, counts_by_mode, extraction_issues, failure_accounting, failure_types

LEGEND = "Outcome legend: 🔺 FSM wins on a problem FREE got wrong · 🔻 FSM regresses vs FREE · 🟰 both pass · ❌ both fail · 🟡/🟠 PROMPT_TERSE-only divergence."


def latest_problems(problems: DataFrame) -> DataFrame:
    """One row a task id, the last by ordinal: no sort, and partial aggregation."""
    names = [c for c in problems.columns if c != "task_id"]
    return problems.groupBy("task_id").agg(F.max_by(F.struct(*names), "ordinal").alias("row")).select("task_id", *[F.col(f"row.{c}").alias(c) for c in names])


def with_problem(results: DataFrame, problems: DataFrame) -> DataFrame:
    """results with the statement of their problem; a problem that isn't there leaves it null. The sizes pick the join."""
    known = latest_problems(problems).select("task_id", F.coalesce(F.nullif("prompt", F.lit("")), "question_content").alias("statement"))
    return results.join(known, "task_id", "left")


def meta_line(failure: Column, issue: Column, method: Column, post: Column, bloat: Column, comments: Column, comment_bloat: Column, entry_found: Column) -> Column:
    """What is worth saying of a result, joined by dots."""
    mark = lambda label, value: F.concat(F.lit(f"{label}: `"), value.cast("string"), F.lit("`"))
    pieces = F.array(
        F.when((failure != "") & (failure != "pass"), mark("failure", failure)),
        F.when((issue != "") & (issue != "none"), mark("extraction", issue)),
        F.when(method != "", mark("method", method)),
        mark("post-think", post),
        F.when(bloat, F.lit("answer channel: `bloat`")),
        mark("comment tokens", comments),
        F.when(comment_bloat, F.lit("comments: `bloat`")),
        F.when(~entry_found, F.lit("entry point: `not found`")),
    )
    return F.array_join(F.array_compact(pieces), " · ")


def section(results: DataFrame, *kept: str) -> DataFrame:
    """(ordinal, task_id, mode, ix, markdown) of each result, and columns to keep."""
    named = {m: label for _, m, label in p.MODES}
    label = F.coalesce(*[F.when(F.col("mode") == m, F.lit(v)) for m, v in named.items()])
    order = F.coalesce(*[F.when(F.col("mode") == m, F.lit(i)) for i, m, _ in p.MODES])
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    flag = lambda c: F.col(c) if c in results.columns else F.lit(None).cast("boolean")
    text = lambda c: F.col(c) if c in results.columns else F.lit(None).cast("string")
    head = F.concat(F.lit("### "), label, F.lit("  "), F.when(F.coalesce("pass", F.lit(False)), "✓ pass").otherwise("✗ fail"), F.lit("  (think: "), number("think_tokens"), F.lit(" tok, total: "), number("total_tokens"), F.lit(" tok)\n"))
    meta = meta_line(F.col("failure_type"), F.col("extraction_issue"), F.col("extraction_method"), F.col("post_think_tokens"), flag("answer_channel_bloat"), F.col("code_comment_tokens"), flag("comment_bloat"), F.col("entry_point_found"))

    def block(name: str, column: Column, fence: str) -> Column:
        return F.when(F.coalesce(column, F.lit("")) != "", F.concat(F.lit(f"_{name}:_\n```{fence}\n"), strip(column), F.lit("\n```\n")))

    parts = F.array(
        head,
        F.when(meta != "", F.concat(F.lit("_meta:_ "), meta, F.lit("\n"))),
        block("error", F.col("err"), "text"),
        block("think", text("extracted_think"), "text"),
        block("code", text("extracted_code"), "python"),
    )
    return results.select("ordinal", "task_id", "mode", order.alias("ix"), F.array_join(F.array_compact(parts), "\n").alias("markdown"), *kept)


def report_sections(results: DataFrame, problems: DataFrame) -> DataFrame:
    """(ordinal, task_id, markdown): heading with the outcome, statement, a section a mode, compression. One aggregation by task."""
    of = lambda mode, c: F.max(F.when(F.col("mode") == mode, F.col(c)))
    passed = [of(m, "pass") for _, m, _ in p.MODES]
    free, fsm = of("free", "think_tokens"), of("fsm", "think_tokens")
    made = section(results, "pass", "think_tokens").groupBy("ordinal", "task_id").agg(
        F.array_sort(F.collect_list(F.struct("ix", "markdown"))).alias("parts"), outcome_tag(*passed).alias("tag"),
        free.alias("free_tokens"), fsm.alias("fsm_tokens"), F.when((free > 0) & (fsm > 0), free / F.greatest(fsm, F.lit(1))).alias("ratio"),
    )
    rows = with_problem(made, problems)
    said = F.when(F.coalesce("statement", F.lit("")) != "", F.concat(F.lit("**Problem:**\n\n```text\n"), snippet(F.col("statement")), F.lit("\n```\n")))
    compression = F.when(F.col("ratio").isNotNull(), F.concat(F.lit("_think compression_: **"), fixed(F.col("ratio"), 2), F.lit("×** ("), F.col("free_tokens").cast("string"), F.lit(" → "), F.col("fsm_tokens").cast("string"), F.lit(" tokens)\n")))
    body = F.concat(F.array(F.concat(F.lit("## "), F.col("task_id"), F.lit(" — "), F.col("tag"), F.lit("\n")), said), F.transform("parts", lambda x: x["markdown"]), F.array(compression, F.lit("---\n")))
    return rows.select("ordinal", "task_id", F.array_join(F.array_compact(body), "\n").alias("markdown"))


def report_header(dataset: str, n: int, model: str, modes: list[str], max_tokens: int, grammar_file: str) -> str:
    return "\n".join([f"# Per-problem mode comparison — {dataset}, n={n}\n", f"**Model:** `{model}`  ", f"**Modes:** {', '.join(modes)}  ", f"**Max tokens:** {max_tokens}  ", f"**Grammar:** `{grammar_file}`  \n", LEGEND + "\n", "---\n", ""])


def breakdown_lines(breakdown: DataFrame) -> DataFrame:
    """(check, bucket_ix, line) of overlaps, as a console shows them."""
    width = F.when(F.col("check") == "free_vs_fsm", 18).otherwise(34)
    return breakdown.select("check", "bucket_ix", F.concat(F.rpad("bucket", width, " "), F.lit(" "), padded(F.col("n").cast("string"), 3), F.lit("  "), ids_line(F.col("task_ids"))).alias("line"))


def status_line(results: DataFrame) -> DataFrame:
    """(ordinal, task_id, line): a mark and the thinking tokens of each mode, then the errors."""
    mode = F.col("mode")
    piece = F.concat(mode, F.lit("="), F.when(F.coalesce("pass", F.lit(False)), "✓").otherwise("✗"), F.lit(" ("), F.coalesce(F.col("think_tokens").cast("string"), F.lit("-")), F.lit("tt)"))
    error = F.when(~F.coalesce("pass", F.lit(False)) & (strip(F.coalesce("err", F.lit(""))) != ""), F.concat(mode, F.lit(": "), F.left(strip(F.col("err")), F.lit(80))))
    order = F.coalesce(*[F.when(mode == m, F.lit(i)) for i, m, _ in p.MODES])
    rows = results.groupBy("ordinal", "task_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("ix"), piece.alias("piece"), error.alias("error")))).alias("rows"))
    errors = F.array_compact(F.transform("rows", lambda r: r["error"]))
    return rows.select("ordinal", "task_id", F.concat(F.array_join(F.transform("rows", lambda r: r["piece"]), "   "), F.when(F.size(errors) > 0, F.concat(F.lit("  |  "), F.array_join(errors, " ; "))).otherwise("")).alias("line"))


def count_lines(by_mode: DataFrame) -> DataFrame:
    return by_mode.select("mode", counts_line(F.col("counts")).alias("line"))


def summary_lines(summary: DataFrame) -> DataFrame:
    """(ix, line) of a mode summary, as a console shows it: a line a mode, then the comparison where free and fsm ran."""
    order = F.coalesce(*[F.when(F.col("mode") == m, F.lit(i)) for i, m, _ in p.MODES])
    label = F.coalesce(*[F.when(F.col("mode") == m, F.lit(v)) for _, m, v in p.MODES])
    mean = lambda name, c: F.concat(F.lit(f"{name} = "), padded(fixed(F.col(f"{c}_mean"), 0), 6), F.lit(" tok"))
    parts = [F.concat(F.lit("pass@1 = "), padded(fixed(F.col("pass_rate") * 100, 1), 5), F.lit("%")), mean("mean think", "think_tokens"), mean("mean total", "total_tokens")]
    parts += [mean("post-think", "post_think_tokens"), mean("comments", "code_comment_tokens")]
    modes = summary.select(order.alias("ix"), F.concat(F.rpad(label, 13, " "), F.lit(":  "), F.concat_ws("   ", *parts)).alias("line"))
    delta = F.concat(F.lit("Accuracy delta (FSM − FREE): "), padded(fixed(F.col("accuracy_delta_pp"), 1, signed=True), 5), F.lit(" pp"))
    ratio = F.concat(F.lit("Think-token compression    : "), padded(fixed(F.col("think_compression"), 2), 5), F.lit("×"))
    both = comparison(summary).where("accuracy_delta_pp is not null")
    at = len(p.MODES)
    return modes.unionByName(both.select(F.inline(F.array(F.struct(F.lit(at).alias("ix"), delta.alias("line")), F.struct(F.lit(at + 1).alias("ix"), ratio.alias("line"))))))


def accounting_lines(results: DataFrame) -> DataFrame:
    """(ix, part, line) of the failure accounting, four lines a mode, as a console shows it."""
    types = counts_by_mode(failure_types(results), "failure_type").select("mode", counts_line(F.col("counts")).alias("types"))
    issues = counts_by_mode(extraction_issues(results), "extraction_issue").select("mode", counts_line(F.col("counts")).alias("issues"))
    rows = failure_accounting(results).join(types, "mode", "left").join(issues, "mode", "left")
    order = F.coalesce(*[F.when(F.col("mode") == m, F.lit(i)) for i, m, _ in p.MODES])
    label = F.rpad(F.coalesce(*[F.when(F.col("mode") == m, F.lit(v)) for _, m, v in p.MODES]), 13, " ")
    blank, said = F.lit(" " * 13), lambda c: F.coalesce(F.col(c), F.lit("-"))
    lines = F.array(
        F.concat(label, F.lit(" failures: "), padded(F.col("failures").cast("string"), 3), F.lit("  "), said("types")),
        F.concat(blank, F.lit(" extraction issues: "), said("issues")),
        F.concat(blank, F.lit(" post-think mean: "), fixed(F.col("post_think_tokens_mean"), 0), F.lit("  bloat: "), F.col("answer_channel_bloat").cast("string")),
        F.concat(blank, F.lit(" comment mean: "), fixed(F.col("code_comment_tokens_mean"), 0), F.lit("  bloat: "), F.col("comment_bloat").cast("string")),
    )
    return rows.select(order.alias("ix"), F.posexplode(lines).alias("part", "line"))
