"""Comparing two runs of a task: point lookups, pairs of runs, replay payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mullion.functions.text import chunks, escape_script


def lookup(results: DataFrame, task_id: str, mode: str) -> DataFrame:
    """The first row of a task and mode; ids compare as texts."""
    found = results.where((F.col("task_id").cast("string") == str(task_id)) & (F.col("mode") == mode))
    return found.orderBy("ordinal").limit(1)


def require_result(results: DataFrame, task_id: str, mode: str) -> DataFrame:
    found = lookup(results, task_id, mode)
    if found.isEmpty():
        known = not results.where(F.col("task_id").cast("string") == str(task_id)).isEmpty()
        raise LookupError(f"task {task_id!r} has no mode {mode!r}" if known else f"task {task_id!r} not found")
    return found


def require_pair(left: DataFrame, right: DataFrame, task_id: str, left_mode: str, right_mode: str) -> DataFrame:
    """The first row of a task on each side (side, ...); a side that doesn't have it is an error that names the side."""
    found = []
    for side, rows, mode in (("left", left, left_mode), ("right", right, right_mode)):
        try:
            found.append(require_result(rows, task_id, mode).withColumn("side", F.lit(side)))
        except LookupError as e:
            raise LookupError(f"{side} run: {e}") from e
    return found[0].unionByName(found[1], allowMissingColumns=True)


def first_rows(results: DataFrame) -> DataFrame:
    """One row for each task and mode, the first by ordinal."""
    names = [c for c in results.columns if c not in ("task_id", "mode")]
    return results.groupBy("task_id", "mode").agg(F.min_by(F.struct(*names), "ordinal").alias("row")).select("task_id", "mode", *[F.col(f"row.{c}").alias(c) for c in names])


def pair_runs(left: DataFrame, right: DataFrame, left_mode: str, right_mode: str, *columns: str) -> DataFrame:
    """Tasks that both runs have, with columns of each side."""
    side = lambda df, mode, name: first_rows(df.where(F.col("mode") == mode)).select("task_id", *[F.col(c).alias(f"{name}_{c}") for c in columns])
    return side(left, left_mode, "left").join(side(right, right_mode, "right"), "task_id")


def pane(label: Column, mode: Column, text: Column, err: Column, total: Column, seconds: Column | None, tps: float) -> Column:
    """What a replay pane shows: text, else error; its chunks; tokens, else chunks; given or derived seconds."""
    said = F.coalesce(F.nullif(text, F.lit("")), F.nullif(err, F.lit("")), F.lit(""))
    pieces = chunks(said)
    tokens = F.coalesce(F.nullif(total, F.lit(0)), F.greatest(F.lit(1), F.size(pieces))).cast("bigint")
    took = tokens / F.lit(max(tps, 0.001)) if seconds is None else F.coalesce(seconds, tokens / F.lit(max(tps, 0.001)))
    return F.struct(label.alias("label"), mode.alias("mode"), tokens.alias("total_tokens"), took.cast("double").alias("seconds"), pieces.alias("chunks"))


def script_payload(payload: Column) -> Column:
    return escape_script(F.to_json(payload))


def horizon(left_seconds: Column, right_seconds: Column) -> Column:
    return F.greatest(left_seconds, right_seconds)
