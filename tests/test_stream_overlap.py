import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from mullion.operators import aggregate as a
from mullion.streaming import overlap

START = dt.datetime(2025, 1, 1)


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, overlap.RESULT_STREAM).repartition(parts)


def batch(rows):
    found = a.outcome_breakdown(rows).select("check", "bucket", F.explode("task_ids").alias("task_id"))
    return sorted((r.check, r.bucket, r.task_id) for r in found.collect())


def told(out):
    return sorted((r.check, r.bucket, r.task_id) for r in overlap.told(out).collect())


def some_rows(n=60):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        for m in overlap.NAMES:
            if rng.random() < 0.85:
                rows.append((i, f"t{i}", m, rng.choice([True, False, False, None]) if rng.random() < 0.3 else rng.random() < 0.5, START + dt.timedelta(minutes=i)))
    rng.shuffle(rows)
    return rows


def test_any_order_with_repeats_and_a_restart_equals_the_batch(spark, tmp_path):
    rows = some_rows()
    every = frame(spark, rows)
    half, rest = rows[: len(rows) // 2], rows[len(rows) // 2 :]
    overlap.replay(frame(spark, half + half[:20]), f"{tmp_path}/run", late="2 days", files_per_trigger=1)
    first = told(spark.read.schema("ordinal bigint, task_id string, `check` string, bucket string, missing array<string>").parquet(f"{tmp_path}/run/out"))
    out = overlap.replay(frame(spark, rest + half + [(7, "t7", "unknown", True, START), (7, "t7", None, True, START)]), f"{tmp_path}/run", late="2 days", files_per_trigger=2)
    assert told(out) == batch(every)
    assert set(first) < set(told(out))
    assert overlap.missing(out).count() == 0
    overlap.run_replay(overlap.with_timers(spark), f"{tmp_path}/run", "1 hour", "2 days", 2)  # nothing new: nothing more
    assert told(spark.read.parquet(f"{tmp_path}/run/out")) == batch(every)


def test_missing_modes_time_out_and_late_rows_change_nothing(spark, tmp_path):
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    rows = [(1, "a", "free", True, at(0)), (1, "a", "fsm", False, at(30)), (2, "b", "fsm", True, at(10)), (3, "c", "free", True, at(200)), (4, "d", "free", True, at(0)), (4, "d", "fsm", True, at(1)), (4, "d", "prompt_terse", True, at(2)), (5, None, "free", None, at(3))]
    overlap.replay(frame(spark, rows, 1), f"{tmp_path}/run", "60 minutes", "10 minutes")
    # after the watermark: a's third mode and a repeat of d come too late, c's second mode in time
    more = [(1, "a", "prompt_terse", True, at(40)), (4, "d", "free", True, at(0)), (3, "c", "fsm", True, at(210)), (6, "e", "free", True, at(900))]
    out = overlap.replay(frame(spark, more, 1), f"{tmp_path}/run", "60 minutes", "10 minutes")
    assert sorted((r.task_id or "", r.missing) for r in overlap.missing(out).collect()) == [("", ["fsm", "prompt_terse"]), ("a", ["prompt_terse"]), ("b", ["free", "prompt_terse"]), ("c", ["prompt_terse"])]
    assert told(out) == [("free_vs_fsm", "both_pass", "c"), ("free_vs_fsm", "both_pass", "d"), ("free_vs_fsm", "free_only_pass", "a"), ("prompt_terse_checks", "all_pass", "d")]


def test_a_session_without_the_state_store_is_an_error(spark):
    rows = spark.readStream.format("rate").load().selectExpr("value AS ordinal", "'t' AS task_id", "'free' AS mode", "true AS pass", "timestamp AS at")
    with pytest.raises(ValueError, match="stateStore.providerClass"):
        overlap.overlap_stream(rows)
    assert spark.conf.get(overlap.PROVIDER_KEY) != overlap.PROVIDER
