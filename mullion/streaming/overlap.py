"""Overlap of modes over a stream of results: a task's modes wait for one another, and its bucket of each check is told once.

State is one row a task: which modes have come, with what verdict, and what was told. A task is told a check as soon as the modes of
that check have come; a task that still lacks a mode `patience` after its last row, in event time, is given out as missing,
with the modes that it lacks, and forgotten. So state holds the tasks of some time and not of the whole stream. Rows that
come once the watermark has passed them are dropped by Spark; a task can't be told twice. With a checkpoint and a sink
that keeps to batch ids, a restart repeats and loses nothing.

Cases: equal rows again, in any order: told once; different verdicts of a mode before its check is told: a pass counts, as
in the batch aggregates, later ones change nothing; a null verdict has come, but has no bucket, as in the batch; a null or unknown mode is
ignored; a null task id is a task of its own; rows without event time never time out of themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from mullion.functions.classify import pair_bucket, triple_bucket
from mullion.functions.patterns import MODES

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
RESULT_STREAM = "ordinal bigint, task_id string, mode string, pass boolean, at timestamp"
NAMES = [m for _, m, _ in MODES]
#: The modes that each check waits for.
CHECKS = {"free_vs_fsm": ("free", "fsm"), "prompt_terse_checks": ("free", "fsm", "prompt_terse")}
TOLD = "ordinal bigint, task_id string, `check` string, free boolean, fsm boolean, prompt_terse boolean, missing array<string>"
NOT_COME, NO_VERDICT = -2, -1


class Waiting(StatefulProcessor):
    """Keeps a task until its modes have come or its patience is at an end."""

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", ", ".join(f"{m} int" for m in NAMES) + ", told int, ends bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.seen.get()
        *verdicts, told, ends = held if held else (*[NOT_COME] * len(NAMES), 0, None)
        last = None
        for r in rows:
            if r["mode"] in NAMES:
                k = NAMES.index(r["mode"])
                verdicts[k] = max(verdicts[k], NO_VERDICT if r["pass"] is None else int(r["pass"]))
            if r["at_ms"] is not None:
                last = int(r["at_ms"]) if last is None else max(last, int(r["at_ms"]))
        come = dict(zip(NAMES, verdicts, strict=True))
        for k, (check, modes) in enumerate(CHECKS.items()):
            if not told >> k & 1 and all(come[m] > NO_VERDICT for m in modes):
                told |= 1 << k
                yield self.row(key, check, come, None)
        if last is not None and (ends is None or last + self.patience > ends):
            if ends is not None:
                self.handle.deleteTimer(ends)
            ends = last + self.patience
            self.handle.registerTimer(ends)
        self.seen.update((*verdicts, told, ends))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        held = self.seen.get()
        if held:
            come = dict(zip(NAMES, held, strict=False))
            missing = [m for m in NAMES if come[m] == NOT_COME]
            if missing:
                yield self.row(key, None, come, missing)
            self.seen.clear()

    @staticmethod
    def row(key, check: str | None, come: dict[str, int], missing: list[str] | None) -> Row:
        return Row(ordinal=key[0], task_id=key[1], check=check, **{m: bool(v) if v > NO_VERDICT else None for m, v in come.items()}, missing=missing)


def overlap_stream(results: DataFrame, patience: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(ordinal, task_id, check, bucket, missing) of a stream of results with event time `at`; the check is null where modes are missing.

    Rows of a check and missing tasks are one stream, so one checkpoint holds for both; told() and missing() part them.
    """
    spark = results.sparkSession
    if spark.conf.get(PROVIDER_KEY) != PROVIDER:
        raise ValueError(f"keyed state with timers needs {PROVIDER_KEY}={PROVIDER}")
    patience_ms = spark.sql(f"SELECT unix_millis(timestamp_seconds(0) + INTERVAL {patience}) AS ms").first().ms
    rows = results.select("ordinal", "task_id", "mode", "pass", "at", F.unix_millis("at").alias("at_ms")).withWatermark("at", late)
    made = rows.groupBy("ordinal", "task_id").transformWithState(Waiting(patience_ms), TOLD, "Append", "EventTime")
    bucket = F.when(F.col("check") == "free_vs_fsm", pair_bucket(F.col("free"), F.col("fsm"))).when(F.col("check") == "prompt_terse_checks", triple_bucket(F.col("free"), F.col("fsm"), F.col("prompt_terse")))
    return made.select("ordinal", "task_id", "check", bucket.alias("bucket"), "missing")


def told(rows: DataFrame) -> DataFrame:
    return rows.where("check is not null and bucket is not null").drop("missing")


def missing(rows: DataFrame) -> DataFrame:
    return rows.where("missing is not null").select("ordinal", "task_id", "missing")


def with_timers(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams may keep such state; the given one stays as it is."""
    own = spark.newSession()
    own.conf.set(PROVIDER_KEY, PROVIDER)
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    return own


def replay(results: DataFrame, folder: str, patience: str = "1 hour", late: str = "10 minutes", files_per_trigger: int = 4) -> DataFrame:
    """Whole results as a stream: written to folder/in, run to the end from there with the checkpoint in folder/state, read back from folder/out.

    Run again on the same folder it goes on where it ended.
    """
    spark = with_timers(results.sparkSession)
    results.write.mode("append").parquet(f"{folder}/in")
    run_replay(spark, folder, patience, late, files_per_trigger)
    return results.sparkSession.read.schema("ordinal bigint, task_id string, `check` string, bucket string, missing array<string>").parquet(f"{folder}/out")


def run_replay(spark: SparkSession, folder: str, patience: str, late: str, files_per_trigger: int) -> None:
    source = spark.readStream.schema(RESULT_STREAM).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/in")
    run = overlap_stream(source, patience, late).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
