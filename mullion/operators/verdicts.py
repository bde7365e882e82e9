"""Test runs that are remembered: a table of verdicts by the digest of program, tests, timeout and memory limit.

Equal programs run once, known ones not at all. What is new runs in two passes. In the first, many programs share a task
and each has a short time; what it doesn't suffice for gets its whole time in the second, over twice as many tasks as
programs, so that hardly two wait for one another. A program is the last thing in its stage before the write: a lost
executor repeats the programs of its unfinished tasks and no others, and a run that failed after the first pass has kept it.

Verdicts are facts about programs that decide by themselves. One that asks for the time or for chance should not be remembered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mullion.operators import sandbox

QUICK = 2.0
PER_TASK = 64
VERDICTS = "digest string, pass boolean, err string, seconds double"
_ASKED = ("program", "name", "cases", "contest")


def known_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """(digest, pass, err) of what has run. Of two runs at once that both told a digest, a pass counts, then the later text."""
    try:
        rows = spark.read.schema(VERDICTS).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], VERDICTS)
    return rows.groupBy("digest").agg(F.max(F.struct("pass", "err")).alias("v")).select("digest", "v.pass", "v.err")


def with_digest(rows: DataFrame, timeout: float, memory_mb: int) -> DataFrame:
    """test_rows() with a digest of all that decides a verdict; JSON keeps the parts apart and nulls out."""
    return rows.withColumn("digest", F.sha2(F.to_json(F.struct(*_ASKED, F.lit(float(timeout)).alias("timeout"), F.lit(memory_mb).alias("memory"))), 256))


def _run(rows: DataFrame, timeout: float, whole: float, memory_mb: int) -> DataFrame:
    """Verdicts of rows; what lasts longer than timeout, and may last longer, has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for b in batches:
            for digest, *asked in zip(b["digest"], *(b[c] for c in _ASKED), strict=True):
                began = time.perf_counter()
                passed, err = sandbox.verdict(*asked, timeout, memory_mb)
                if err != "TIMEOUT" or timeout >= whole:
                    yield pd.DataFrame({"digest": [digest], "pass": [passed], "err": [err], "seconds": [time.perf_counter() - began]})

    return rows.select("digest", *_ASKED).mapInPandas(run, VERDICTS)


def run_known(rows: DataFrame, path: str, timeout: float = sandbox.TIMEOUT, memory_mb: int = sandbox.MEMORY_MB, quick: float = QUICK) -> DataFrame:
    """(task_id, mode, pass, err) of test_rows(), by the table of verdicts at path, to which what is new is added.

    The table belongs in a folder that all executors share. Runs programs when called, not when the result is read.
    """
    spark = rows.sparkSession
    asked = with_digest(rows, timeout, memory_mb)
    once = asked.select("digest", *_ASKED).dropDuplicates(["digest"])
    for seconds, share in ((min(quick, timeout), PER_TASK), (timeout, 0.5)):
        new = once.join(known_verdicts(spark, path).select("digest"), "digest", "left_anti")
        n = new.count()
        if n == 0:
            break
        _run(new.repartition(math.ceil(n / share), "digest"), seconds, timeout, memory_mb).write.mode("append").parquet(path)
    return asked.select("task_id", "mode", "digest").join(known_verdicts(spark, path), "digest").select("task_id", "mode", "pass", "err")
