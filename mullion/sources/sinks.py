"""Result sinks: JSON lines, a summary document, a Markdown report. All go through Spark's file systems."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_manifest.json"


def write_results(wide: DataFrame, path: str) -> None:
    """One JSON object a row; what a row doesn't have is left out."""
    wide.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def put(spark: SparkSession, path: str, text: str) -> None:
    """A small file in one step: written under another name, then renamed over what is there."""
    fs, at = _file_system(spark, path)
    jvm = spark.sparkContext._jvm
    made = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}-{uuid.uuid4().hex}")
    stream = fs.create(made, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(made), fs.makeQualified(at), options)


def get(spark: SparkSession, path: str) -> str:
    fs, at = _file_system(spark, path)
    stream = fs.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_summary(spark: SparkSession, summary: dict, path: str) -> None:
    put(spark, path, json.dumps(summary, indent=2))


def write_report(sections: DataFrame, header: str, path: str) -> dict:
    """Sections (ordinal, task_id, markdown) in order as the folder `path`; what its manifest says is given back.

    Each task writes the sections of a range of ordinals as a part of its own, in a new folder under `path`; nothing of the
    text passes the driver. The manifest names the parts in order with their lengths and the bytes before them, so any stretch of
    the report can be read alone. It is renamed into its place at the end: until then a reader sees the report
    that was there before, whose parts are deleted afterwards. A run that fails leaves a folder that no manifest names.
    The parts one after another are the report, header first; sections have to end with a line feed.
    """
    spark = sections.sparkSession
    run = f"run-{uuid.uuid4().hex}"
    head = [(0, None, "", header.removesuffix("\n"))] if header else []
    if header and not header.endswith("\n"):
        raise ValueError("the header has to end with a line feed")
    line = F.when(F.endswith("markdown", F.lit("\n")), F.expr("left(markdown, length(markdown) - 1)")).otherwise(F.raise_error(F.lit("a section doesn't end with a line feed")))
    rows = sections.select(F.lit(1).alias("rank"), F.col("ordinal").cast("long").alias("ordinal"), F.col("task_id").cast("string").alias("task_id"), line.alias("value"))
    rows = spark.createDataFrame(head, "rank int, ordinal long, task_id string, value string").unionByName(rows)
    order = ("rank", "ordinal", "task_id")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.option("lineSep", "\n").text(f"{path}/{run}")
    fs, at = _file_system(spark, f"{path}/{run}")
    parts, before = [], 0
    for s in sorted(fs.listStatus(at), key=lambda s: s.getPath().getName()):  # a name a task
        if s.getPath().getName().startswith("part-") and s.getLen():
            parts.append({"file": f"{run}/{s.getPath().getName()}", "offset": before, "bytes": s.getLen()})
            before += s.getLen()
    manifest = {"bytes": before, "parts": parts}
    put(spark, f"{path}/{MANIFEST}", json.dumps(manifest, indent=1))
    fs, at = _file_system(spark, path)
    for s in fs.listStatus(at):
        if s.getPath().getName().startswith("run-") and s.getPath().getName() != run:
            fs.delete(s.getPath(), True)
    return manifest


def report_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(get(spark, f"{path}/{MANIFEST}"))


def report_parts(spark: SparkSession, path: str) -> Iterator[str]:
    """The texts of a report's parts, in order, one at a time."""
    for part in report_manifest(spark, path)["parts"]:
        yield get(spark, f"{path}/{part['file']}")


def read_report(spark: SparkSession, path: str, until: str = "\n---\n") -> DataFrame:
    """(value) of the report's sections, without the line that ends each: rows, not the driver's text."""
    files = [f"{path}/{p['file']}" for p in report_manifest(spark, path)["parts"]]
    return spark.read.option("lineSep", until).text(files) if files else spark.createDataFrame([], "value string")
