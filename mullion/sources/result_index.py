"""An index beside a results file: one id's row is read without a scan of the file.

A results file is a folder of JSON lines. The index, in `<folder>.index`, holds for each line the digest of its task id, the
file, the byte where the line begins and its length, in buckets by digest and sorted within them, and the length and time
of each file that it was made of. A lookup prunes to a bucket and, by the statistics of its row groups, to the rows of one
digest, and then reads the bytes of one line. What it reads doesn't grow with the results.

Lines are counted where they are read: within a part of a file they come in order, and a part begins where the one before it
ended, so offsets are sums of lengths within parts, and of parts within files; no file is read by one task for that.

The first row of an id counts, by the names of the files, then by line. An index is stale when a file has gone, has come, or has another length
or time; then, and where there is no index, the lookup scans, with the same answer. Blank lines are skipped, a line that
is no JSON or has no id can't be found. Ids compare as texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mullion.sources.schemas import RESULT_ROWS

#: Lines of a bucket, and bytes of a row group: what a lookup reads at most of the index, some.
BUCKET_LINES, GROUP_BYTES = 1_000_000, 1 << 20
MODES = [f.name for f in RESULT_ROWS.fields if f.name not in ("ordinal", "task_id")]


def index_path(path: str) -> str:
    return f"{path.rstrip('/')}.index"


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def files_of(spark: SparkSession, path: str) -> dict[str, tuple[int, int]]:
    """Length and time of the data files of a folder (or of one file), by name; names alone, nothing is read."""
    fs, at = _file_system(spark, path)
    found = {}
    for s in fs.listStatus(at):
        name = s.getPath().getName()
        if s.isFile() and not name.startswith(("_", ".")):
            found[name] = (s.getLen(), s.getModificationTime())
    return found


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, part) of each line, its carriage return included."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("part"))


def _within_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds `at`, the bytes of the part's lines before each line."""
    part, before = None, 0
    for b in batches:
        size = b.column("size").to_numpy() + 1
        own = list(zip(b.column("file").to_pylist(), b.column("part").to_pylist(), strict=True))
        at = np.zeros(len(own), np.int64)
        cuts = [0, *[k for k in range(1, len(own)) if own[k] != own[k - 1]], len(own)] if own else []
        for x, y in zip(cuts, cuts[1:], strict=False):
            if own[x] != part:
                part, before = own[x], 0
            ends = before + np.cumsum(size[x:y])
            at[x:y] = ends - size[x:y]
            before = int(ends[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], [*b.schema.names, "at"])


def digest(task_id: Column) -> Column:
    return F.xxhash64(task_id)


def build_index(spark: SparkSession, path: str) -> str:
    """Writes the index of a results folder, over an older one; its path is given back."""
    files = files_of(spark, path)
    rows = _lines(spark, path).select(F.get_json_object("value", "$.task_id").alias("task_id"), "file", "part", F.octet_length("value").cast("long").alias("size"))
    made = rows.mapInArrow(_within_parts, "task_id string, file string, part bigint, size bigint, at bigint")
    folder = index_path(path)
    made.write.mode("overwrite").parquet(f"{folder}/lines")
    lines = spark.read.schema(made.schema).parquet(f"{folder}/lines")
    # One row for each part of a file: a part is read by one task, so there are few.
    parts = lines.groupBy("file", "part").agg(F.max(F.col("at") + F.col("size") + 1).alias("bytes"))
    before = F.sum("bytes").over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("file", "part", F.coalesce(before, F.lit(0)).alias("base"))
    buckets = max(1, -(-lines.count() // BUCKET_LINES))
    placed = lines.where("task_id is not null").join(F.broadcast(parts), ["file", "part"]).select(
        digest(F.col("task_id")).alias("digest"), "task_id", "file", (F.col("base") + F.col("at")).alias("offset"), "size"
    )
    placed = placed.withColumn("bucket", F.pmod("digest", F.lit(buckets)))
    placed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "digest", "file", "offset").write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).partitionBy("bucket").parquet(f"{folder}/places")
    made_of = spark.createDataFrame([(n, *x, buckets) for n, x in files.items()], "file string, length bigint, time bigint, buckets int")
    made_of.coalesce(1).write.mode("overwrite").parquet(f"{folder}/files")
    fs, at = _file_system(spark, f"{folder}/lines")
    fs.delete(at, True)
    return folder


def place_of(spark: SparkSession, path: str, task_id: str) -> tuple[str, int, int] | None:
    """(file, offset, length) of the first line of an id, None if the index has none; LookupError where it can't be used."""
    folder = index_path(path)
    fs, at = _file_system(spark, f"{folder}/files/_SUCCESS")
    if not fs.exists(at):
        raise LookupError("there is no index")
    made_of = spark.read.parquet(f"{folder}/files").collect()  # a row a file
    if {r.file: (r.length, r.time) for r in made_of} != files_of(spark, path):
        raise LookupError("the index is of other files")
    if not made_of:
        return None
    number = spark.range(1).select(digest(F.lit(task_id)).alias("d"), F.pmod(digest(F.lit(task_id)), F.lit(made_of[0].buckets)).alias("b")).first()
    places = spark.read.schema("digest bigint, task_id string, file string, offset bigint, size bigint, bucket int").parquet(f"{folder}/places")
    found = places.where((F.col("bucket") == number.b) & (F.col("digest") == number.d) & (F.col("task_id") == task_id))
    first = found.agg(F.min(F.struct("file", "offset", "size")).alias("first")).first().first
    return tuple(first) if first else None


def read_line(spark: SparkSession, path: str, file: str, offset: int, size: int) -> str:
    """Some bytes of a file of the folder (or of the file itself), through Spark's file systems."""
    fs, at = _file_system(spark, path)
    whole = at if fs.getFileStatus(at).isFile() else spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at, file)
    stream = fs.open(whole)
    try:
        stream.seek(offset)
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)).decode()
    finally:
        stream.close()


def scan_for(spark: SparkSession, path: str, task_id: str) -> str | None:
    """The first line of an id by reading all of them."""
    rows = _lines(spark, path).withColumn("row", F.monotonically_increasing_id())  # rises within a part, and parts are in order by themselves
    found = rows.where(F.get_json_object("value", "$.task_id") == task_id)
    first = found.agg(F.min_by("value", F.struct("file", "part", "row")).alias("value")).first()
    return first.value


def find_result(spark: SparkSession, path: str, task_id: str | int, mode: str) -> DataFrame:
    """(task_id, mode, ...) of the first row of an id: by the index if there is one that fits, else by a scan."""
    task_id = str(task_id)
    try:
        place = place_of(spark, path, task_id)
        line = read_line(spark, path, *place) if place else None
    except LookupError:
        line = scan_for(spark, path, task_id)
    if line is None:
        raise LookupError(f"task {task_id!r} not found")
    row = spark.createDataFrame([(line,)], "value string").select(F.from_json("value", RESULT_ROWS).alias("r")).select("r.ordinal", "r.task_id", *[F.col(f"r.{m}") for m in MODES])
    if mode not in MODES or row.where(F.col(mode).isNotNull()).isEmpty():
        raise LookupError(f"task {task_id!r} has no mode {mode!r}")
    return row.select("ordinal", F.lit(task_id).alias("task_id"), F.lit(mode).alias("mode"), f"{mode}.*")
