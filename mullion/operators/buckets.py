"""Overlap buckets of any size: their first ids and their number, and their ids as ranked rows; never one row a bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mullion.functions.classify import pair_bucket, triple_bucket
from mullion.functions.text import padded
from mullion.operators.aggregate import CHECKS, wide
from mullion.sources.scratch import scratch_folder

#: Ids that a console line shows; ids of a page.
SHOWN, PAGE = 16, 1000


def members(results: DataFrame) -> DataFrame:
    """(check, bucket, ordinal, task_id): a row for each check that a task has the modes and a bucket for. One pivot by task."""
    tasks = wide(results, "pass")
    pair = F.when((F.col("free_n") > 0) & (F.col("fsm_n") > 0), pair_bucket(F.col("free_pass"), F.col("fsm_pass")))
    triple = F.when(pair.isNotNull() & (F.col("prompt_terse_n") > 0), triple_bucket(F.col("free_pass"), F.col("fsm_pass"), F.col("prompt_terse_pass")))
    each = F.array(*[F.struct(F.lit(c).alias("check"), b.alias("bucket")) for c, b in zip(CHECKS, (pair, triple), strict=True)])
    return tasks.select("ordinal", "task_id", F.explode(each).alias("b")).where("b.bucket is not null").select("b.check", "b.bucket", "ordinal", "task_id")


def bucket_heads(rows: DataFrame, shown: int = SHOWN) -> DataFrame:
    """(check, bucket, bucket_ix, n, ids): the number of members and the first ids in order; empty buckets of a check with members stay.

    The first members are a ranked window below a limit, which Spark applies within partitions before it shuffles: a
    bucket's shuffle is at most `shown` rows a partition. Counts are a partial aggregate.
    """
    order = Window.partitionBy("check", "bucket").orderBy("ordinal", "task_id")
    first = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= shown)
    heads = first.groupBy("check", "bucket").agg(F.array_sort(F.collect_list(F.struct("rank", "task_id"))).alias("ids"))
    counts = rows.groupBy("check", "bucket").agg(F.count("*").alias("n"))
    known = [(c, b, k) for c, names in CHECKS.items() for k, b in enumerate(names)]
    names = rows.sparkSession.createDataFrame(known, "check string, bucket string, bucket_ix int")
    names = names.join(counts.select("check").distinct(), "check", "left_semi")
    ids = F.coalesce(F.transform("ids", lambda x: x["task_id"]), F.expr("cast(array() as array<string>)"))
    return names.join(counts, ["check", "bucket"], "left").join(heads, ["check", "bucket"], "left").select("check", "bucket", "bucket_ix", F.coalesce("n", F.lit(0)).alias("n"), ids.alias("ids"))


def head_lines(heads: DataFrame, shown: int = SHOWN) -> DataFrame:
    """(check, bucket_ix, line) as a console shows them: the first ids, then how many more there are."""
    width = F.when(F.col("check") == "free_vs_fsm", 18).otherwise(34)
    more = F.when(F.col("n") > shown, F.concat(F.lit(", ... (+"), (F.col("n") - shown).cast("string"), F.lit(")"))).otherwise("")
    said = F.when(F.col("n") > 0, F.concat(F.array_join("ids", ", "), more)).otherwise("-")
    return heads.select("check", "bucket_ix", F.concat(F.rpad("bucket", width, " "), F.lit(" "), padded(F.col("n").cast("string"), 3), F.lit("  "), said).alias("line"))


def ranked(rows: DataFrame, page: int = PAGE) -> DataFrame:
    """(check, bucket, rank, page, task_id): all members with their place in order, from 1, and the page that they are on.

    Members are written once, sorted by ranges of (check, bucket, ordinal, task_id); a rank is the place within the range and
    the members of the bucket in earlier ranges, which are a row for each range and bucket. No bucket is sorted by one task.
    """
    spark = rows.sparkSession
    order = ["check", "bucket", "ordinal", "task_id"]
    path = scratch_folder(spark, "members")
    rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()).write.parquet(path)
    held = spark.read.schema(rows.select(*order).withColumn("range", F.lit(0)).schema).parquet(path)
    counts = held.groupBy("check", "bucket", "range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("check", "bucket").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("check", "bucket", "range", before.alias("before"))
    within: Column = F.row_number().over(Window.partitionBy("check", "bucket", "range").orderBy("ordinal", "task_id"))
    out = held.withColumn("within", within).join(F.broadcast(starts), ["check", "bucket", "range"])
    rank = F.col("before") + F.col("within")
    return out.select("check", "bucket", rank.alias("rank"), F.floor((rank - 1) / page).alias("page"), "task_id")
