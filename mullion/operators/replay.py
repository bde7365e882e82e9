"""Replay of two runs side by side: what each has said at every frame of a common clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mullion.operators.compare import horizon

SIDES = ("left", "right")


def chunks_shown(at: Column, seconds: Column, n: Column) -> Column:
    """How many of n chunks are shown at a time: evenly over the pane's seconds, none before it begins, all after its end."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), at / F.greatest(seconds, F.lit(0.001)))) * n).cast("long")


def replay_frames(left: DataFrame, right: DataFrame, step: float) -> DataFrame:
    """(task_id, frame, at, left_length, right_length) of tasks that both runs (task_id, pane) have: lengths of the texts shown.

    Frames come every `step` seconds from 0 up to the first one at or after the later pane's end. A pane's chunks, in
    order, and the frames of its side, each placed after the chunks that it shows, are one sequence; a running sum of the chunks' lengths
    over it is the as-of join of frames to chunks. All is dealt out by task once, in the join of the runs. Chunks keep only
    their lengths; a task in one run alone isn't there; of repeated tasks each pair is a replay, so give unique ones.
    """
    pane = lambda p: F.struct(F.col(f"{p}.seconds").alias("seconds"), F.transform(f"{p}.chunks", lambda c: F.length(c)).alias("sizes"))
    both = left.select("task_id", pane("pane").alias("left")).join(right.select("task_id", pane("pane").alias("right")), "task_id")
    last = F.ceil(horizon(F.col("left.seconds"), F.col("right.seconds")) / F.lit(step)).cast("long")
    frames = F.sequence(F.lit(0).cast("long"), last)

    def sequence_of(side: str) -> Column:
        chunk = F.transform(F.col(f"{side}.sizes"), lambda n, k: F.struct((k + 1).cast("long").alias("place"), F.lit(None).cast("long").alias("frame"), n.cast("long").alias("size")))
        shown = lambda f: chunks_shown(f * F.lit(step), F.col(f"{side}.seconds"), F.size(f"{side}.sizes"))
        return F.concat(chunk, F.transform(frames, lambda f: F.struct(shown(f).alias("place"), f.alias("frame"), F.lit(0).cast("long").alias("size"))))

    parts = F.array(*[F.struct(F.lit(s).alias("side"), sequence_of(s).alias("rows")) for s in SIDES])
    rows = both.select("task_id", F.explode(parts).alias("p")).select("task_id", "p.side", F.inline("p.rows"))
    upto = Window.partitionBy("task_id", "side").orderBy("place", F.col("frame").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("length", F.sum("size").over(upto)).where("frame is not null")
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("length"))).alias(f"{side}_length")
    return rows.groupBy("task_id", "frame").agg((F.first("frame") * F.lit(step)).alias("at"), *[of(s) for s in SIDES])
