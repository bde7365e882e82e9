"""What the training-data operators share: the shared folder, lineage cuts, word hashing, components."""

from __future__ import annotations

import contextlib
import contextvars
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow.compute as pc
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java class of the separators that every operator here uses between words.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step hashes at once in a Python worker.
CHUNK_BYTES = 1 << 20
GAP = re.compile(rb"[\x20\x09-\x0D]")
#: Which bytes belong to a word.
IN_WORD = np.array([not GAP.match(bytes([b])) for b in range(256)], np.int8)
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


#: Folders made since the innermost only_result() began; each thread has its own.
_MADE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir; a local one only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    made = _MADE.get()
    if made is not None:
        made.append(path)
    return path


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path:
        path = "file://" + path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def written(df: DataFrame, name: str, **options: int) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts the lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, *paths: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def drop_written(df: DataFrame) -> None:
    """Deletes a table made by written() whose rows are no longer needed."""
    delete(df.sparkSession, *{f.rsplit("/", 1)[0] for f in df.inputFiles()})


@contextlib.contextmanager
def only_result(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes, at the end, the folders made inside the block by its thread; tables appended to the list that it gives stay."""
    made, kept = [], []
    before = _MADE.set(made)
    try:
        yield kept
    finally:
        _MADE.reset(before)
        stay = {f.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") for df in kept for f in df.inputFiles()}
        is_kept = lambda p: p.split(":", 1)[-1].lstrip("/") in stay
        delete(spark, *(p for p in made if not is_kept(p)))
        outer = _MADE.get()
        if outer is not None:
            outer += [p for p in made if is_kept(p)]


def words_of(text: Column | str) -> Column:
    """The words of a text as an array; null: none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def partitions_for(spark: SparkSession, rows: int, per_partition: int) -> int:
    """Shuffle partitions that keep each one under per_partition rows, however large the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition))


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= MIX2
    x ^= x >> np.uint64(29)
    x *= MIX
    x ^= x >> np.uint64(32)
    return x


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of two neighbours: order counts, and the left one is mixed before the right one meets it."""
    return _mixed(_mixed(left * MIX2 + MIX) ^ right)


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words of some texts, one after another, and the n+1 offsets of the texts in them.

    Words of up to seven bytes are a number with their length, mixed one to one: no two of them share a hash. Longer ones
    are hashed by a function without algebraic structure, so no pattern of letters makes two of them agree.
    """
    whole = b" ".join(t or b"" for t in texts)
    hashes, starts, at = [], [], 0
    while at < len(whole):
        cut = GAP.search(whole, at + CHUNK_BYTES) if at + CHUNK_BYTES < len(whole) else None
        end = cut.end() if cut else len(whole)
        part = np.frombuffer(whole, np.uint8, end - at, at)
        inside = np.zeros(len(part) + 2, np.int8)
        inside[1:-1] = IN_WORD[part]
        edge = np.diff(inside)
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(start):
            size = stop - start
            eight = np.ndarray((len(part),), "<u8", np.append(part, np.zeros(8, np.uint8)), strides=(1,))
            bits = np.uint64(8) * np.minimum(size, 7).astype(np.uint64)
            own = _mixed((eight[start] & ((np.uint64(1) << bits) - np.uint64(1))) | (np.minimum(size, 8).astype(np.uint64) << np.uint64(56)))
            long = np.flatnonzero(size > 7)
            own[long] = np.fromiter((xxhash.xxh3_64_intdigest(whole[a:b]) for a, b in zip((start[long] + at).tolist(), (stop[long] + at).tolist(), strict=True)), np.uint64, len(long))
            hashes.append(own)
            starts.append(start + at)
        at = end
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    ends = np.cumsum([len(t or b"") + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    held = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return flat, np.append(0, np.searchsorted(held, ends)).astype(np.int64)


def window_hashes(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """A hash of every window of `size` consecutive hashes (windows over text ends included); another salt, another hash.

    Windows of a power of two are made of two halves each, the rest of such parts: a tree of mixing steps, not a sum of products.
    """
    n = max(0, len(words) - size + 1)
    if not n:
        return np.zeros(0, np.uint64)
    part, width = _mixed(words ^ np.uint64(salt)) if salt else words, 1
    out, done = None, 0
    while True:
        if size & width:
            mine = part[done : done + n]
            out = mine if out is None else _joined(out, mine)
            done += width
        if done == size:
            return _mixed(out + np.uint64(size))
        part, width = _joined(part[:-width], part[width:]), 2 * width


def chunks(column, limit: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Runs of texts (an Arrow column or a list) with about `limit` bytes: (first row, list of bytes)."""
    lengths = [len(t or b"") for t in column] if isinstance(column, list) else pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(lengths):
        held += n
        if held >= limit or i + 1 == len(lengths):
            yield start, column[start : i + 1] if isinstance(column, list) else column.slice(start, i + 1 - start).to_pylist()
            start, held = i + 1, 0


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node of edges (a, b), component the smallest node id that links reach.

    Each round points every node at its smallest neighbour, jumps pointers twice and contracts the edges, so the
    number of nodes at least halves; every round is a written table. Self-loops keep their node; empty: empty.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = written(edges, name)
    labels = None
    while True:
        live = edges.where("a <> b")
        if live.isEmpty():
            break
        both = live.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(live.select(F.col("b").alias("node"), F.col("a").alias("other")))
        parent = both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("up"))
        for _ in range(2):  # the smallest node of a component points at itself, so every pointer has a row
            parent = parent.alias("p").join(parent.alias("q"), F.col("p.up") == F.col("q.node")).select("p.node", F.col("q.up").alias("up"))
        parent = written(parent, name)
        moved = live.join(parent.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a").join(parent.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b")
        moved = written(moved.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).where("a <> b").distinct(), name)
        if labels is None:
            labels = parent.select("node", F.col("up").alias("component"))
        else:
            up = parent.select(F.col("node").alias("component"), "up")
            labels = labels.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        labels = written(labels, name)
        own = edges.where("a = b")
        edges = moved
        if own.isEmpty():
            continue
        alone = own.select(F.col("a").alias("node")).distinct().join(labels, "node", "left_anti")
        labels = written(labels.unionByName(alone.select("node", F.col("node").alias("component"))), name)
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return labels
