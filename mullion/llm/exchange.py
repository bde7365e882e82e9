"""Exact counts of hashes over a whole corpus, told back to the texts that the hashes came from, without moving texts.

Texts are written once with a chunk number (some CHUNK_BYTES of text each). Every chunk sends its distinct hashes, packed
as sorted differences, to ranges of the hash space; a range adds them up and sends back, by chunk, those that a rule
keeps, with their counts. What comes back lies in the shared folder by chunk, so whoever works on a chunk's texts reads
just that. Hashes go with as many of their leading bits as tell apart the hashes of this corpus, so a hash costs some
2.5 to 3.5 bytes, and ranges grow in number with the corpus: nothing has a fixed size. A hash in very many texts is one entry a chunk.

Cases: null and empty texts have no hashes; an empty table has no chunks; equal rows are in their chunks one by one.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from mullion.llm.common import chunks, delete, fresh_path, open_fs, partitions_for, written

#: Bytes of text of a chunk; hashes that a task holds before it sends them; hashes of a range.
CHUNK_BYTES, HELD, PER_RANGE = 32 << 20, 4_000_000, 4_000_000
HEAD = struct.Struct("<qQBB")
SENT = pa.schema([("range", pa.int32()), ("chunk", pa.int64()), ("packed", pa.binary())])


def chunked(docs: DataFrame, name: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """docs (with `text` in bytes), written, with the columns `size` of a text in bytes and `chunk`."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, before = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            size = b.column(at).combine_chunks() if isinstance(b.column(at), pa.ChunkedArray) else b.column(at)
            size = np.array([len(t) if t is not None else 0 for t in size.to_pylist()], np.int64)
            ends = before + np.cumsum(size)
            chunk = first + (ends - size) // limit
            before = int(ends[-1]) if len(ends) else before
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(size), pa.array(chunk)], [*b.schema.names, "size", "chunk"])

    schema = StructType([*docs.schema.fields, StructField("size", LongType()), StructField("chunk", LongType())])
    return written(docs.mapInArrow(run, schema), name, **{"parquet.block.size": limit // 4})  # a file is read by several tasks


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of (..., text, chunk) in pieces of one chunk and some MB of text each."""
    for b in batches:
        chunk = b.column("chunk").to_numpy()
        for piece in np.split(np.arange(len(chunk)), np.flatnonzero(np.diff(chunk)) + 1):
            if len(piece):
                part = b.slice(int(piece[0]), len(piece))
                for start, texts in chunks(part.column("text")):
                    yield int(chunk[piece[0]]), part.slice(start, len(texts))


# -- packing ----------------------------------------------------------------------------------------------------------


def _planes(x: np.ndarray) -> tuple[int, bytes]:
    """Unsigned numbers as planes of bytes, as many as the largest needs."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return width, x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _numbers(data: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width).reshape(width, n).T
    return out.view("<u8").ravel()


def pack(values: np.ndarray, counts: np.ndarray, marks: np.ndarray) -> bytes:
    """Sorted distinct values with a count and a mark each."""
    first = int(values[0]) if len(values) else 0
    wide, steps = _planes(np.diff(values, prepend=values[:1]))
    narrow, n = _planes(counts)
    return HEAD.pack(len(values), first, wide, narrow) + zstandard.compress(steps + n + np.packbits(marks).tobytes(), 1)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size, first, wide, narrow = HEAD.unpack_from(data)
    plain = zstandard.decompress(data[HEAD.size :])
    values = np.uint64(first) + np.cumsum(_numbers(plain, size, wide), dtype=np.uint64)
    marks = np.unpackbits(np.frombuffer(plain, np.uint8, offset=size * (wide + narrow)), count=size).astype(bool)
    return values, _numbers(plain[size * wide :], size, narrow), marks


def bits_for(hashes: int) -> int:
    """Leading bits of which some thousandth of the hashes share theirs with another hash."""
    return min(63, max(16, hashes.bit_length() + 10))


# -- there and back ---------------------------------------------------------------------------------------------------


def _sent(found: Iterator[tuple[int, np.ndarray, np.ndarray | None]], bits: int, ranges: int, most: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size, at = 0, 0

    def send() -> pa.RecordBatch:
        values = np.sort(np.concatenate(held))
        start = np.flatnonzero(np.append(True, values[1:] >> np.uint64(1) != values[:-1] >> np.uint64(1)))
        ends = np.append(start[1:], len(values))
        counts, marks, values = (ends - start).astype(np.uint64), (values[ends - 1] & np.uint64(1)).astype(bool), values[start] >> np.uint64(1)
        high = values >> np.uint64(bits - 32) if bits >= 32 else values << np.uint64(32 - bits)
        own = (high * np.uint64(ranges)) >> np.uint64(32)
        cut = np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(own)).tolist()
        packed = [pack(values[x:y], counts[x:y], marks[x:y]) for x, y in zip(cut, cut[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(own[cut[:-1]].astype(np.int32)), pa.array([at] * len(packed), pa.int64()), pa.array(packed, pa.binary())], schema=SENT)

    for chunk, hashes, marks in found:
        if held and (chunk != at or size >= most):
            yield send()
            held, size = [], 0
        at = chunk
        if len(hashes):
            low = np.uint64(0) if marks is None else marks.astype(np.uint64)
            held.append(((hashes >> np.uint64(64 - bits)) << np.uint64(1)) | low)
            size += len(hashes)
    if held:
        yield send()


def tell(src: DataFrame, of: Callable, keep: Callable, hashes: int, bits: int, name: str, most: int = HELD) -> str:
    """Sends hashes there and back; the folder of what came back, for told().

    of(batches) gives (chunk, hashes, marks or none) of some texts; keep(counts, marked) chooses hashes by how often
    they occur in all chunks and whether any occurrence was marked. `hashes` is about how many there are, `most` how many a
    task holds at once.
    """
    spark = src.sparkSession
    ranges = partitions_for(spark, hashes, PER_RANGE)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sent(of(batches), bits, ranges, most)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, parts = [], []
        for b in batches:
            chunk += b.column("chunk").to_pylist()
            parts += [unpack(p) for p in b.column("packed").to_pylist()]
        if not parts:
            return
        values, counts, marks = (np.concatenate(x) for x in zip(*parts, strict=True))
        edges = np.append(0, np.cumsum([len(p[0]) for p in parts])).tolist()
        order = np.argsort(values, kind="stable")
        values_ = values[order]
        start = np.flatnonzero(np.append(True, values_[1:] != values_[:-1]))
        total = np.add.reduceat(counts[order], start)
        good = keep(total, np.logical_or.reduceat(marks[order], start))
        group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(values))))
        kept, all_ = np.zeros(len(values), bool), np.zeros(len(values), np.uint64)
        kept[order], all_[order] = good[group], total[group]
        for c, x, y in zip(chunk, edges, edges[1:], strict=False):
            mine = np.flatnonzero(kept[x:y]) + x
            if len(mine):
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([pack(values[mine], all_[mine], marks[mine])], pa.binary())], ["chunk", "packed"])

    sent = src.mapInArrow(send, "range int, chunk bigint, packed binary").repartitionById(ranges, F.col("range"))
    path = fresh_path(spark, name)
    back = sent.mapInArrow(add, "chunk bigint, packed binary")
    back.repartition(partitions_for(spark, hashes, 8 * PER_RANGE), "chunk").write.partitionBy("chunk").option("compression", "none").parquet(path)
    return path


def told(path: str, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, counts) of the hashes of a chunk that were kept, values sorted."""
    fs, root = open_fs(path)
    files = [i.path for i in fs.get_file_info(pafs.FileSelector(f"{root}/chunk={chunk}", allow_not_found=True)) if i.path.endswith(".parquet")]
    parts = [unpack(p)[:2] for f in sorted(files) for p in pq.ParquetFile(f, filesystem=fs).read(columns=["packed"]).column(0).to_pylist()]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    values, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    if len(values) and (values[1:] == values[:-1]).any():  # a chunk that was sent in several runs
        first = np.append(True, values[1:] != values[:-1])
        values, counts = values[first], counts[first]
    return values, counts


class Told:
    """told() of the chunk at hand."""

    def __init__(self, path: str, bits: int):
        self.path, self.shift, self.chunk = path, np.uint64(64 - bits), None
        self.values = self.counts = np.zeros(0, np.uint64)

    def turn_to(self, chunk: int) -> bool:
        """Whether anything of the chunk was kept."""
        if chunk != self.chunk:
            self.values, self.counts = told(self.path, chunk)
            self.chunk = chunk
        return bool(len(self.values))

    def count(self, hashes: np.ndarray) -> np.ndarray:
        """The count of each hash, 0 of what wasn't kept."""
        if not len(self.values):
            return np.zeros(len(hashes), np.uint64)
        own = hashes >> self.shift
        at = np.minimum(np.searchsorted(self.values, own), len(self.values) - 1)
        return np.where(self.values[at] == own, self.counts[at], np.uint64(0))


__all__ = ["Told", "bits_for", "chunked", "delete", "pack", "runs", "tell", "told", "unpack"]
