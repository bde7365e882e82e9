"""Line dedup: a sharded minimal perfect hash over line hashes, with arrays of fingerprints and counts that documents probe.

A line's key is the line without white space at both ends, A-Z lower-cased; it is known by its 128-bit hash. (1) Tasks count in
how many of their texts a key occurs, Spark adds these counts up: a key in a third of all documents is one row a task. (2) The
keys found in `least` documents or more are dealt out to shards by their leading bits, one task a shard. A shard is a
minimal perfect hash, laid out as levels of bits: a key owns a bit of the first level on which no other key shares its
place, and its slot is the number of bits that are set before it. Under the slot lie one half of the key's hash, its
fingerprint, and its count in as few bytes as the shard's counts need. (3) Documents hash their lines, sort them by shard
and probe the arrays; no line is shuffled again or joined. A line whose key isn't in the index
reaches a foreign slot at most, where the fingerprint refuses it.

Shards are rows of a table in the shared folder, so a lost executor costs what it was at. A shard has `SHARD_KEYS` keys at most on
average, some 11 bytes each, and a worker holds shards up to `HELD_BYTES` and otherwise loads them again for the next
`BLOCK_BYTES` of text: memory is bounded whatever the corpus. The index is read once for each block of text, which is why
keys below the smallest threshold asked for, most of all distinct lines, aren't part of it.

Cases: a null or empty text is one empty line; empty keys have no entry and stay; "\\r" before "\\n" is part of the line and stays with it;
a key twice in a text counts once; null and repeated ids, equal rows: each row counts and comes back; an empty table: an
empty index and table; other columns aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mullion.llm.common import chunks, drop_written, fresh_path, open_fs, written

LEAST_DOCUMENTS = 10
#: Keys of a shard and the least number of shards; distinct keys that a counting task holds; bytes of shards that a worker holds; bytes of text probed at once.
SHARD_KEYS, SHARDS, COUNTED, HELD_BYTES, BLOCK_BYTES = 1 << 20, 16, 200_000, 128 << 20, 16 << 20
#: Bits of a level for each key that is placed on it.
SPREAD = 2.0
SHARD = "shard int, n bigint, levels array<bigint>, bits binary, fingerprints binary, width int, counts binary"
SHARD_ARROW = pa.schema([("shard", pa.int32()), ("n", pa.int64()), ("levels", pa.list_(pa.int64())), ("bits", pa.binary()), ("fingerprints", pa.binary()), ("width", pa.int32()), ("counts", pa.binary())])


def keys_of(text: bytes | None) -> list[bytes]:
    """The 16 bytes of each line's key; empty where the key is."""
    digest = xxhash.xxh3_128_digest
    return [digest(key) if (key := line.strip()) else b"" for line in (text or b"").lower().split(b"\n")]


# -- minimal perfect hash ---------------------------------------------------------------------------------------------


def _place(halves: np.ndarray, level: int, size: int) -> np.ndarray:
    """The places of some 128-bit keys on a level of `size` bits; keys that agree in one half part on the next level."""
    x = (halves[:, 1] + np.uint64(level) * halves[:, 0]) * np.uint64(0xD6E8FEB86659FD93) + np.uint64((level * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) % (1 << 64))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return ((x >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)


class PerfectHash:
    """Distinct 128-bit keys (rows of two halves), each to a slot of its own below their number."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        #: Bits that are set before each byte.
        self.rank = np.append(0, np.cumsum(np.bitwise_count(bits), dtype=np.int64))[:-1] if len(bits) else np.zeros(0, np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(keys):
            size = -(-max(64, int(SPREAD * len(keys))) // 8) * 8
            at = _place(keys, len(sizes), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            sizes.append(size)
            levels.append(np.packbits(alone, bitorder="little"))
            keys = keys[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, np.uint8))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, some slot or -1 of a key that isn't among those placed."""
        out = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = _place(keys[left], level, size).astype(np.int64) + base
            byte, bit = self.bits[at >> 3], (at & 7).astype(np.uint8)
            there = (byte >> bit) & np.uint8(1) == 1
            below = np.bitwise_count(byte & ((np.uint8(1) << bit) - np.uint8(1)).astype(np.uint8))
            out[left[there]] = (self.rank[at >> 3] + below)[there]
            left, base = left[~there], base + size
            if not len(left):
                break
        return out


def pack_shard(shard: int, halves: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A shard of keys (rows of two 64-bit halves) and counts as a row of the index."""
    hashed = PerfectHash.of(halves)
    slots = hashed.slots(halves)
    prints, held = np.zeros(len(halves), np.uint64), np.zeros(len(halves), np.uint64)
    prints[slots], held[slots] = halves[:, 0], counts
    width = next(w for w in (1, 2, 4, 8) if int(held.max()) < 1 << 8 * w)
    row = [[shard], [len(halves)], [hashed.sizes], [hashed.bits.tobytes()], [prints.tobytes()], [width], [held.astype(f"<u{width}").tobytes()]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, SHARD_ARROW, strict=True)], schema=SHARD_ARROW)


class Shard:
    """The arrays of a shard."""

    def __init__(self, row: dict):
        self.hashed = PerfectHash(row["levels"], np.frombuffer(row["bits"], np.uint8))
        self.prints, self.counts = np.frombuffer(row["fingerprints"], np.uint64), np.frombuffer(row["counts"], f"<u{row['width']}")
        self.size = len(row["bits"]) * 9 + self.prints.nbytes + self.counts.nbytes

    def count(self, halves: np.ndarray) -> np.ndarray:
        """In how many documents each key was found; 0 of keys that the index doesn't have."""
        slots = self.hashed.slots(halves)
        return np.where((slots >= 0) & (self.prints[slots] == halves[:, 0]), self.counts[slots], 0).astype(np.int64)


def shard_of(halves: np.ndarray, shards: int) -> np.ndarray:
    return ((halves[:, 0] >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


class Shards:
    """The index as a worker sees it: shards by number, loaded when asked for."""

    def __init__(self, files: dict[int, str], shards: int):
        self.files, self.shards = files, shards
        self.held: dict[int, Shard] = {}

    def load(self, shard: int) -> Shard | None:
        if shard not in self.held and shard in self.files:
            fs, path = open_fs(self.files[shard])
            rows = pq.ParquetFile(path, filesystem=fs).read().to_pylist()
            found = Shard(next(r for r in rows if r["shard"] == shard))
            while self.held and found.size + sum(s.size for s in self.held.values()) > HELD_BYTES:
                del self.held[next(iter(self.held))]
            self.held[shard] = found
        return self.held.get(shard)

    def count(self, halves: np.ndarray) -> np.ndarray:
        out = np.zeros(len(halves), np.int64)
        own = shard_of(halves, self.shards).astype(np.int64)
        order = np.argsort(own, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
            if len(part) and (shard := self.load(int(own[part[0]]))):
                out[part] = shard.count(halves[part])
        return out


# -- building and probing ---------------------------------------------------------------------------------------------


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n): the halves of each key and in how many of the texts it was found, added up as far as a task holds."""
    found: Counter[bytes] = Counter()

    def rows() -> pa.RecordBatch:
        halves = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
        made = pa.RecordBatch.from_arrays([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(np.fromiter(found.values(), np.int64, len(found)))], ["a", "b", "n"])
        found.clear()
        return made

    for b in batches:
        for _, texts in chunks(b.column(0)):
            for text in texts:
                found.update(set(keys_of(text)) - {b""})
                if len(found) >= COUNTED:
                    yield rows()
    if found:
        yield rows()


def line_counts(docs: DataFrame, text_col: str = "text", least: int = 1) -> DataFrame:
    """(a, b, n): the two halves of each key's hash and the number of documents that hold it, at least `least`."""
    texts = docs.select(F.encode(F.col(text_col), "UTF-8").alias("text"))
    return texts.mapInArrow(counted, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def build_index(docs: DataFrame, text_col: str = "text", least: int = LEAST_DOCUMENTS, shard_keys: int = SHARD_KEYS) -> tuple[str, dict[int, str], int]:
    """The index of keys found in `least` documents or more: its folder, the file of each shard, and the number of shards."""
    spark = docs.sparkSession
    keys = written(line_counts(docs, text_col, least), "line-counts")
    shards = max(SHARDS, -(-keys.count() // shard_keys))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            halves = b.column(0).to_numpy().view(np.uint64).reshape(-1, 1)
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(halves, shards).astype(np.int32)), *b.columns], ["shard", "a", "b", "n"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if parts:
            shard, a, b, n = (np.concatenate(c) for c in zip(*parts, strict=True))
            yield pack_shard(int(shard[0]), np.stack([a, b], 1).view(np.uint64), n.astype(np.uint64))

    path = fresh_path(spark, "line-index")
    dealt = keys.mapInArrow(number, "shard int, a bigint, b bigint, n bigint").repartitionById(shards, F.col("shard"))
    dealt.mapInArrow(pack, SHARD).write.option("compression", "none").parquet(path)
    drop_written(keys)
    # One row a shard, that is one for every million keys.
    files = {r.shard: r.file for r in spark.read.schema(SHARD).parquet(path).select("shard", F.col("_metadata.file_path").alias("file")).collect()}
    return path, files, shards


def drop_lines(docs: DataFrame, index: tuple[str, dict[int, str], int], least: int = LEAST_DOCUMENTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped and kept, the lines whose key is in fewer than `least` documents of the index, joined by a line feed."""
    _, files, shards = index
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Shards(files, shards)
        for batch in batches:
            for first, texts in chunks(batch.column(1), BLOCK_BYTES):
                keys = [keys_of(t) for t in texts]
                flat = [k for ks in keys for k in ks]
                named = np.array([bool(k) for k in flat])
                gone = np.zeros(len(flat), bool)
                gone[named] = held.count(np.frombuffer(b"".join(flat), np.uint64).reshape(-1, 2)) >= least
                ends = np.cumsum([len(k) for k in keys])
                sums = np.append(0, np.cumsum(gone))
                n_dropped = sums[ends] - sums[ends - [len(k) for k in keys]]
                kept = [t or b"" for t in texts]
                for i in np.flatnonzero(n_dropped).tolist():
                    kept[i] = b"\n".join(line for line, g in zip(kept[i].split(b"\n"), gone[ends[i] - len(keys[i]) : ends[i]].tolist(), strict=True) if not g)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array([len(k) for k in keys], pa.int64()), pa.array(n_dropped.astype(np.int64)), pa.array(kept, pa.binary())], schema=schema
                )

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text_col), "UTF-8").alias("text"))
    return picked.mapInArrow(run, "doc_id bigint, n_lines bigint, n_dropped bigint, kept binary")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return drop_lines(docs, build_index(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, i, l[i] AS line, translate(regexp_replace(l[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
          FROM d, unnest(range(1, len(l) + 1)) AS r(i)),
common AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
kept AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS t FROM lines ANTI JOIN common USING (key) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - coalesce(n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
