"""WARC: a deterministic sharded writer, and a reader.

Records are range-sorted by page id, written as gzip members into files that roll by compressed size, with headers and
digests made anew. Ranges hold about SHARD_BYTES of payload each: the sizes of all ids are added up in the order of ids, and
a range ends where the sum passes a multiple of SHARD_BYTES. So they depend on the rows alone, whatever the ids are. A
record whose payload an earlier page already has becomes a revisit. Every task writes files under temporary names; the
driver renames those of the tasks that Spark commits and then writes a manifest, so files of lost or repeated attempts
never count. A reader takes the names from the manifest alone. Equal rows give equal bytes: dates come from a parameter,
record ids from the page id, order from the sort.

Cases: null html: empty payload; null url: the target is "about:blank"; null page ids: written without one and read back
as null, dealt to shards of their own by their payload; repeated page ids: each row is a record, all of an id in one shard;
ids at the ends of the range of long: like others; empty table: a manifest without files; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from mullion.llm.common import fresh_path, open_fs, written

DATE = "2020-01-01T00:00:00Z"
#: Compressed bytes after which a file ends; payload of a shard, which one task writes; what a record counts for beside it.
ROLL_BYTES, SHARD_BYTES, RECORD_BYTES = 16 << 20, 48 << 20, 1000
GZIP_LEVEL = 4
READ_SCHEMA = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str | None, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {kind}')}>"


def target(url: str | None) -> str:
    return (url or "about:blank").translate({10: "%0A", 13: "%0D"})


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, first_url: str | None = None) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit keeps digest and full length, and drops the payload."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id, url, kind)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target(url)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to, first_url, 'response')}", f"WARC-Refers-To-Target-URI: {target(first_url)}", f"WARC-Refers-To-Date: {date}"]
        head += [f"X-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    whole = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    packed = io.BytesIO()
    with gzip.GzipFile(fileobj=packed, mode="wb", compresslevel=GZIP_LEVEL, mtime=0) as f:
        f.write(whole)
    return packed.getvalue()


def read_records(data: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each gzip member of a stream of chunks; holds one record at a time."""
    unpack, plain = zlib.decompressobj(31), []
    for chunk in data:
        while chunk:
            plain.append(unpack.decompress(chunk))
            chunk = unpack.unused_data
            if unpack.eof:
                whole = b"".join(plain)
                head, _, rest = whole.partition(b"\r\n\r\n")
                lines = head.decode("utf-8", "surrogatepass").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError("no WARC record")
                headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
                block = rest[: int(headers["Content-Length"])]
                if digest(block) != headers["WARC-Block-Digest"].removeprefix("sha1:"):
                    raise ValueError(f"block digest of {headers['WARC-Record-ID']} differs")
                yield headers, block
                unpack, plain = zlib.decompressobj(31), []
    if b"".join(plain):
        raise ValueError("the archive ends within a record")


@dataclass
class Rolled(WriterCommitMessage):
    files: list[tuple[int, int, str, int, int]]  # shard, number in it, temporary name, records, bytes


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, roll: int, date: str):
        self.path, self.roll, self.date = path, roll, date

    def write(self, batches: Iterator[pa.RecordBatch]) -> Rolled:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = open_fs(self.path)
        files: list[tuple[int, int, str, int, int]] = []
        out, name, count, size, at, number = None, "", 0, 0, None, 0
        told: tuple[int | None, dict[str, tuple[int, str | None]]] = (None, {})  # page, first page of each digest
        for b in batches:
            for shard, page_id, url, html, sha, refers_to in zip(*(b.column(c).to_pylist() for c in ("shard", "page_id", "url", "html", "digest", "refers_to")), strict=True):
                if html is None:  # stands ahead of the page that it tells of
                    told = (page_id, (told[1] if told[0] == page_id else {}) | {sha: (refers_to, url)})
                    continue
                refers_to, first_url = told[1].get(hashlib.sha256(html).hexdigest(), (None, None)) if page_id is not None and told[0] == page_id else (None, None)
                if shard != at:
                    if out is not None:
                        out.close()
                        files.append((at, number, name, count, size))
                        out = None
                    at, number = shard, 0
                if out is None:
                    name, count, size = f"_temporary-{task.partitionId():08d}-{task.taskAttemptId()}-{len(files):05d}", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                packed = record_bytes(page_id, url, html, refers_to, self.date, first_url)
                out.write(packed)
                count, size = count + 1, size + len(packed)
                if size >= self.roll:
                    out.close()
                    files.append((at, number, name, count, size))
                    out, number = None, number + 1
        if out is not None:
            out.close()
            files.append((at, number, name, count, size))
        return Rolled(files)

    def commit(self, messages: list[Rolled | None]) -> None:
        fs, root = open_fs(self.path)
        listed = []
        for shard, number, name, count, size in sorted(x for m in messages if m for x in m.files):
            final = f"part-{shard:08d}-{number:05d}.warc.gz"
            fs.move(f"{root}/{name}", f"{root}/{final}")
            listed.append({"file": final, "records": count, "bytes": size})
        with fs.open_output_stream(f"{root}/_temporary-manifest") as f:
            f.write("".join(json.dumps(x) + "\n" for x in listed).encode())
        fs.move(f"{root}/_temporary-manifest", f"{root}/manifest.jsonl")
        self._sweep(fs, root)

    def abort(self, messages: list[Rolled | None]) -> None:
        self._sweep(*open_fs(self.path))

    @staticmethod
    def _sweep(fs: pafs.FileSystem, root: str) -> None:
        for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if os.path.basename(info.path).startswith("_temporary-"):
                fs.delete_file(info.path)


class WarcSink(DataSource):
    """df.write.format("warc_shards").mode("append").save(path); options: roll (bytes), date."""

    @classmethod
    def name(cls) -> str:
        return "warc_shards"

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        path = self.options["path"]
        fs, root = open_fs(path)
        fs.create_dir(root, recursive=True)
        return WarcWriter(path, int(self.options.get("roll", ROLL_BYTES)), self.options.get("date", DATE))


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """The rows as (page_id, url, html in bytes, digest, refers_to), and a row without html ahead of each page that is a revisit.

    Of rows with equal payloads the one with the smallest id is the response (all of them, where ids repeat). Payloads
    meet by SHA-256, after partial aggregation; only ids of repeated digests move, and reach their page by the range sort
    that the archives need anyway, so the payloads move once.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.encode(html_col, "UTF-8"), F.lit(b"")).alias("html"))
    keyed = rows.where(F.length("html") >= min_bytes).select("page_id", "url", F.sha2("html", 256).alias("digest"))
    named = F.struct(F.col("page_id").alias("id"), F.col("url").alias("url"))
    first = keyed.where("page_id is not null").groupBy("digest").agg(F.min(named).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = keyed.select("page_id", "digest").join(first, "digest").where("page_id > first.id").distinct()
    own = rows.select("page_id", "url", "html", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("refers_to"))
    told = later.select("page_id", F.col("first.url").alias("url"), F.lit(None).cast("binary").alias("html"), "digest", F.col("first.id").alias("refers_to"))
    return own.unionByName(told)


def shard_starts(rows: DataFrame, shard_bytes: int = SHARD_BYTES) -> np.ndarray:
    """The first page id of each shard, in order.

    Ids are sorted with their bytes alone; the driver gets a sum for each sorted partition and an id for each shard.
    """
    spark = rows.sparkSession
    sized = rows.where("page_id is not null").groupBy("page_id").agg(F.sum(F.length("html") + RECORD_BYTES).alias("bytes"))
    # written, as the sample that parts the ranges may differ between two runs, and the sums need the same parts
    sized = written(sized.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "page_id").withColumn("part", F.spark_partition_id()), "sizes")
    before, total, last = {}, 0, -shard_bytes  # of each part: where it begins, and where the id ahead of it begins
    for r in sized.groupBy("part").agg(F.sum("bytes").alias("bytes"), F.max_by("bytes", "page_id").alias("last")).orderBy("part").collect():
        before[r["part"]] = total, last
        total += r["bytes"]
        last = total - r["last"]
    schema = pa.schema([("page_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, last = None, 0, 0
        for b in batches:
            found = []
            for p, page_id, size in zip(*(b.column(c).to_pylist() for c in ("part", "page_id", "bytes")), strict=True):
                if p != part:
                    part, (at, last) = p, before[p]
                if at // shard_bytes > last // shard_bytes:
                    found.append(page_id)
                at, last = at + size, at
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], schema=schema)

    starts = sized.repartition("part").sortWithinPartitions("part", "page_id").mapInArrow(run, "page_id bigint").collect()
    return np.unique(np.array([r["page_id"] for r in starts], np.int64))


def shards(rows: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[Column, int]:
    """The shard of a row, and how many there are: by ranges of page ids; rows without id by their payload."""
    held = shard_starts(rows, shard_bytes)
    alone = rows.where("page_id is null").agg(F.sum(F.length("html") + RECORD_BYTES).alias("n")).first()["n"] or 0
    n, more = len(held), -(-alone // shard_bytes)
    starts = rows.sparkSession.sparkContext.broadcast(held)  # 8 bytes for each shard

    @F.pandas_udf("int")
    def place(page_id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(starts.value, page_id.to_numpy(), side="right") - 1)

    ranged = place(F.coalesce("page_id", F.lit(0).cast("long")))
    return F.when(F.col("page_id").isNotNull(), ranged).otherwise(F.lit(n) + F.pmod(F.xxhash64("html", "url"), F.lit(max(more, 1))).cast("int")), max(n + more, 1)


def write_warc(pages: DataFrame, path: str, roll: int = ROLL_BYTES, date: str = DATE, min_bytes: int = 0, shard_bytes: int = SHARD_BYTES, **cols: str) -> str:
    """Writes the archives of some pages to a new folder that all executors see, and gives back the folder."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcSink)
    rows = with_revisits(pages, min_bytes=min_bytes, **cols)
    shard, n = shards(rows.where("html is not null"), shard_bytes)
    rows = rows.withColumn("shard", shard).repartitionById(n, F.col("shard"))  # a task for each
    rows = rows.sortWithinPartitions("shard", "page_id", F.col("html").isNotNull(), "url", F.xxhash64("html"))
    rows.write.format("warc_shards").mode("append").option("roll", roll).option("date", date).save(path)
    return path


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives that the manifest names, one task or more per file."""
    fs, root = open_fs(path)
    with fs.open_input_stream(f"{root}/manifest.jsonl") as f:
        listed = [json.loads(x) for x in f.read().decode().splitlines()]
    names = spark.createDataFrame([(x["file"],) for x in listed], "file string")
    if listed:
        names = names.repartition(len(listed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(path)
        for b in batches:
            for name in b.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    yield from _as_batches(read_records(iter(lambda: f.read(1 << 20), b"")))

    return names.mapInArrow(run, READ_SCHEMA)


def _as_batches(records: Iterator[tuple[dict[str, str], bytes]], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
    rows, held = [], 0
    for headers, block in records:
        payload = block.partition(b"\r\n\r\n")[2]
        revisit = headers["WARC-Type"] == "revisit"
        told = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        if not revisit and (digest(payload) != told or len(payload) != int(headers["X-Payload-Length"])):
            raise ValueError(f"payload of {headers['WARC-Record-ID']} differs from its digest")
        page = headers["X-Page-ID"]
        rows.append((int(page) if page else None, headers["WARC-Target-URI"], headers["WARC-Type"], int(headers["X-Refers-To-Page"]) if revisit else None, int(headers["X-Payload-Length"]), told, None if revisit else payload))
        held += len(payload)
        if held >= limit or len(rows) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), fresh_path(spark, "warc"))
    read = read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return written(read, "warc-read")


OP2_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, CAST(CAST(unhex(sha1(html)) AS BIT) AS VARCHAR) AS bits,
             min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST(list_aggregate(list_transform(range(0, 5), lambda k: CAST(substr(bits, CAST(i * 5 + k + 1 AS BIGINT), 1) AS INTEGER) * CAST(pow(2, 4 - k) AS INTEGER)), 'sum') AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM h
"""
