"""Vector code compression: codebooks for the parts of vectors by Hamerly's form of Lloyd's algorithm, in whole numbers.

A component x becomes floor(4096*x); a vector is cut into `PARTS` equal parts, and each part position has a codebook of `ENTRIES`
entries, at first those of the vectors with the smallest ids. A round assigns every part to the nearest entry (squared
distance, ties to the lower index) and moves each entry to the floored means of its parts; unused entries stay.

With each part its entry is kept, an upper bound of the distance to it and one lower bound of the distance to all others.
After a move, the upper bound grows by its entry's step and the lower one falls by the longest step of another entry. Where upper < lower
strictly, no other entry is as near, so not even a tie can change the code; otherwise the upper bound is made exact, and
where that isn't strictly below either, all entries are scanned in 64-bit integers. Bounds are rounded outwards, so an
error of floating point can cost a scan and never a code.

A round is one job: each task turns its rows of the state into new ones and ends with one row of its parts' sums by entry.
The state is a table in the shared folder (a lost executor repeats its tasks), the one before it is deleted when the next has been written. Only the
sums, of a size set by entries and dimension, are added up by Spark and reach the driver: nothing that grows with the data.

Cases: null vectors and those with a null or non-finite component are dropped; fewer vectors than entries: as many entries as
vectors; null ids come last, equal ids are ordered by their vectors, and all their rows are returned; null labels are one
label; an empty table gives an empty table; other columns aren't read. Vectors of several lengths, a length that doesn't divide
by the number of parts, or components whose distances could leave 64 bits, are an error that says so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from mullion.llm.common import drop_written, written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Labels whose sums are sent to all executors (some 30 bytes each); more are joined by shuffle.
BROADCAST_LABELS = 100_000


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, whole) of the vectors without null or non-finite components."""
    picked = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    return picked.where(F.col("vector").isNotNull() & F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))).select(
        "vec_id", "label", F.transform("vector", lambda x: F.floor(SCALE * x).cast("int")).alias("whole")
    )


def rows_of(column: pa.Array, kind: type) -> np.ndarray:
    """A column of packed numbers as (rows, width)."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def packed(rows: np.ndarray) -> pa.Array:
    """Rows of numbers as a column of their bytes: a state of lists costs Spark several times as much to read and write."""
    return pa.array([r.tobytes() for r in rows], pa.binary())


def parted(column: pa.Array, parts: int) -> np.ndarray:
    """A column of vectors, lists or packed, as (rows, parts, width) of 64-bit integers."""
    flat = rows_of(column, np.int32) if pa.types.is_binary(column.type) else column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(len(column), parts, -1)


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of the parts x (rows, width) to all entries of a codebook (entries, width)."""
    return (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)


def outward(x: np.ndarray, up: bool) -> np.ndarray:
    """x moved past any rounding of a few operations."""
    return x + np.abs(x) * 1e-12 + 1e-9 if up else x - np.abs(x) * 1e-12 - 1e-9


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some parts the nearest entry, lower index first, a bound above its distance and one below that of all others."""
    far = squared(x, book)
    code = far.argmin(1)
    near = far[np.arange(len(x)), code]
    far[np.arange(len(x)), code] = np.iinfo(np.int64).max
    return code, outward(np.sqrt(near), True), outward(np.sqrt(far.min(1)), False) if book.shape[0] > 1 else np.full(len(x), np.inf)


def assign(x: np.ndarray, book: np.ndarray, steps: np.ndarray | None, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Codes and bounds of the parts x, in place, after the entries moved by `steps` (none: no bounds yet); how many were scanned."""
    open_ = np.arange(len(x))
    if steps is not None:
        longest = np.array([np.delete(steps, k).max(initial=0.0) for k in range(len(steps))])
        upper[:] = outward(upper + steps[code], True)
        lower[:] = outward(lower - longest[code], False)
        open_ = np.flatnonzero(~(upper < lower))
        away = x[open_] - book[code[open_]]
        upper[open_] = outward(np.sqrt((away * away).sum(1)), True)
        open_ = open_[~(upper[open_] < lower[open_])]
    if len(open_):
        code[open_], upper[open_], lower[open_] = scan(x[open_], book)
    return len(open_)


def round_of(state: DataFrame, books: np.ndarray, steps: np.ndarray | None, name: str) -> DataFrame:
    """The state after assigning all parts to `books` (parts, entries, width), with a row of sums and counts for each task."""
    parts, entries, width = books.shape
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, scanned, schema = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64), 0, None
        for b in batches:
            schema = b.schema
            if not b.num_rows:
                continue
            x = parted(b.column("whole"), parts)
            if steps is None:
                codes, upper, lower = np.zeros((len(x), parts), np.uint8), np.zeros((len(x), parts)), np.zeros((len(x), parts))
            else:
                codes, upper, lower = (rows_of(b.column(c), kind).copy() for c, kind in (("codes", np.uint8), ("upper", np.float64), ("lower", np.float64)))
            for p in range(parts):
                code, u, low = codes[:, p].astype(np.int64), upper[:, p].copy(), lower[:, p].copy()
                scanned += assign(x[:, p], books[p], None if steps is None else steps[p], code, u, low)
                codes[:, p], upper[:, p], lower[:, p] = code, u, low
                np.add.at(sums[p], code, x[:, p])
                counts[p] += np.bincount(code, minlength=entries)
            whole = b.column("whole") if steps is not None else packed(x.reshape(len(x), -1).astype(np.int32))
            none = [pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), whole, packed(codes), packed(upper), packed(lower), *none], schema.names)
        if schema is not None and counts.any():
            own = {"scans": pa.array([scanned], pa.int64()), "sums": pa.array([np.append(sums.ravel(), counts.ravel()).tolist()], pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays([own.get(f.name, pa.nulls(1, f.type if f.name in ("vec_id", "label") else pa.binary())) for f in schema], schema.names)

    made = StructType([StructField("whole", BinaryType()) if f.name == "whole" else f for f in state.schema.fields])
    return written(state.where("sums IS NULL").mapInArrow(run, made), name)


def added(state: DataFrame, books: np.ndarray) -> tuple[np.ndarray, int]:
    """The codebooks after a round, and how many parts were scanned: sums of all tasks, of the codebooks' size."""
    told = state.where("sums IS NOT NULL")
    rows = told.select(F.posexplode("sums").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(books.size + books.shape[0] * books.shape[1], np.int64)
    for r in rows:
        flat[r.k] = r.v
    sums, counts = flat[: books.size].reshape(books.shape), flat[books.size :].reshape(books.shape[:2])
    means = sums // np.maximum(counts, 1)[:, :, None]
    return np.where(counts[:, :, None] > 0, means, books), told.agg(F.sum("scans")).first()[0] or 0


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(vec_id, label, code, error) of each kept vector, the codebooks (parts, entries, width), and how many parts each round scanned."""
    spark = vectors.sparkSession
    label = vectors.schema[label_col].dataType
    kept = written(whole_numbers(vectors, id_col, vector_col, label_col), "vectors")
    seen = kept.agg(F.min(F.size("whole")).alias("least"), F.max(F.size("whole")).alias("most"), F.max(F.greatest(F.abs(F.array_max("whole").cast("long")), F.abs(F.array_min("whole").cast("long")))).alias("far")).first()
    schema = StructType([StructField("vec_id", LongType()), StructField("label", label), StructField("code", BinaryType()), StructField("error", LongType())])
    if seen.least is None:
        return spark.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64), []
    if not seen.most or seen.least != seen.most or seen.least % parts:
        raise ValueError(f"vectors have {seen.least} to {seen.most} components: one length is needed, divisible by {parts}")
    if 8 * seen.most * (seen.far or 0) ** 2 >= 1 << 63:
        raise ValueError(f"a component of {seen.far} / {SCALE} is too large for distances in 64 bits")
    # The entries' first values: a top-k of `entries` rows.
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(entries).collect()
    books = np.stack([np.array([r.whole for r in first], np.int64).reshape(len(first), parts, -1)[:, p] for p in range(parts)])
    state = kept.select("vec_id", "label", "whole", *(F.lit(None).cast("binary").alias(c) for c in ("codes", "upper", "lower")),
                        F.lit(None).cast("bigint").alias("scans"), F.lit(None).cast("array<bigint>").alias("sums"))
    steps, scans, before = None, [], kept
    for k in range(rounds + 1):
        state = round_of(state, books, steps, f"codes-{k}")
        drop_written(before)
        before = state
        moved, scanned = added(state, books)
        scans.append(scanned)
        if k < rounds:
            steps = outward(np.sqrt(((moved - books) ** 2).sum(2)), True) * (moved != books).any(2)
            books = moved
    last = books

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = parted(b.column("whole"), parts)
                codes = rows_of(b.column("codes"), np.uint8)
                away = x - last[np.arange(parts), codes]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("codes"), pa.array((away * away).sum((1, 2)))], ["vec_id", "label", "code", "error"])

    out = state.where("sums IS NULL").select("vec_id", "label", "whole", "codes")
    return out.mapInArrow(measure, schema), books, scans


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with label_error, the error summed over rows of equal labels; a hot label is added up before it is shuffled."""
    sums = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    sums = sums.withColumnRenamed("label", "__label")
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums
    return coded.join(sums, coded["label"].eqNullSafe(sums["__label"])).drop("__label")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books, _ = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return with_label_error(coded).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql(rounds: int = ROUNDS) -> str:
    books, steps = "b0", []
    for k in range(rounds + 1):
        steps.append(
            f"a{k} AS MATERIALIZED (SELECT vec_id, label, p, x, best.far AS far, best.e AS e FROM (SELECT v.vec_id, any_value(label) AS label, v.p, any_value(v.x) AS x, "
            f"min(struct_pack(far := list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e := b.e)) AS best FROM part v JOIN {books} b USING (p) GROUP BY v.vec_id, v.p))"
        )
        if k < rounds:
            steps.append(f"m{k} AS (SELECT p, e, list(m ORDER BY i) AS x FROM (SELECT p, e, i, CAST(floor(sum(x[i])::DOUBLE / count(*)) AS BIGINT) AS m FROM a{k}, unnest(range(1, len(x) + 1)) AS r(i) GROUP BY p, e, i) GROUP BY p, e)")
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT o.p, o.e, coalesce(m.x, o.x) AS x FROM {books} o LEFT JOIN m{k} m USING (p, e))")
            books = f"b{k + 1}"
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // 8 + 1 : (p + 1) * len(v) // 8] AS x FROM kept, unnest(range(0, 8)) AS r(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM part WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 16)),
{(","+chr(10)).join(steps)},
coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM {books}) AS codebooks_sha256
FROM coded
"""


OP12_SQL = _sql()
