"""Periodic run detection: Lyndon words by a stack, scanned from right to left under both orders.

A run is a stretch of consecutive words with smallest period q, of `LEAST_LENGTH` words and `TIMES` periods at least, that no
neighbouring word extends. Every run with two periods or more holds a word w[i:j] of period length that is, under one of the
two orders of words, the longest Lyndon word from i on; j is then the next smaller suffix. So for each order a stack of
suffixes, scanned from right to left, gives j for every i; the words that agree from i and j on to the right are known from the last
comparison, those to the left are counted, and the run is what both make up.

Two suffixes are compared by galloping and binary search over rolling hashes modulo 2^61-1; what the hashes say is then
compared word by word, so no collision decides. Equal stretches are kept by their shift: a later comparison at the same shift
that reaches such a stretch ends there, so a run's words are compared once for each shift and not once for each place.

Words are only looked at where they can be in a run: each word of a run lies in `GRAM` consecutive words that occur again in
the same text (a run of 6 words with period 1 has two such places, and 4q >= 2q+4 from q=2 on). Such words are found for a
megabyte of texts at a time by sorting hashes; equal hashes of different words only add places. A maximal stretch of them
holds whole runs or none.

Cases: null, empty or wordless text: no words, no runs; texts of any length: memory in proportion to a text's longest stretch;
repeated rows and ids: a row each; an empty table: an empty table; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mullion.llm.common import MIX, chunks, window_hashes, word_hashes, words_of

LEAST_LENGTH, TIMES, GRAM = 6, 4, 5
PRIME, BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E681


class Stretch:
    """Comparisons of the suffixes of some coded words."""

    def __init__(self, words: list[int]):
        self.words, self.n = words, len(words)
        self.sums = list(accumulate(words, lambda h, w: (h * BASE + w + 1) % PRIME, initial=0))
        self.powers = list(accumulate(range(self.n), lambda p, _: p * BASE % PRIME, initial=1))
        #: By shift: the leftmost stretch [lo, hi) with words[x] == words[x + shift], and whether it is maximal on the left.
        self.known: dict[int, tuple[int, int, bool]] = {}

    def alike(self, i: int, j: int, n: int) -> bool:
        """Whether the hashes of n words from i and j on agree."""
        p = self.powers[n]
        return (self.sums[i + n] - self.sums[j + n] - (self.sums[i] - self.sums[j]) * p) % PRIME == 0

    def most(self, i: int, j: int, limit: int, back: bool) -> int:
        """How many words from i and j on (back: before i and j) agree, up to limit."""
        words, alike = self.words, self.alike
        low, high = 0, 1
        while high <= limit and alike(i - high if back else i, j - high if back else j, high):
            low, high = high, 2 * high
        high = min(high, limit + 1)
        while high - low > 1:
            mid = (low + high) // 2
            if alike(i - mid if back else i, j - mid if back else j, mid):
                low = mid
            else:
                high = mid
        if back:
            if words[i - low : i] == words[j - low : j]:
                return low
            return next(k for k in range(limit) if words[i - 1 - k] != words[j - 1 - k])
        if words[i : i + low] == words[j : j + low]:
            return low
        return next(k for k in range(limit) if words[i + k] != words[j + k])

    def right(self, i: int, j: int) -> int:
        """How many words from i and j > i on agree; for one shift, i has to fall from call to call."""
        if self.words[i] != self.words[j]:
            return 0
        shift = j - i
        held = self.known.get(shift)
        limit = self.n - j
        if held:
            lo, hi, _ = held
            if lo <= i < hi:
                return hi - i
            if i < lo:
                limit = lo - i
        same = self.most(i, j, limit, False)
        if held and i + same == held[0]:
            same = held[1] - i
        self.known[shift] = (i, i + same, False)
        return same

    def run_at(self, i: int, j: int) -> tuple[int, int] | None:
        """The stretch [lo, hi) around i at shift j - i that right() has just found, if it wasn't given before."""
        lo, hi, closed = self.known[j - i]
        if closed:
            return None
        lo -= self.most(lo, lo + j - i, lo, True)
        self.known[j - i] = (lo, hi, True)
        return lo, hi

    def runs(self, least: int, times: int) -> set[tuple[int, int, int]]:
        """(start, length, period) of the runs."""
        words, n, found = self.words, self.n, set()
        for up in (True, False):
            self.known = {}
            stack: list[int] = []
            for i in range(n - 1, -1, -1):
                same = 0
                while stack:
                    j = stack[-1]
                    same = self.right(i, j)
                    if j + same == n or (words[i + same] > words[j + same]) == up:
                        break  # the suffix from j on is the smaller one
                    stack.pop()
                if stack and same > (times - 2) * (stack[-1] - i):  # the first such place of a run has more than times - 2 periods to its right
                    q = stack[-1] - i
                    stretch = self.run_at(i, stack[-1])
                    if stretch and stretch[1] - stretch[0] + q >= max(least, times * q):
                        found.add((stretch[0], stretch[1] - stretch[0] + q, q))
                stack.append(i)
        return found


def stretches(flat: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, first word, end) of the stretches of words that can be in a run, words counted within the text."""
    n = np.diff(offsets)
    own = np.repeat(np.arange(len(n)), n)
    left = np.repeat(offsets[1:], n) - np.arange(len(flat))
    starts = np.flatnonzero(left >= GRAM)
    if not len(starts):
        return []
    key = window_hashes(flat, GRAM)[starts] + own[starts].astype(np.uint64) * MIX
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(starts), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edges = np.zeros(len(flat) + 1, np.int64)
    edges[starts[again]] += 1
    np.subtract.at(edges, starts[again] + GRAM, 1)
    held = np.cumsum(edges[:-1]) > 0
    cut = np.zeros(len(flat) + 1, bool)
    cut[offsets] = True
    begins = np.flatnonzero(held & (cut[:-1] | ~np.append(False, held[:-1])))
    ends = np.flatnonzero(held & (cut[1:] | ~np.append(held[1:], False))) + 1
    return [(int(own[a]), int(a - offsets[own[a]]), int(b - offsets[own[a]])) for a, b in zip(begins.tolist(), ends.tolist(), strict=True) if b - a >= LEAST_LENGTH]


def runs_of(words: list[bytes], least: int = LEAST_LENGTH, times: int = TIMES) -> list[tuple[int, int, int]]:
    """The runs of some words, by start, then period."""
    codes: dict[bytes, int] = {}
    return sorted(Stretch([codes.setdefault(w, len(codes)) for w in words]).runs(least, times), key=lambda r: (r[0], r[2])) if words else []


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        gone[start + q] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, runs (start, length, period; by start, then period), collapsed: the words that stay, joined by a space."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", kind), ("collapsed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in chunks(b.column(1)):
                words = [t.split() if t else [] for t in texts]
                runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
                for text, start, stop in stretches(*word_hashes(texts)):
                    runs[text] += [(start + s, length, q) for s, length, q in runs_of(words[text][start:stop])]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(first, len(texts)), pa.array([len(w) for w in words], pa.int64()),
                        pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in found] for found in runs], kind),
                        pa.array([b" ".join(collapsed(w, r)) for w, r in zip(words, runs, strict=True)], pa.binary()),
                    ],
                    schema=schema,
                )

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(text_col, "UTF-8").alias("text"))
    return picked.mapInArrow(run, "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary")


def planted(docs: DataFrame) -> DataFrame:
    """The query's input: one text in ten, by the CRC-32 of its id, made periodic from some word on; others and those without an id as they are."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    hit = (h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    parts = docs.select("doc_id", "text", F.when(hit, words_of("text")).alias("words"), F.floor(h / 10).alias("g"))
    parts = parts.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("words").isNotNull(), F.col("g") % F.col("n")).cast("int"))
    parts = parts.withColumn("p", (F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8))).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    periodic = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times)), F.lit(1), F.col("n") - F.col("a"))
    head = F.slice("words", F.lit(1), F.col("a"))
    return parts.select("doc_id", F.when(F.col("words").isNull(), F.col("text")).otherwise(F.array_join(F.concat(head, periodic), " ")).alias("text"))


def op13_run_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = planted(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    # Greatest length first, then smallest start, then smallest period.
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    said = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return (
        find_runs(docs).withColumn("best", best)
        .select(
            "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
            F.floor(-1000 * F.col("best.less") / F.col("best.period")).alias("exponent_milli"),
            F.sha2(F.array_join(said, "").cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
        )
    )


def _sql(levels: int = 11) -> str:
    """For each power m of three, the next place with the same m words is a period away for periods of m/3 to m words: these are the periods to try.

    A stretch whose smallest period is shorter than the one tried lies in a run of that period.
    """
    grams = ["g0 AS MATERIALIZED (SELECT doc_id, i, md5(word) AS g FROM words)"]
    for k in range(1, levels):
        m = 3 ** (k - 1)
        grams.append(f"g{k} AS MATERIALIZED (SELECT doc_id, i, md5(g || lead(g, {m}) OVER o || lead(g, {2 * m}) OVER o) AS g FROM g{k - 1} WINDOW o AS (PARTITION BY doc_id ORDER BY i))")
    near = "\nUNION ".join(f"SELECT doc_id, q FROM (SELECT doc_id, lead(i) OVER (PARTITION BY doc_id, g ORDER BY i) - i AS q FROM g{k} WHERE g IS NOT NULL) WHERE q <= {3**k}" for k in range(levels))
    return rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
bits AS (SELECT doc_id, list_transform(range(0, len(CAST(doc_id AS VARCHAR))), lambda k: ascii(CAST(doc_id AS VARCHAR)[CAST(k AS INTEGER) + 1])) AS b FROM d),
crc AS (SELECT doc_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(b, lambda x: x::BIGINT)), lambda c, x:
    list_reduce(list_prepend(xor(c, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))) AS h FROM bits),
planted AS (SELECT d.doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS hit, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a, 3 + (h // 10) % 8 AS e FROM d JOIN crc USING (doc_id)),
words AS MATERIALIZED (SELECT doc_id, i, CASE WHEN hit AND i >= a THEN w[a + (i - a) % (1 + (n - a) // e) + 1] ELSE w[i + 1] END AS word FROM planted, unnest(range(0, n)) AS r(i)),
{(","+chr(10)).join(grams)},
near AS MATERIALIZED ({near}),
same AS (SELECT x.doc_id, near.q, x.i, x.i - row_number() OVER (PARTITION BY x.doc_id, near.q ORDER BY x.i) AS island
    FROM near JOIN words x ON x.doc_id = near.doc_id JOIN words y ON y.doc_id = x.doc_id AND y.i = x.i + near.q WHERE x.word = y.word),
stretch AS MATERIALIZED (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM same GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
run AS MATERIALIZED (SELECT * FROM stretch r WHERE NOT EXISTS (SELECT 1 FROM stretch o WHERE o.doc_id = r.doc_id AND o.q < r.q AND o.s <= r.s AND o.s + o.l >= r.s + r.l)),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS said, min(struct_pack(less := -l, s := s, q := q)) AS best FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, i FROM run, unnest(range(s + q, s + l)) AS r(i)),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.i) AS t FROM words ANTI JOIN gone ON gone.doc_id = words.doc_id AND gone.i = words.i GROUP BY words.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, -best.less AS length, best.q AS period, 1000 * -best.less // best.q AS exponent_milli,
    sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN told ON told.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


OP13_SQL = _sql()
