"""Substring dedup: fixed-block anchors.

A window is `WINDOW` consecutive words of one document; a word goes when it is covered by a window whose word sequence
also starts anywhere else. A window of 2b-1 words holds one whole block of a document's non-overlapping blocks of b
words, so: (1) index the blocks of all documents; (2) probe the index with every rolling b-word window of all documents;
(3) extend the hits to both sides: every window that holds a hit is compared, as a whole, with all other such windows, and
windows that lie side by side make up the maximal exact repeats; (4) confirm: the windows found are compared once more by a
second hash of all their words, so two windows count as equal by 126 bits.

Index and probes meet by ranges of the hash space (mullion.llm.exchange): each chunk of texts sends its distinct rolling
hashes, packed and with a mark on its blocks, and gets back those that are a block of some document and occur twice or
more. The windows around these hits meet in the same way, by a hash of all their words (63 bits), and those that have a partner once more by another. So texts move nowhere,
the exchanges grow with the corpus and with nothing else, and a passage in very many documents is one entry a chunk.

Cases: null or wordless text: no words, nothing removed; fewer than WINDOW words: nothing removed; a window overlapping
another of the same text counts; repeated rows are copies of each other; null or repeated doc_ids: results keep a row for
each input row; an empty table gives an empty table; columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mullion.llm.common import delete, window_hashes, word_hashes
from mullion.llm.exchange import CHUNK_BYTES, HELD, Told, bits_for, chunked, runs, tell

WINDOW = 35
BLOCK = (WINDOW + 1) // 2
#: Bits of each of the two hashes of a whole window, and what makes the second one another.
WINDOW_BITS, SALT = 63, 0xA24BAED4963EE407


def _places(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of some documents its place in its document, and how many words follow from it on."""
    n = np.diff(offsets)
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], n)
    return at, np.repeat(n, n) - at


def _rolling(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the block-long window at each word, whether it is in a document that can hold a repeat, place, words left."""
    at, left = _places(offsets)
    whole = np.zeros(len(flat), np.uint64)
    made = window_hashes(flat, BLOCK)
    whole[: len(made)] = made
    return whole, (left >= BLOCK) & (at + left >= WINDOW), at, left


def _words(batches: Iterator[pa.RecordBatch], told: Told | None = None) -> Iterator[tuple]:
    """(chunk, word hashes, offsets) of the texts, but for chunks of which nothing was told."""
    for chunk, part in runs(batches):
        if told is None or told.turn_to(chunk):
            yield chunk, *word_hashes(part.column("text").to_pylist())


def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(chunk, rolling hashes, which of them are the document's own blocks)."""
    for chunk, flat, offsets in _words(batches):
        whole, there, at, _ = _rolling(flat, offsets)
        yield chunk, whole[there], at[there] % BLOCK == 0


def extended(batches: Iterator[pa.RecordBatch], hits: Told) -> Iterator[tuple[int, np.ndarray, None]]:
    """(chunk, hashes of the windows that hold a hit)."""
    for chunk, flat, offsets in _words(batches, hits):
        whole, there, _, left = _rolling(flat, offsets)
        hit = np.zeros(len(flat) + 1, np.int64)
        there = np.flatnonzero(there)
        hit[there + 1] = hits.count(whole[there]) > 0
        np.cumsum(hit, out=hit)
        start = np.flatnonzero(left >= WINDOW)
        start = start[hit[start + WINDOW - BLOCK + 1] > hit[start]]
        yield chunk, window_hashes(flat, WINDOW)[start], None


def met(batches: Iterator[pa.RecordBatch], found: Told) -> Iterator[tuple[int, np.ndarray, None]]:
    """(chunk, second hashes of the windows whose first hash occurs twice)."""
    for chunk, flat, offsets in _words(batches, found):
        start = np.flatnonzero(_places(offsets)[1] >= WINDOW)
        start = start[found.count(window_hashes(flat, WINDOW)[start]) > 0]
        yield chunk, window_hashes(flat, WINDOW, SALT)[start], None


def covered(flat: np.ndarray, offsets: np.ndarray, found: Told, repeated: Told) -> np.ndarray:
    """Whether a window that is repeated by both hashes covers each word."""
    gone = np.zeros(len(flat) + 1, np.int64)
    start = np.flatnonzero(_places(offsets)[1] >= WINDOW)
    start = start[found.count(window_hashes(flat, WINDOW)[start]) > 0]
    start = start[repeated.count(window_hashes(flat, WINDOW, SALT)[start]) > 0]
    gone[start] += 1
    gone[start + WINDOW] -= 1
    return np.cumsum(gone[:-1]) > 0


def repeats(src: DataFrame, words: int, held: int = HELD) -> tuple[str, str]:
    """The folders of the first and second hashes of repeated windows, by chunk; src is made by chunked(), `words` is about how many it has."""
    bits = bits_for(words)
    texts = src.select("text", "chunk")
    hits = tell(texts, probes, lambda n, block: block & (n > 1), words, bits, "hits", held)
    try:
        found = tell(texts, lambda batches: extended(batches, Told(hits, bits)), lambda n, _: n > 1, words, WINDOW_BITS, "found", held)
        return found, tell(texts, lambda batches: met(batches, Told(found, WINDOW_BITS)), lambda n, _: n > 1, words, WINDOW_BITS, "repeats", held)
    finally:
        delete(src.sparkSession, hits)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, held: int = HELD) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and kept, the words that stay joined by a space."""
    src = chunked(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text_col), "UTF-8").alias("text")), "texts", chunk_bytes)
    size = src.agg(F.sum("size").alias("n")).first()["n"] or 0
    first, second = repeats(src, size // 6 + 1, held)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, repeated = Told(first, WINDOW_BITS), Told(second, WINDOW_BITS)
        for chunk, part in runs(batches):
            texts = [t.split() if t else [] for t in part.column("text").to_pylist()]
            n_words = [len(t) for t in texts]
            if repeated.turn_to(chunk) and found.turn_to(chunk):
                flat, offsets = word_hashes(part.column("text").to_pylist())
                gone = covered(flat, offsets, found, repeated)
                for i in np.flatnonzero(np.add.reduceat(np.append(gone, False), offsets[:-1]) * (np.diff(offsets) > 0)).tolist():
                    texts[i] = [w for w, g in zip(texts[i], gone[offsets[i] : offsets[i + 1]].tolist(), strict=True) if not g]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array([n - len(t) for n, t in zip(n_words, texts, strict=True)], pa.int64()), pa.array([b" ".join(t) for t in texts], pa.binary())],
                schema=schema,
            )

    return src.select("doc_id", "text", "chunk").mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept binary")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS g FROM d, unnest(range(1, len(w) - 33)) AS r(i) WHERE len(w) >= 35),
rep AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN rep USING (g), unnest(range(0, 35)) AS s(k)),
words AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS r(p)),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS t, count(*) AS n
         FROM words ANTI JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
