"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside each partition.

Encoding: a text parts into the matches of a pattern; each distinct match that the worker hasn't met goes, as rows of
(word, position, token, next token), into a recursive query. A step joins neighbouring tokens with the merge table (left
id, right id -> id of the joint token, which is its rank), takes each word's pair of least rank, leftmost of equals, and
contracts it, until no word has a pair. Decoding: rows of (row, position, id) join the vocabulary and an ordered
aggregation joins the bytes.

A match of more than CUT_BYTES is cut first where no token of the vocabulary spans (an Aho-Corasick automaton of all tokens
finds what they span): pieces there have nothing to do with each other, and recur, so text without spaces costs little
more than other text. Pieces of up to SHORT_BYTES take one contraction a step in a table that grows by a step's rows;
longer ones, which are runs of a few repeated bytes, take all places of the least pair in a step, in a table keyed by
position that holds one row a byte. Both give the same ids: in a vocabulary whose tokens are all reached by their own
contractions, which is checked, joining equal pairs at once makes no pair of lower rank; else only the leftmost is joined.

Cases: null text: encoded as empty, no ids; null ids: empty; texts of any length are encoded whole;
special tokens are ordinary text; an id outside the vocabulary is an error; an empty table works; repeated rows are
encoded alike; other columns are not read by encode(), and kept by round_trip().
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Matches longer than this are cut; pieces longer than this are contracted at all places at once.
CUT_BYTES, SHORT_BYTES = 24, 64
#: Bytes of one recursive query, characters of text of one batch, pieces of each half of a worker's cache.
QUERY_BYTES, BATCH_CHARS, CACHE_WORDS = 400_000, 1 << 20, 150_000
DUCKDB_MEMORY = "600MB"

#: Words have fewer positions than 1024, so rank and position make one number to take the least of.
ENCODE = """
WITH RECURSIVE t(word, step, pos, id, pair) AS (
  SELECT word, 0, pos, id, pair FROM tokens
  UNION ALL
  (WITH best AS (
     SELECT word, min(joint::BIGINT * 1024 + pos) AS least FROM t JOIN merges ON merges.a = t.id AND merges.b = t.pair GROUP BY word),
   hit AS (
     SELECT best.word, least % 1024 AS p, least // 1024 AS joint, t.pair FROM best JOIN t ON t.word = best.word AND t.pos = least % 1024 + 1)
   SELECT t.word, t.step + 1,
     CASE WHEN t.pos > p THEN t.pos - 1 ELSE t.pos END,
     CASE WHEN t.pos = p THEN joint ELSE t.id END,
     CASE WHEN t.pos = p THEN hit.pair WHEN t.pos = p - 1 THEN joint ELSE t.pair END
   FROM t JOIN hit ON t.word = hit.word WHERE t.pos <> p + 1))
SELECT word, list(CAST(id AS INTEGER) ORDER BY pos) AS ids
FROM t SEMI JOIN (SELECT word, max(step) AS step FROM t GROUP BY word) last ON last.word = t.word AND last.step = t.step
GROUP BY word
"""
#: t has a row a byte: the token that begins there (null: none any more), where the next one begins, its id, their joint.
ENCODE_LONG = """
WITH RECURSIVE t(word, pos, id, nxt, pair, joint) USING KEY (word, pos) AS (
  SELECT word, pos, tokens.id, pos + 1, pair, merges.joint FROM tokens LEFT JOIN merges ON merges.a = tokens.id AND merges.b = tokens.pair
  UNION
  (WITH best AS (SELECT word, min(joint) AS joint FROM recurring.t WHERE joint IS NOT NULL GROUP BY word),
   hit AS (
     SELECT h.word, h.pos, h.nxt, h.joint, coalesce(lag(h.nxt) OVER w = h.pos, false) AS linked, row_number() OVER w AS k
     FROM recurring.t AS h JOIN best ON best.word = h.word AND best.joint = h.joint WINDOW w AS (PARTITION BY h.word ORDER BY h.pos)),
   cut AS MATERIALIZED (
     SELECT word, pos, nxt, joint
     FROM (SELECT *, k - max(CASE WHEN linked THEN 0 ELSE k END) OVER (PARTITION BY word ORDER BY pos) AS run FROM hit)
     WHERE CASE WHEN joint IN (SELECT joint FROM alone) THEN k = 1 ELSE run % 2 = 0 END),
   made AS (
     SELECT cut.word, cut.pos, cut.joint AS id, n.nxt, coalesce(c.joint, n.pair) AS pair
     FROM cut JOIN recurring.t AS n ON n.word = cut.word AND n.pos = cut.nxt LEFT JOIN cut AS c ON c.word = cut.word AND c.pos = n.nxt
     UNION ALL
     SELECT word, nxt, NULL, NULL, NULL FROM cut
     UNION ALL
     SELECT p.word, p.pos, p.id, p.nxt, cut.joint
     FROM recurring.t AS p JOIN cut ON cut.word = p.word AND cut.pos = p.nxt ANTI JOIN cut AS d ON d.word = p.word AND d.nxt = p.pos WHERE p.id IS NOT NULL)
   SELECT word, pos, made.id, nxt, pair, merges.joint FROM made LEFT JOIN merges ON merges.a = made.id AND merges.b = pair))
SELECT word, list(CAST(id AS INTEGER) ORDER BY pos) AS ids FROM t WHERE id IS NOT NULL GROUP BY word
"""
DECODE = """
SELECT row, unhex(array_to_string(list(vocab.bytes ORDER BY pos), '')) AS text, count(*) AS n, count(vocab.id) AS m
FROM ids LEFT JOIN vocab USING (id) GROUP BY row
"""


@functools.lru_cache(maxsize=4)
def vocabulary(path: str | None) -> dict[bytes, int]:
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_table(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """(left, right, joint) for each way to part a token into two others."""
    return [(ranks[t[:i]], ranks[t[i:]], joint) for t, joint in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]


def alone(ranks: dict[bytes, int], merges: list[tuple[int, int, int]]) -> set[int]:
    """Tokens that may meet a pair of lower rank than their own once they are made: none where each token is reached by the
    contractions of its own bytes, as those of lower rank come first."""
    early = [(a, b, joint) for a, b, joint in merges if joint < max(a, b)]
    of = {rank: t for t, rank in ranks.items()}

    def reached(joint: int) -> bool:
        parts = [of[joint][i : i + 1] for i in range(len(of[joint]))]
        while len(parts) > 1:
            rank, i = min((ranks.get(x + y, joint + 1), i) for i, (x, y) in enumerate(itertools.pairwise(parts)))
            if rank > joint:
                return False
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return True

    good = {joint: reached(joint) for joint in {j for *_, j in early}}
    return {t for a, b, joint in early if not good[joint] for t in (a, b) if t > joint}


def pretoken_pattern() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


#: The same pattern in the faster engine, for texts whose letters and digits are all within these ranges.
_LATIN = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_LATIN_TEXT = re.compile(f"[\\x09-\\x0d\\x20-\\x7e\\xa0-\\xff{_LATIN}‐-‧‰-⁞€]*")
_LATIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9²³¹¼-¾]+| ?[^\\s{_LATIN}0-9²³¹¼-¾]+|\\s+(?!\\S)|\\s+")


class Codec:
    """A vocabulary in a DuckDB database of this worker, with the pieces met so far."""

    def __init__(self, path: str | None = None, short: int = SHORT_BYTES):
        import ahocorasick
        import duckdb
        import pandas as pd

        self.ranks, self.short = vocabulary(path), short
        merges = merge_table(self.ranks)
        self.folder = tempfile.TemporaryDirectory(prefix="bpe-")  # deleted with the worker
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "preserve_insertion_order": False, "temp_directory": self.folder.name})
        m = pd.DataFrame(merges, columns=["a", "b", "joint"])
        v = pd.DataFrame({"id": list(self.ranks.values()), "bytes": [t.hex().upper() for t in self.ranks]})
        one = pd.DataFrame({"joint": np.array(sorted(alone(self.ranks, merges)), np.int32)})
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        for name, frame in (("merges", m), ("vocab", v), ("alone", one)):
            self.db.register("given", frame)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.tokens = ahocorasick.Automaton()
        for t in self.ranks:
            if len(t) > 1:
                self.tokens.add_word(t.decode("latin-1"), len(t))
        if len(self.tokens):
            self.tokens.make_automaton()
        self.pattern = pretoken_pattern()
        self.known: dict[str | bytes, bytes] = {}  # of matches and pieces, ids as 32-bit numbers
        self.older: dict[str | bytes, bytes] = {}

    def pieces(self, word: bytes) -> list[bytes]:
        """A match, cut wherever no token spans."""
        if len(word) <= CUT_BYTES or len(set(word)) < 3 or not len(self.tokens):
            return [word]
        spanned = bytearray(len(word) + 1)
        for end, size in self.tokens.iter(word.decode("latin-1")):
            spanned[end + 2 - size : end + 1] = b"\1" * (size - 1)
        cuts = [0, *(i for i in range(1, len(word)) if not spanned[i]), len(word)]
        return [word[x:y] for x, y in itertools.pairwise(cuts)]

    def words(self, text: str) -> list[str]:
        return (_LATIN_WORDS if _LATIN_TEXT.fullmatch(text) else self.pattern).findall(text)

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Adds the ids of words to those known, and gives back those of words that were cut: their pieces are known instead.

        What hasn't been met for long is forgotten.
        """
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        rest: tuple[dict[str | bytes, bytes], dict[str | bytes, bytes]] = ({}, {})  # by length: key and bytes
        cut: dict[str, list[bytes]] = {}

        def meet(key: str | bytes, plain: bytes) -> None:
            if key not in self.known:
                if (ids := self.older.get(key)) is not None:
                    self.known[key] = ids
                else:
                    rest[len(plain) > self.short][key] = plain

        for w in words:
            if w in self.known:
                continue
            plain = w.encode()
            parts = self.pieces(plain)
            if len(parts) == 1:
                meet(w, plain)
            else:
                cut[w] = parts
                for p in parts:
                    meet(p, p)
        for some, query in zip(rest, (ENCODE, ENCODE_LONG), strict=True):
            keys, plain = list(some), list(some.values())
            for x, y in _runs([len(w) for w in plain], QUERY_BYTES):
                self._contract(keys[x:y], plain[x:y], query)
        return {w: b"".join(map(self.known.__getitem__, parts)) for w, parts in cut.items()}

    def _contract(self, keys: list[str | bytes], plain: list[bytes], query: str) -> None:
        self.db.register("tokens", self._rows(plain))
        found = self.db.sql(query).to_arrow_table().combine_chunks()
        self.db.unregister("tokens")
        for lists, at in ((found.column(1).chunk(c), found.column(0).chunk(c)) for c in range(found.column(1).num_chunks)):
            ids = lists.flatten().to_numpy().astype("<i4").tobytes()
            ends = (4 * np.cumsum(lists.value_lengths().to_numpy())).tolist()
            start = 0
            for i, end in zip(at.to_pylist(), ends, strict=True):
                self.known[keys[i]] = ids[start:end]
                start = end

    def _rows(self, words: list[bytes]) -> pa.Table:
        """(word, pos, id, pair) of the single bytes of some words; pair is the next one's id, null at a word's end."""
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        ids = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        last = np.zeros(len(ids), bool)
        last[ends - 1] = True
        pos = np.arange(1, len(ids) + 1) - np.repeat(ends - sizes, sizes)
        word = np.repeat(np.arange(len(words)), sizes)
        return pa.table({"word": word.astype(np.int32), "pos": pos.astype(np.int32), "id": ids, "pair": pa.array(np.append(ids[1:], 0), mask=last, type=pa.int32())})

    def encode(self, texts: list[str]) -> pa.ListArray:
        """The ids of each text."""
        split = [self.words(t) for t in texts]
        cut = self.learn(set(itertools.chain.from_iterable(split)))
        look = self.known.__getitem__
        ids = [b"".join([cut[w] if w in cut else look(w) for w in words] if cut else map(look, words)) for words in split]
        offsets = np.zeros(len(ids) + 1, np.int32)
        np.cumsum([len(i) // 4 for i in ids], out=offsets[1:])
        flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(ids))])
        return pa.ListArray.from_arrays(pa.array(offsets), flat)

    def decode(self, ids: pa.ListArray) -> list[bytes]:
        """The bytes of each list of ids: rows join the vocabulary, an ordered aggregation joins them again."""
        flat = ids.flatten()
        sizes = np.nan_to_num(ids.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        self.db.register("ids", pa.table({"row": np.repeat(np.arange(len(ids), dtype=np.int32), sizes), "pos": np.arange(len(flat), dtype=np.int32), "id": flat}))
        found = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("ids")
        out = [b""] * len(ids)
        for row, text, n, m in zip(*(c.to_pylist() for c in found.columns), strict=True):
            if n != m:
                raise ValueError("an id is not in the vocabulary")
            out[row] = text
        return out


_CODECS: dict[str | None, Codec] = {}


def codec(path: str | None = None) -> Codec:
    """The worker's codec of a vocabulary; tasks that follow each other share what it has learnt."""
    return _CODECS.get(path) or _CODECS.setdefault(path, Codec(path))


def _runs(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for i, n in enumerate(sizes):
        held += n
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for x, y in _runs([len(t) for t in texts], BATCH_CHARS):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), own.encode(texts[x:y])], ["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids, bytes) of every row of (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for b in batches:
            ids = b.column(1)
            for x, y in _runs([4 * (n or 0) for n in ids.value_lengths().to_pylist()], BATCH_CHARS):
                part = ids.slice(x, y - x)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), part, pa.array(own.decode(part), pa.binary())], ["doc_id", "ids", "bytes"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, bytes binary")


def round_trip(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """docs with each text encoded and decoded again, and all columns it came with; null texts stay null.

    with_ids: two more columns, ids and n_tokens, under names that docs doesn't have yet.
    """
    names = docs.columns
    at = names.index(text_col)
    added = [next(f"{n}{k or ''}" for k in range(len(names) + 1) if f"{n}{k or ''}" not in names) for n in ("ids", "n_tokens")] if with_ids else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for b in batches:
            texts = b.column(at).to_pylist()
            for x, y in _runs([len(t or "") for t in texts], BATCH_CHARS):
                ids = own.encode([t or "" for t in texts[x:y]])
                back = own.decode(ids)
                columns = [c.slice(x, y - x) for c in b.columns]
                columns[at] = pa.array([None if t is None else d.decode("utf-8") for t, d in zip(texts[x:y], back, strict=True)], pa.string())
                if added:
                    columns += [ids, ids.value_lengths().cast(pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, *added])

    schema = docs.schema
    if added:
        schema = StructType([*schema.fields, StructField(added[0], ArrayType(IntegerType())), StructField(added[1], LongType())])
    return docs.mapInArrow(run, schema)


def ids_digest(ids: Column) -> Column:
    return F.sha2(F.array_join(ids, ","), 256)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def reference_digest(ids: list[int], text: str) -> tuple[int, str, str]:
    """The result columns for one row, for tests."""
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
