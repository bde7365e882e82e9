"""URL filters: a sorted array of 64-bit digests, memory-mapped on each executor and probed by binary search.

A rule is (verdict, host, path): it fits its host and all subdomains where the url's path starts with the rule's path.
Of the rules that fit, the longest host plus path wins. Entries of the verdict "listed" are the block list proper: they
block where no allow or block rule fits, and are not named as the rule. Cases: null urls and urls without "://" have an empty host and
path; a url that no rule fits gets the default verdict; repeated rows are judged row by row; ports, user names and
letters outside A-Z stay as they are; null ids stay null; an empty table or rule list works; columns besides id and url are
not read, whatever their names.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from mullion.llm.common import fresh_path, open_fs

#: The rules that every query of this operator holds.
BASE_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Hosts of an ad and pills kind; a parameter, as any block list of real size is.
SPAM_HOSTS = ("cheap-pills.example.com", "cheap-pills.example.net", "cheap-pills.example.org", "free-bets.example.com", "free-bets.example.net", "free-bets.example.org")
LISTED = tuple(("listed", h, "/") for h in SPAM_HOSTS)
VERDICTS = ("allow", "block", "listed")
LOWER = {c: c + 32 for c in range(65, 91)}
HEAD = struct.Struct("<4sqqq")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) of a url."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    rest = rest[:cut]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(LOWER), path


class DigestArray:
    """A file of sorted 64-bit xxhash keys, the place of each key's full string, and the strings; opened by memory map.

    Layout: head (magic, keys n, labels of the longest host, path lengths m); n keys; n+1 text offsets; n verdicts;
    m lengths; text.
    """

    MAGIC = b"SDA2"

    @classmethod
    def write(cls, rules: Iterable[tuple[str, str, str]], f: BinaryIO) -> None:
        by_key: dict[bytes, str] = {}
        lengths: set[int] = set()
        labels = 0
        for verdict, host, prefix in rules:
            by_key.setdefault(f"{host.translate(LOWER)}{prefix}".encode(), verdict)
            lengths.add(len(prefix))
            labels = max(labels, host.count(".") + 1)
        text = sorted(by_key, key=lambda s: (xxhash.xxh64_intdigest(s), s))
        keys = np.array([xxhash.xxh64_intdigest(s) for s in text], np.uint64)
        offsets = np.zeros(len(text) + 1, np.int64)
        np.cumsum([len(s) for s in text], out=offsets[1:])
        f.write(HEAD.pack(cls.MAGIC, len(text), labels, len(lengths)))
        f.write(keys.tobytes() + offsets.tobytes() + np.array([VERDICTS.index(by_key[s]) for s in text], np.int8).tobytes())
        f.write(np.array(sorted(lengths, reverse=True), np.int64).tobytes() + b"".join(text))

    def __init__(self, path: str):
        whole = np.memmap(path, np.uint8, "r")
        magic, n, self.labels, m = HEAD.unpack(bytes(whole[: HEAD.size]))
        if magic != self.MAGIC:
            raise ValueError(f"{path} is no digest array")
        at = HEAD.size

        def take(count: int, kind: type) -> np.ndarray:
            nonlocal at
            part = whole[at : at + count * np.dtype(kind).itemsize].view(kind)
            at += part.nbytes
            return part

        self.keys, self.offsets, self.verdicts, self.lengths = take(n, np.uint64), take(n + 1, np.int64), take(n, np.int8), take(m, np.int64)
        self.text = whole[at:]

    def probe(self, candidates: list[bytes]) -> np.ndarray:
        """The place of each candidate in the array, -1 where it isn't: one binary search for all, then full strings."""
        found = np.full(len(candidates), -1, np.int64)
        if not len(self.keys) or not candidates:
            return found
        digests = np.fromiter(map(xxhash.xxh64_intdigest, candidates), np.uint64, len(candidates))
        place = np.searchsorted(self.keys, digests)
        near = np.minimum(place, len(self.keys) - 1)
        for i in np.flatnonzero(self.keys[near] == digests):
            j = int(near[i])
            while j < len(self.keys) and self.keys[j] == digests[i]:  # equal digests of different strings stand together
                if self.text[self.offsets[j] : self.offsets[j + 1]].tobytes() == candidates[i]:
                    found[i] = j
                    break
                j += 1
        return found


def _keys(host: str, path: str, lengths: list[int], labels: int) -> list[str]:
    """What a rule for this url may look like: each suffix of the host, of no more labels than any rule has, with each
    stored length of path prefix. So a host of very many labels costs no more than one of a few."""
    if not host and not path:
        return []
    parts = host.rsplit(".", labels)[-labels:] if labels else []
    prefixes = dict.fromkeys(path[:n] for n in lengths if n <= len(path))
    return [".".join(parts[i:]) + p for i in range(len(parts)) for p in prefixes]


def judge_batches(batches: Iterator[pa.RecordBatch], array: DigestArray, default: str) -> Iterator[pa.RecordBatch]:
    lengths = array.lengths.tolist()
    for b in batches:
        parts = [split_url(u) for u in b.column(1).to_pylist()]
        owner: list[int] = []
        candidates: list[str] = []
        for i, (host, path) in enumerate(parts):
            own = _keys(host, path, lengths, array.labels)
            candidates += own
            owner += [i] * len(own)
        found = array.probe([c.encode("utf-8", "surrogatepass") for c in candidates])
        rule: list[str | None] = [None] * len(parts)
        verdict = [default] * len(parts)
        for c in np.flatnonzero(found >= 0):
            i = owner[c]
            kind = VERDICTS[array.verdicts[found[c]]]
            if kind == "listed":
                verdict[i] = verdict[i] if rule[i] else "block"
            elif rule[i] is None or len(candidates[c]) > len(rule[i]):
                rule[i], verdict[i] = candidates[c], kind
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
            ["page_id", "host", "path", "rule", "verdict"],
        )


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = BASE_RULES + LISTED, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of each row. The array goes to the executors as a file, not as a broadcast value.

    The file stands in the shared folder as long as the result may be computed.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "digests")
    fs, root = open_fs(path)
    with fs.open_output_stream(root) as f:
        DigestArray.write(rules, f)
    spark.sparkContext.addFile(path)
    name = path.rsplit("/", 1)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return judge_batches(batches, DigestArray(SparkFiles.get(name)), default)

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col).mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP10_SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, position('://' IN coalesce(url, '')) AS p FROM pages),
cut AS (SELECT page_id, CASE WHEN p = 0 THEN '' ELSE regexp_extract(substr(url, p + 3), '^[^?#]*') END AS rest FROM u),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN position('/' IN rest) = 0 THEN '' ELSE substr(rest, position('/' IN rest)) END AS path FROM cut),
rules(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
listed(lhost) AS (VALUES ('cheap-pills.example.com'), ('cheap-pills.example.net'), ('cheap-pills.example.org'),
  ('free-bets.example.com'), ('free-bets.example.net'), ('free-bets.example.org')),
spam AS (SELECT DISTINCT page_id FROM parts JOIN listed ON (host = lhost OR ends_with(host, '.' || lhost)) AND starts_with(path, '/')),
fits AS (
  SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS k
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT parts.page_id, host, path, rule, coalesce(verdict, CASE WHEN spam.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM parts LEFT JOIN fits ON fits.page_id = parts.page_id AND k = 1 LEFT JOIN spam ON spam.page_id = parts.page_id
"""
