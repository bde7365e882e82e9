"""N-gram Jaccard join: T-occurrence search over inverted lists of word shingles.

Two documents link when 100 * |A n B| >= 75 * |A u B| of their sets of distinct 5-word shingles (64-bit hashes).

The distributed part of DivideSkip. A partner y of x shares T >= ceil(0.75 |x|) shingles with it. Of x's lists, the T-1
longest are never merged, only probed; so any partner stands in one of the |x|-T+1 shortest, and of those only lists of
two documents or more are moved. (Of a pair, the smaller set has a partner's shingle among still fewer: T >= 6/7 |x|
there. Lists without an entry of that kind lead nowhere.) List lengths are exact counts over all documents, made and told
back by ranges of the hash space (mullion.llm.exchange), so the order of lists is as sharp at any size of corpus: what
most texts have only in common with themselves costs nothing, and a text reaches a list of common words only where over
three quarters of it are such. Documents that meet in a short list form candidate clusters, found as components of star
edges, one edge a posting, never all pairs. Each cluster's documents then come together with their full sets, where
DivideSkip itself runs: heap-merge of short lists with skips, binary probes of long ones, and the exact overlap needed
for the two sizes. Within a cluster, documents already linked to one another aren't searched again: first each document
queries the leaders of the classes so far, then the documents outside the largest class query all others. Clusters over
BLOCK_SHINGLES are dealt into blocks, whose class leaders, then the documents outside the largest class, query every block
that one of their short lists has an entry in.

Cases: null or wordless text: an empty set, linked with nothing; fewer than five words: the whole sequence is one
shingle; equal sets (exact copies, repeated rows) meet by a 128-bit digest, so a group of copies costs one posting list
entry per task; rows that share a doc_id count as one document; null doc_id: in the result with a null component; an
empty table gives an empty table; columns besides id and text are not read by components() and are kept by keep_one().
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mullion.llm.common import WORD_GAP, chunks, connected_components, only_result, partitions_for, window_hashes, word_hashes, written
from mullion.llm.exchange import CHUNK_BYTES, HELD, Told, bits_for, chunked, runs, tell

WORDS = 5
PERCENT = 75
POSTINGS_PER_PARTITION = 1_500_000
CLUSTER_SHINGLES_PER_PARTITION = 2_000_000
#: Shingles of a cluster's documents that come together in one task.
BLOCK_SHINGLES = 1_000_000
#: Lists of so many documents are hot: their smallest document is found by partial aggregation.
HOT_LIST = 20_000
#: Ids of dropped documents that are broadcast: some 64 MB at most.
BROADCAST_IDS = 2_000_000
#: DivideSkip's weight of a probe against a merge step.
MU = 0.0085


def overlap_needed(n: int, m: int, percent: int = PERCENT) -> int:
    """The least overlap i of sets of n and m with 100 i >= percent (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def shingles(texts: list[bytes | None], size: int = WORDS) -> list[np.ndarray]:
    """The shingle hashes of each text, with repeats, in text order."""
    flat, offsets = word_hashes([t.lower() if t else t for t in texts])  # bytes.lower() changes A-Z alone
    whole = window_hashes(flat, size)
    out = []
    for a, b in itertools.pairwise(offsets.tolist()):
        if b - a >= size:
            out.append(whole[a : b - size + 1])
        elif b > a:
            short = window_hashes(flat[a:b], b - a) ^ np.uint64(b - a)
            out.append(short)
        else:
            out.append(whole[:0])
    return out


# -- list lengths ----------------------------------------------------------------------------------------------------


def list_lengths(src: DataFrame, shingles_: int, bits: int, held: int) -> str:
    """The folder of the lengths of all lists of two documents or more, by chunk; src is made by chunked()."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, None]]:
        for chunk, part in runs(batches):
            sets = [np.unique(x) for x in shingles(part.column("text").to_pylist())]
            yield chunk, np.concatenate(sets), None

    rows = src.where("doc_id is not null").select("text", "chunk")
    return tell(rows, of, lambda n, _: n > 1, shingles_, bits, "lengths", held)


# -- short lists and candidate clusters ------------------------------------------------------------------------------


def prefixes(src: DataFrame, lengths: str, bits: int, percent: int = PERCENT, hot_list: int = HOT_LIST) -> DataFrame:
    """Per row: doc_id, n_shingles, a digest of the set, and the shingles of its short lists, hot ones apart.

    Lists of one document are left out. Short lists are null for rows without shingles or id, and for a set that its task
    has seen before: the digest links those rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("short", pa.list_(pa.int64())), ("n_index", pa.int32()), ("hot", pa.list_(pa.int64()))])

    def short_lists(own: np.ndarray, told: Told) -> tuple[np.ndarray, int, np.ndarray | None]:
        n = len(own)
        freq = told.count(own)
        order = np.argsort(freq, kind="stable")[: n - -(-percent * n // 100) + 1]  # by length, then by hash: own is sorted
        own, freq = own[order], freq[order]
        index = np.arange(len(own)) < n - -(-2 * percent * n // (100 + percent)) + 1
        plain, over = (freq > 0) & (freq < hot_list), freq >= hot_list
        return own[plain].view(np.int64), int((plain & index).sum()), own[over].view(np.int64) if over.any() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, seen = Told(lengths, bits), set()
        for chunk, part in runs(batches):
            told.turn_to(chunk)
            ids = part.column("doc_id").to_pylist()
            rows = []
            for doc, flat in zip(ids, shingles(part.column("text").to_pylist()), strict=True):
                own = np.unique(flat)
                digest = xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None
                if digest is None or doc is None or digest in seen:
                    rows.append((len(own), digest, None, None, None))
                else:
                    seen.add(digest)
                    rows.append((len(own), digest, *short_lists(own, told)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[1:], strict=True))], schema=schema)

    return src.select("doc_id", "text", "chunk").mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, short array<bigint>, n_index int, hot array<bigint>")


def star_edges(postings: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges (a, b) that connect the documents of each list: of a star in each list, a task's spanning forest.

    A list is cut where sizes jump so far that no pair over the gap can be similar, and holds only entries that can be
    the smaller or the larger side of a pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if not held:
            return
        h, doc, n, larger = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((n, h))
        h, doc, n, larger = h[order], doc[order], n[order], larger[order].astype(bool)
        if not len(h):
            return
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        least = np.minimum.reduceat(np.where(larger, np.iinfo(np.int64).max, n), start)
        fits = n >= np.repeat(least, np.diff(np.append(start, len(h))))
        h, doc, n = h[fits], doc[fits], n[fits]
        if not len(h):
            return
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (100 * n[:-1] < percent * n[1:])
        start = np.flatnonzero(first)
        low = np.minimum.reduceat(doc, start) if len(start) else doc
        head = np.repeat(low, np.diff(np.append(start, len(h))))
        other = head != doc
        nodes, pairs = np.unique(np.stack([head[other], doc[other]], 1), return_inverse=True)
        pairs = pairs.reshape(-1, 2)
        pairs = np.unique(pairs[:, 0] * len(nodes) + pairs[:, 1])
        classes = Classes(len(nodes))
        forest = [x for x in zip((pairs // max(1, len(nodes))).tolist(), (pairs % max(1, len(nodes))).tolist(), strict=True) if classes.join(*x)]
        for k in range(0, len(forest), 100_000):
            part = nodes[np.array(forest[k : k + 100_000])]
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], ["a", "b"])

    return postings.mapInArrow(run, "a bigint, b bigint")


# -- DivideSkip ------------------------------------------------------------------------------------------------------


class Coded:
    """A set as its size and the sorted codes of those members that a block has lists for."""

    __slots__ = ("codes", "size")

    def __init__(self, size: int, codes: np.ndarray):
        self.size, self.codes = size, codes


class Codes:
    """Numbers for the shingles of a block: of all, or of those in two sets or more, as no other list leads anywhere."""

    def __init__(self, sets: list[np.ndarray], least: int):
        values, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, int))
        self.values = values[n >= least]

    def of(self, own: np.ndarray) -> Coded:
        at = np.searchsorted(self.values, own)
        ok = at < len(self.values)
        ok[ok] = self.values[at[ok]] == own[ok]
        return Coded(len(own), at[ok].astype(np.int32))


class GrowingLists:
    """Inverted lists that sets are added to; sets get growing numbers, so lists stay sorted."""

    def __init__(self) -> None:
        self.lists: dict[int, list[int]] = defaultdict(list)

    def add(self, k: int, own: Coded) -> None:
        for s in own.codes.tolist():
            self.lists[s].append(k)

    def lengths(self, codes: np.ndarray) -> list[tuple[int, int]]:
        lists = self.lists
        return [(len(lists[s]), s) for s in codes.tolist() if s in lists]

    def __getitem__(self, code: int) -> list[int]:
        return self.lists[code]


class FixedLists:
    """Inverted lists of sets that are all there, in two arrays."""

    def __init__(self, sets: list[Coded]):
        code = np.concatenate([s.codes for s in sets]) if sets else np.zeros(0, np.int32)
        of = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s.codes) for s in sets])
        order = np.argsort(code, kind="stable")
        self.of = of[order]
        self.starts = np.searchsorted(code[order], np.arange((int(code.max()) + 2) if len(code) else 1))

    def lengths(self, codes: np.ndarray) -> list[tuple[int, int]]:
        codes = codes[codes < len(self.starts) - 1]
        n = self.starts[codes + 1] - self.starts[codes]
        return [x for x in zip(n.tolist(), codes.tolist(), strict=True) if x[0]]

    def __getitem__(self, code: int) -> list[int]:
        return self.of[self.starts[code] : self.starts[code + 1]].tolist()


class DivideSkip:
    """T-occurrence search in the inverted lists of some sets."""

    def __init__(self, lists: GrowingLists | FixedLists, sets: list[Coded], percent: int = PERCENT):
        self.lists, self.sets, self.percent = lists, sets, percent

    def add(self, own: Coded) -> None:
        self.lists.add(len(self.sets), own)
        self.sets.append(own)

    def search(self, own: Coded, skip: set[int] | None = None) -> list[int]:
        """The numbers of the sets that have the overlap needed with `own`, but for those in `skip`."""
        least = -(-self.percent * own.size // 100)  # whatever the other's size
        if not own.size or len(own.codes) < least:
            return []
        found = self.lists.lengths(own.codes)
        if len(found) < least:
            return []
        found.sort()
        n_long = min(least - 1, int(least / (MU * math.log2(found[-1][0] + 1) + 1)))
        cut = len(found) - n_long
        short, long = [self.lists[s] for _, s in found[:cut]], np.array([s for _, s in found[cut:]], np.int32)
        out = []
        for k, count in self._merge(short, least - n_long, skip or set()):
            other = self.sets[k]
            need = overlap_needed(own.size, other.size, self.percent)
            if count + n_long < need:
                continue
            if n_long:  # binary probes of the long lists, all at once on the candidate's own sorted codes
                at = np.minimum(np.searchsorted(other.codes, long), len(other.codes) - 1)
                count += int((other.codes[at] == long).sum())
            if count >= need:
                out.append(k)
        return out

    @staticmethod
    def _merge(lists: list[list[int]], least: int, skip: set[int]) -> Iterator[tuple[int, int]]:
        """(number, count) of what stands in at least `least` of some sorted lists: heap-merge that skips ahead."""
        from bisect import bisect_left

        heap = [(x[0], i, 0) for i, x in enumerate(lists)]
        heapq.heapify(heap)
        while len(heap) >= least:
            top = heap[0][0]
            popped = []
            while heap and heap[0][0] == top:
                popped.append(heapq.heappop(heap))
            if len(popped) >= least:
                if top not in skip:
                    yield top, len(popped)
                target = top + 1
            else:
                while heap and len(popped) < least - 1:
                    popped.append(heapq.heappop(heap))
                if not heap:
                    return
                target = heap[0][0]  # nothing smaller can reach the count any more
            for _, i, at in popped:
                own = lists[i]
                at = at + 1 if at + 1 >= len(own) or own[at + 1] >= target else bisect_left(own, target, at + 1)
                if at < len(own):
                    heapq.heappush(heap, (own[at], i, at))


class Classes:
    """Union-find over small numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def links_within(ids: list[int], sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect whatever the similar pairs among some documents connect; no pair within a class twice."""
    out: list[tuple[int, int]] = []
    classes = Classes(len(sets))

    def link(x: int, y: int) -> None:
        if classes.join(x, y):
            out.append((ids[x], ids[y]))

    same: dict[bytes, int] = {}
    items = []
    for i, own in enumerate(sets):
        k = same.setdefault(xxhash.xxh3_128_digest(own.tobytes()), i)
        if k == i:
            items.append(i)
        else:
            link(k, i)
    coder = Codes([sets[i] for i in items], 2)
    codes = {i: coder.of(sets[i]) for i in items}
    leaders, named = DivideSkip(GrowingLists(), [], percent), []
    for i in items:
        found = leaders.search(codes[i])
        for k in found:
            link(named[k], i)
        if not found:
            leaders.add(codes[i])
            named.append(i)
    by_class: dict[int, list[int]] = defaultdict(list)
    for i in items:
        by_class[classes.find(i)].append(i)
    if len(by_class) > 1:  # every pair of two classes has a side outside the largest
        largest = max(by_class, key=lambda c: (len(by_class[c]), -c))
        every = [codes[i] for i in items]
        whole = DivideSkip(FixedLists(every), every, percent)
        place = {i: k for k, i in enumerate(items)}
        for c, own in by_class.items():
            if c != largest:
                skip = {place[j] for j in own}
                for i in own:
                    for k in whole.search(codes[i], skip):
                        link(items[k], i)
    return out


class Block:
    """The documents (id, class, set) of a block, for queries by documents of other classes."""

    def __init__(self, base: list[tuple[int, int, np.ndarray]], percent: int = PERCENT):
        self.base, self.codes = base, Codes([x[2] for x in base], 1)
        sets = [self.codes.of(x[2]) for x in base]
        self.index = DivideSkip(FixedLists(sets), sets, percent)
        self.by_class: dict[int, set[int]] = defaultdict(set)
        for k, (_, c, _) in enumerate(base):
            self.by_class[c].add(k)
        self.linked: dict[int, set[int]] = defaultdict(set)

    def query(self, i: int, c: int, own: np.ndarray) -> list[tuple[int, int]]:
        """Links of a document of class c to classes that none of that class has been linked to yet."""
        skip = self.by_class.get(c, set()).union(*(self.by_class[d] for d in self.linked[c]))
        out = []
        for k in self.index.search(self.codes.of(own), skip):
            j, d, _ = self.base[k]
            if d not in self.linked[c]:
                self.linked[c].add(d)
                out.append((j, i))
        return out


def _sets(rows: list[tuple]) -> list[np.ndarray]:
    """The sets of some rows, the text last."""
    return [np.unique(s) for _, texts in chunks([r[-1] for r in rows]) for s in shingles(texts)]


def _in_runs(rows: Iterator[tuple], limit: int = 1 << 20) -> Iterator[list[tuple]]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[-1] or b"")
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _search_blocks(rows: DataFrame, n_shingles: int, percent: int, between: bool) -> DataFrame:
    parts = partitions_for(rows.sparkSession, n_shingles, CLUSTER_SHINGLES_PER_PARTITION)
    rows = rows.select("cluster", "block", "asked", "class", "doc_id", "text").repartition(parts, "cluster", "block").sortWithinPartitions("cluster", "block", "asked", "doc_id")

    def found(own: Iterator[tuple]) -> Iterator[list[tuple[int, int]]]:
        block = None
        for asked, part in itertools.groupby(own, key=lambda r: r[2]):
            if not asked:
                part = list(part)
                if not between:
                    yield links_within([r[4] for r in part], _sets(part), percent)
                    continue
                block = Block([(r[4], r[3], s) for r, s in zip(part, _sets(part), strict=True)], percent)
            elif block:
                for some in _in_runs(part):
                    yield [x for r, s in zip(some, _sets(some), strict=True) for x in block.query(r[4], r[3], s)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for _, own in itertools.groupby(rows, key=lambda r: r[:2]):
            for links in found(own):
                if links:
                    a, b = zip(*links, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def similar_links(docs: DataFrame, table: DataFrame, percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Links (a, b) between the documents of `table` (from prefixes()) that connect all that similar pairs connect."""
    spark = docs.sparkSession
    postings = table.where("short is not null").select("doc_id", "n_shingles", "n_index", F.posexplode("short").alias("at", "h"))
    total = table.agg(F.sum(F.size("short")).alias("n")).first().n or 0
    parts = partitions_for(spark, total, POSTINGS_PER_PARTITION)
    near = star_edges(postings.select("h", "doc_id", "n_shingles", F.col("at") >= F.col("n_index")).repartition(parts, "h"), percent)
    hot = table.where("hot is not null").select("doc_id", F.explode("hot").alias("h"))
    low = hot.groupBy("h").agg(F.min("doc_id").alias("a"))
    near = near.unionByName(hot.join(low, "h").where("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct())
    clusters = connected_components(near, "clusters").withColumnRenamed("component", "cluster")
    own = table.where("short is not null").groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    clusters = clusters.join(own, clusters["node"] == own["doc_id"]).select("doc_id", "cluster", "n_shingles")
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.sum("n_shingles") / block_shingles).cast("int").alias("blocks"))
    clusters = clusters.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    clusters = written(clusters.select("doc_id", "cluster", "n_shingles", "block", "blocks"), "clusters")
    n_near = clusters.agg(F.sum("n_shingles").alias("n")).first().n or 0
    texts = docs.select("doc_id", "text")
    members = clusters.join(texts, "doc_id")
    plain = members.select("cluster", "block", F.lit(False).alias("asked"), F.lit(0).cast("long").alias("class"), "doc_id", "text")
    found = written(_search_blocks(plain, n_near, percent, False), "links")
    large = clusters.where("blocks > 1")
    n_large = large.agg(F.sum("n_shingles").alias("n")).first().n
    if not n_large:
        return found
    texts = written(large.join(texts, "doc_id"), "large")
    # similar documents share a short list, so a document asks only the blocks that its short lists have entries in
    lists = table.where("short is not null").select("doc_id", F.explode(F.concat("short", F.coalesce("hot", F.array().cast("array<bigint>")))).alias("h"))
    lists = written(lists.join(large.select("doc_id", "cluster", "block"), "doc_id"), "lists")
    in_blocks = lists.select("cluster", "h", F.col("block").alias("to")).distinct()
    for leaders in (True, False):  # first one document of each class of each block, then all outside the largest class
        inside = found.join(large.select(F.col("doc_id").alias("a")), "a", "left_semi")
        labels = connected_components(inside.unionByName(large.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))), "large")
        labels = texts.join(labels.select(F.col("node").alias("doc_id"), F.col("component").alias("class")), "doc_id")
        base = labels.select("cluster", "block", F.lit(False).alias("asked"), "class", "doc_id", "text")
        if leaders:
            asked = labels.where("doc_id = class")
        else:
            count = labels.groupBy("cluster", "class").agg(F.count("*").alias("n"))
            most = count.groupBy("cluster").agg(F.max_by("class", F.struct("n", "class")).alias("most"))
            asked = labels.join(most, "cluster").where("class <> most")
        goals = lists.join(asked.select("doc_id"), "doc_id", "left_semi").join(in_blocks, ["cluster", "h"]).select("doc_id", "to").distinct()
        spread = asked.join(goals, "doc_id").select("cluster", F.col("to").alias("block"), F.lit(True).alias("asked"), "class", "doc_id", "text")
        more = _search_blocks(base.unionByName(spread), n_large * 2, percent, True)
        found = written(found.unionByName(more), "links")
    return found


# -- results ---------------------------------------------------------------------------------------------------------


def components(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", block_shingles: int = BLOCK_SHINGLES, hot_list: int = HOT_LIST, chunk_bytes: int = CHUNK_BYTES, held: int = HELD) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest doc_id that links reach."""
    spark = docs.sparkSession
    with only_result(spark) as kept:
        src = chunked(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text_col), "UTF-8").alias("text")), "texts", chunk_bytes)
        size = (src.agg(F.sum("size").alias("n")).first()["n"] or 0) // 6 + 1
        bits = bits_for(size)
        table = written(prefixes(src, list_lengths(src, size, bits, held), bits, percent, hot_list), "shingles")
        found = similar_links(src, table, percent, block_shingles)
        # written, so that the joins below deal out both sides anew and a digest of very many rows can be split
        keyed = table.where("digest is not null and doc_id is not null")
        groups = written(keyed.groupBy("digest").agg(F.min("doc_id").alias("gid")), "groups")
        # a digest's rows join its smallest id; links join the ids of different digests, and an id its own digests
        several = keyed.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("doc_id")
        shown = keyed.where("short is not null").select("digest", "doc_id").unionByName(keyed.select("digest", "doc_id").join(several, "doc_id").select("digest", "doc_id").distinct())
        shown = shown.join(groups, "digest").where("doc_id <> gid").select(F.col("gid").alias("a"), F.col("doc_id").alias("b"))
        labels = connected_components(found.unionByName(shown), "classes").select(F.col("node").alias("gid"), "component")
        groups = written(groups.join(labels, "gid", "left").select("digest", F.coalesce("component", "gid").alias("component_id")), "groups")
        own = table.select("doc_id", "n_shingles", "digest").join(groups, "digest", "left")
        kept.append(written(own.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")), "classes"))
    return kept[0]


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row for each id, that of the least text, and one for each text with words among rows without id.

    Ids and digests are counted first, by partial aggregation; only rows that repeat one of them move.
    """
    words = F.length(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), WORD_GAP, "")) > 0
    alike = F.when(F.col(id_col).isNotNull(), F.concat(F.lit("i"), F.col(id_col).cast("string"))).when(words, F.concat(F.lit("t"), F.sha2(F.col(text_col).cast("binary"), 256)))
    repeated = docs.select(alike.alias("__alike")).where("__alike is not null").groupBy("__alike").agg(F.count("*").alias("__n")).where("__n > 1").select("__alike")
    repeated = written(repeated, "repeated")
    if repeated.isEmpty():
        return docs
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(alike.alias("__alike"), row.alias("__row"), F.col(text_col).alias("__text"))
    once = rows.join(repeated, "__alike", "left_anti")
    again = rows.join(repeated, "__alike", "left_semi")
    again = again.groupBy("__alike").agg(F.min_by("__row", F.struct("__text", F.to_json("__row"))).alias("__row"))
    return once.select("__row.*").unionByName(again.select("__row.*"))


def keep_one(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with the columns it came with: that with the smallest doc_id, of one id that of the least text.

    Rows without id are in no class; of those with equal texts one stays.
    """
    gone = components(docs, percent, id_col, text_col).where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    gone = written(gone, "gone")
    if gone.count() <= BROADCAST_IDS:  # else texts and ids meet by a shuffle
        gone = F.broadcast(gone)
    # the rows move as one column, so none of their names meets that of this join
    rows = docs.select(F.col(id_col).alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return one_of_each(rows.join(gone, rows["id"] == gone["__gone"], "left_anti").select("row.*"), id_col, text_col)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN array_to_string(w[i : i + 4], ' ') ELSE array_to_string(w, ' ') END AS g
      FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_in AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_in JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
sym AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT sym.b, reach.seen FROM reach JOIN sym ON sym.a = reach.doc_id WHERE reach.seen < sym.b)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, c.seen AS component_id
FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id JOIN (SELECT doc_id, min(seen) AS seen FROM reach GROUP BY doc_id) c ON c.doc_id = documents.doc_id
"""
