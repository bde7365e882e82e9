"""Benchmark decontamination by spaced-seed hashing, in DataFrame and SQL functions alone.

Fixed masks lay over the words of a text and ignore some of the positions, so a seed survives a substituted word under
an ignored position. Seeds of all positions of all documents join the seeds of the benchmark items; around each hit the
words along its diagonal (document position less item position) are compared, and a hit counts where some stretch of
STRETCH words, or the whole item where it is shorter, agrees in at least AGREE percent of its words.

The seeds lose nothing: MASKS are such that any 12 to 16 words of which AGREE percent agree hold one of them whole. An item
of fewer than 12 words may differ in k words, so it is cut into k+1 runs of equal length, one of which is whole; these
runs are masks without gaps, and only used when the benchmark has such items.

The benchmark is broadcast while it has at most BROADCAST_SEEDS seeds, a size that is counted first; a seed is some 40 bytes
(hash, item, place, length of the item), and the items' words, which are no more than their seeds, are a table of their own that hits
meet afterwards. The seeds are then probed in the task that made them, and only hits leave it. A larger benchmark joins by shuffle: only hashes and positions
move, and words come back for the documents that were hit. Words are maximal runs of letters and digits, lower-cased;
they are compared by 64-bit hashes.

Cases: null texts have no words; items of fewer than LEAST_WORDS words say too little to be a leak and are left out, as are
null item ids; rows that share a doc_id count as one document in leaks();
clean() judges each row by its own text, whatever its id, and keeps all columns; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mullion.llm.common import written

#: Word positions that count under each mask.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 6, 8, 9), (0, 1, 3, 6, 7), (0, 1, 3, 10, 11))
#: Items of so many words are met by MASKS; shorter ones by runs.
MASKED_WORDS = 12
STRETCH, AGREE, LEAST_WORDS = 16, 75, 4
BROADCAST_SEEDS = 1_000_000


def word_keys(text: str) -> Column:
    """The words of a text as 64-bit hashes."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def run_length(n: int) -> int:
    """Of an item of n words with as many substitutions as AGREE allows, the length of a run that one of its parts keeps."""
    return n // (n * (100 - AGREE) // 100 + 1)


def masks_for(items: DataFrame) -> list[tuple[tuple[int, ...], tuple[int, ...] | None]]:
    """(mask, lengths of the items that it is for) of the items (item_words); the lengths None: MASKED_WORDS or more."""
    sizes = [r.n for r in items.select(F.size("item_words").alias("n")).where(F.col("n") < MASKED_WORDS).distinct().orderBy("n").collect()]  # fewer than MASKED_WORDS rows
    short = {run_length(n): tuple(m for m in sizes if run_length(m) == run_length(n)) for n in sizes}
    return [(m, None) for m in MASKS] + [(tuple(range(k)), of) for k, of in sorted(short.items())]


def seeds(df: DataFrame, keys: str, masks: list, *kept: str, items: bool = False) -> DataFrame:
    """A row (kept..., at, seed) for each position and mask.

    Both generators, the hashes and a broadcast join above them compile into one stage, so the word array of a document
    is never copied for its positions. (The outer form keeps the optimizer from computing it once more for a filter.)
    """
    at = df.select(*dict.fromkeys((*kept, keys)), F.posexplode_outer(keys).alias("at", "first"))
    each = []
    for k, (mask, of) in enumerate(masks):
        whole = F.get(keys, F.col("at") + mask[-1]).isNotNull()
        if items:
            whole &= F.size(keys) >= MASKED_WORDS if of is None else F.size(keys).isin(*of)
        each.append(F.when(whole, F.xxhash64(F.lit(k), *[F.get(keys, F.col("at") + o) for o in mask])))
    made = at.select(*kept, "at", F.array(*each).alias("__seeds"))
    return made.select(*kept, "at", F.explode_outer("__seeds").alias("seed")).where("seed is not null")


def _beside(found: DataFrame) -> DataFrame:
    """Of hits with the document's words, those that lie along the item, one row a diagonal."""
    d = F.col("at") - F.col("item_at")
    found = found.select(
        "doc_id", "key", "item_id", "item_key", d.alias("diagonal"),
        F.slice("words", F.greatest(d, F.lit(0)) + 1, F.greatest(F.col("item_size") + F.least(d, F.lit(0)), F.lit(0))).alias("near"),
    )
    return found.groupBy("doc_id", "key", "item_id", "item_key", "diagonal").agg(F.first("near").alias("near"))


def _confirmed(hits: DataFrame) -> DataFrame:
    """(doc_id, key, item_id, agreed, stretch) of the diagonals on which some stretch agrees."""
    lead = F.greatest(-F.col("diagonal"), F.lit(0))  # words of the item before the document begins
    same = F.transform("item_words", lambda w, k: F.coalesce((F.get("near", F.when(k >= lead, k - lead)) == w).cast("int"), F.lit(0)))
    hits = hits.select("doc_id", "key", "item_id", same.alias("same"), F.least(F.size("item_words"), F.lit(STRETCH)).alias("stretch"))
    sums = F.transform(F.sequence(F.lit(0), F.size("same") - F.col("stretch")), lambda s: F.aggregate(F.slice("same", s + 1, F.col("stretch")), F.lit(0), lambda x, y: x + y))
    hits = hits.select("doc_id", "key", "item_id", F.array_max(sums).alias("agreed"), "stretch")
    return hits.where(100 * F.col("agreed") >= AGREE * F.col("stretch"))


def _hits(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """Confirmed diagonals of documents (key, doc_id, __text)."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("__item")).where("item_id is not null").select("item_id", word_keys("__item").alias("item_words"))
    items = items.where(F.size("item_words") >= LEAST_WORDS).distinct()  # items may share an id, so a key says which one it is
    items = written(items.select("*", F.xxhash64("item_id", "item_words").alias("item_key"), F.size("item_words").alias("item_size")), "items")
    masks = masks_for(items)
    planted = seeds(items, "item_words", masks, "item_id", "item_key", "item_size", items=True).withColumnRenamed("at", "item_at")
    words = items.select("item_id", "item_key", "item_words")
    texts = docs
    docs = docs.select("doc_id", "key", word_keys("__text").alias("words"))
    if planted.select(F.lit(1)).limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS:
        return _confirmed(_beside(seeds(docs, "words", masks, "doc_id", "key", "words").join(F.broadcast(planted), "seed")).join(F.broadcast(words), ["item_id", "item_key"]))
    found = seeds(docs, "words", masks, "doc_id", "key").join(planted, "seed")
    d = F.col("at") - F.col("item_at")
    found = found.groupBy("doc_id", "key", "item_id", "item_key", "item_size", d.alias("diagonal")).agg(F.min("at").alias("at"), F.min("item_at").alias("item_at"))
    texts = texts.dropDuplicates(["doc_id", "key"]).select(F.col("doc_id").alias("__doc"), F.col("key").alias("__key"), "__text")
    found = found.join(texts, (F.col("key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__doc")))
    found = found.withColumn("words", word_keys("__text"))
    return _confirmed(_beside(found).join(words, ["item_id", "item_key"]))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, agreed, stretch, n_places) of each document and benchmark item that overlap; a place is a diagonal."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("__text"))
    found = _hits(docs, benchmark, item_col, item_text)
    return found.groupBy("doc_id", "item_id").agg(F.max("agreed").cast("long").alias("agreed"), F.max("stretch").cast("long").alias("stretch"), F.count("*").alias("n_places"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that no benchmark item overlaps with, as they came."""
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("__text"))
    found = written(_hits(keyed, benchmark, item_col, item_text).select(F.col("doc_id").alias("__doc"), F.col("key").alias("__key")).distinct(), "leaks")
    # the rows move as one column, so none of their names meets those of this join
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(found, rows["doc_id"].eqNullSafe(found["__doc"]) & (rows["key"] == found["__key"]), "left_anti").select("row.*")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _oracle() -> str:
    """The same result in DuckDB, without masks: runs of 2 or 3 words that every overlap of this kind must hold are compared."""
    words = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, w, CASE WHEN len(w) IN (4, 5, 8) THEN 2 ELSE 3 END AS k FROM (SELECT item_id, {words} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) >= 4),
ks AS (SELECT DISTINCT k FROM b),
ds AS (SELECT doc_id, w, i, k, array_to_string(w[i : i + k - 1], ' ') AS run FROM d, ks, unnest(range(1, len(w) + 1)) AS r(i) WHERE i + k - 1 <= len(w)),
bs AS (SELECT item_id, w, i, k, array_to_string(w[i : i + k - 1], ' ') AS run FROM b, unnest(range(1, len(w) + 1)) AS r(i) WHERE i + k - 1 <= len(w)),
hit AS (SELECT DISTINCT doc_id, item_id, ds.i - bs.i AS dg FROM ds JOIN bs ON ds.run = bs.run AND ds.k = bs.k),
pair AS (SELECT hit.doc_id, hit.item_id, dg, d.w AS dw, b.w AS bw FROM hit JOIN d ON d.doc_id = hit.doc_id JOIN b ON b.item_id = hit.item_id),
same AS (SELECT doc_id, item_id, least(len(bw), {STRETCH}) AS stretch,
  list_transform(range(1, len(bw) + 1), lambda k: CASE WHEN dg + k >= 1 AND dg + k <= len(dw) AND dw[CASE WHEN dg + k >= 1 THEN dg + k ELSE 1 END] = bw[k] THEN 1 ELSE 0 END) AS s FROM pair),
best AS (SELECT doc_id, item_id, stretch, list_max(list_transform(range(1, len(s) - stretch + 2), lambda p: list_sum(s[p : p + stretch - 1]))) AS agreed FROM same)
SELECT doc_id, item_id, CAST(max(agreed) AS BIGINT) AS agreed, CAST(max(stretch) AS BIGINT) AS stretch, count(*) AS n_places
FROM best WHERE 100 * agreed >= {AGREE} * stretch GROUP BY doc_id, item_id
"""


OP5_SQL = _oracle()
