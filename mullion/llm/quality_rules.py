"""Quality rules: a threshold table compiled into one projection of built-in expressions.

Repeated windows are found by hash and confirmed by their words, so counts are exact in texts of any length.
Cases: null text counts as empty (no words, base_failed, not kept); ratios over zero words, lines or characters are 0;
repeated rows and ids are judged row by row; extra columns are ignored by judge() and kept by passing(), whatever their
names; an empty table gives an empty table.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mullion.llm.common import WORD_GAP, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Frequent function words of the corpus languages.
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he at but are this have from or had an they which one",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou elle",
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an er so dass aus bei sie",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como o pero sus le ha me si sin",
}


WORD_HASH = F.xxhash64


class Rule(NamedTuple):
    """A document breaks the rule where its metric is under `least` or over `most`."""

    name: str
    metric: str
    least: float | None
    most: float | None


#: The threshold table. Wide bounds: a rule names junk, not style.
RULES = (
    Rule("word_count", "n_words", MIN_WORDS, None),
    Rule("repeated_trigrams", "repeat_ratio", None, MAX_REPEAT_PERCENT / 100),
    Rule("word_length", "mean_word_chars", 2.0, 14.0),
    Rule("symbols", "symbols_per_word", None, 0.3),
    Rule("stop_words", "stop_ratio", 0.02, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.5),
    Rule("bullet_lines", "bullet_line_ratio", None, 0.9),
    Rule("letters", "letter_ratio", 0.6, None),
)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def measures(text: str) -> list[dict[str, Column]]:
    """Steps of columns, each over those before; a step's heavy arrays are computed once."""
    stop = sorted({w for words in STOP_WORDS.values() for w in words.split()})
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # bits of the hash of a 3-word window above, its position below: one sort of plain longs brings equal windows together
    packed = F.expr(
        "if(n_words >= 3, sort_array(transform(sequence(0, int(n_words) - 3), i -> shiftleft(xxhash64(get(__h, i), get(__h, i + 1), get(__h, i + 2)), __bits) | bigint(i))), cast(array() as array<bigint>))"
    )
    # what shares the kept bits of its hash with a neighbour; where bits ran short in a long text, some of it by chance
    alike = F.expr(
        "sort_array(transform(filter(__packed, (x, j) -> coalesce(shiftright(get(__packed, j - 1), __bits) = shiftright(x, __bits), false) or coalesce(shiftright(get(__packed, j + 1), __bits) = shiftright(x, __bits), false)), x -> x & (shiftleft(1L, __bits) - 1L)))"
    )
    # so the words themselves decide: equal windows come together by hash and words
    named = F.expr(
        "array_sort(transform(__alike, i -> struct(xxhash64(get(__h, int(i)), get(__h, int(i) + 1), get(__h, int(i) + 2)) as h, concat_ws(' ', get(__words, int(i)), get(__words, int(i) + 1), get(__words, int(i) + 2)) as g, i as i)))"
    )
    twice = F.expr("sort_array(transform(filter(__named, (x, j) -> coalesce(get(__named, j - 1).g = x.g, false) or coalesce(get(__named, j + 1).g = x.g, false)), x -> x.i))")
    covered = F.expr("aggregate(__twice, struct(0L as total, 0L as upto), (s, p) -> struct(s.total + p + 3L - greatest(p, s.upto) as total, p + 3L as upto), s -> s.total)")
    return [
        {"__words": words_of(text), "__lines": lines},
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.regexp_replace(t, WORD_GAP, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long"),
            "__n_letters": F.length(F.regexp_replace(t, r"\P{L}+", "")),
            "__n_lines": F.size("__lines"),
            "__n_bullets": F.size(F.filter("__lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•‣]"))),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__n_stop": F.size(F.filter("__words", lambda w: F.lower(w).isin(*stop))),
            "__h": F.transform("__words", lambda w: WORD_HASH(w)),
            "__bits": F.length(F.bin(F.size("__words").cast("long"))),
        },
        {"__packed": packed},
        {"__alike": alike},
        {"__named": named},
        {"__twice": twice},
        {"n_repeat_words": covered},
        {
            "repeat_ratio": _ratio(F.col("n_repeat_words"), F.col("n_words")),
            "mean_word_chars": _ratio(F.col("word_chars"), F.col("n_words")),
            "symbols_per_word": _ratio(F.col("n_symbols"), F.col("n_words")),
            "stop_ratio": _ratio(F.col("__n_stop"), F.col("n_words")),
            "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.col("__n_lines")),
            "bullet_line_ratio": _ratio(F.col("__n_bullets"), F.col("__n_lines")),
            "letter_ratio": _ratio(F.col("__n_letters"), F.col("word_chars")),
        },
    ]


def broken_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a row breaks: the table as one expression."""
    tests = []
    for r in rules:
        low = F.col(r.metric) < r.least if r.least is not None else F.lit(False)
        high = F.col(r.metric) > r.most if r.most is not None else F.lit(False)
        tests.append(F.when(low | high, F.lit(r.name)))
    return F.array_compact(F.array(*tests))


def _held(verdict: Column) -> Column:
    """The verdict, in a form that no filter over it is pushed through.

    Below the steps, a filter would write each measure out again for each of its uses. The id is never negative.
    """
    return F.when(F.monotonically_increasing_id() >= 0, verdict)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, the measures, broken (rule names), base_failed and kept. Never drops a row."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    for step in measures("__text"):
        df = df.select(*df.columns, *[c.alias(k) for k, c in step.items()])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    df = df.withColumns({"broken": broken_rules(rules), "base_failed": failed})
    df = df.withColumn("kept", _held(~F.col("base_failed") & (F.size("broken") == 0)))
    return df.select(*[c for c in df.columns if not c.startswith("__")])


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows that break no rule, with the columns they came with."""
    names = docs.columns
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.col(text_col).alias("__text"))
    for step in measures("__text"):
        df = df.select(*df.columns, *[c.alias(k) for k, c in step.items()])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    kept = _held(~failed & (F.size(broken_rules(rules)) == 0))
    return df.select("__row", kept.alias("__kept")).where("__kept").select("__row.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: All measures and the verdict over every text, with its own copy of words and bounds.
OP6_SQL = r"""
WITH x AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda s: s <> '') AS w,
      list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS l FROM x),
z AS (SELECT r, list_zip(w, w[2:], w[3:], true) AS z FROM w WHERE len(w) >= 3),
g AS (SELECT r, unnest(z) AS g, generate_subscripts(z, 1) AS i FROM z),
twice AS (SELECT r, unnest(list(i)) AS i FROM g GROUP BY r, g HAVING count(*) > 1),
again AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(t, '\P{L}+', '', 'g')) AS n_letters,
      len(list_filter(l, lambda s: regexp_matches(s, '^[\x20\x09-\x0D]*[-*•‣]'))) AS n_bullets,
      len(list_filter(w, lambda s: lower(s) IN (
        'the', 'of', 'and', 'to', 'in', 'a', 'is', 'that', 'for', 'it', 'as', 'was', 'with', 'be', 'by', 'on', 'not', 'he', 'at', 'but', 'are', 'this', 'have', 'from', 'or', 'had', 'an', 'they', 'which', 'one',
        'de', 'la', 'le', 'et', 'les', 'des', 'en', 'un', 'du', 'une', 'que', 'est', 'pour', 'qui', 'dans', 'par', 'plus', 'pas', 'au', 'sur', 'ne', 'se', 'ce', 'il', 'sont', 'avec', 'ou', 'elle',
        'der', 'die', 'und', 'den', 'von', 'zu', 'das', 'mit', 'sich', 'auf', 'ist', 'im', 'dem', 'nicht', 'ein', 'eine', 'als', 'auch', 'es', 'er', 'so', 'dass', 'aus', 'bei', 'sie',
        'el', 'y', 'los', 'del', 'las', 'por', 'con', 'no', 'una', 'su', 'para', 'al', 'lo', 'como', 'o', 'pero', 'sus', 'ha', 'me', 'si', 'sin'))) AS n_stop
      FROM w LEFT JOIN again ON again.r = w.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 14.0 AND n_symbols / n_words <= 0.3 AND n_stop / n_words >= 0.02
       AND n_dup_lines / n_lines <= 0.5 AND n_bullets / n_lines <= 0.9 AND n_letters / word_chars >= 0.6 AS kept
FROM b
"""
