"""PII by weak supervision, in DataFrame and SQL functions alone.

Regular expressions find candidates of each kind with their code point spans. Labelers vote on each (-1, 0, +1): the
format (checks such as Luhn), a gazetteer (issuers, top-level domains, country codes, given names), the words around it
and its shape. Votes of all documents are counted by pattern, a table with a fixed bound of rows; on it, expectation-
maximisation estimates each labeler's reliability and each kind's rate, and a logistic span classifier is trained on the
posteriors. The classifier, as one expression, adds spans; those of the base patterns stay whatever it says.

Patterns are possessive and start at run borders, so they are linear in the text and don't recurse on long runs.
Cases: null text: empty, no spans; equal rows and ids are judged row by row; spans of different kinds may overlap, those of
one kind don't; an empty table gives an empty table; columns besides id and text are not read by find_pii(), and kept,
whatever their names, by redact().
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mullion.llm.common import written

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("spelled_email", "local_phone", "secret", "name")
KINDS = BASE_KINDS + ADDED_KINDS
LABELERS = ("format", "gazetteer", "context", "shape")
#: Characters on each side that the context labeler reads.
AROUND = 40
EM_ROUNDS, SMOOTHING = 60, 1.0
THRESHOLD = 0.5

LOCAL = "[A-Za-z0-9._%+-]"
#: Leftmost matches, as of the plain patterns: a run starts after another character or where the last match ended.
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "spelled_email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]| at ) ?[a-z0-9-]{1,63}+ ?(?:\(dot\)|\[dot\]| dot ) ?[a-z]{2,10}+(?![a-z])",
    "local_phone": r"(?<![0-9+(.-])(?<![0-9][\x20])(?:\([0-9]{3}\) ?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])(?![\x20.-][0-9])",
    "secret": r"(?i)(?<![a-z0-9_/+-])(?:[0-9a-f]{32,}+|(?:sk|pk|ghp|xox[bp]|akia)[_-]?[a-z0-9]{16,}+)(?![a-z0-9_/+-])",
    "name": "{names}",
}
#: What a text must hold for a kind to be looked for.
HINTS = {
    "email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][0-9 -]{10}", "phone": "+",
    "spelled_email": r"(?i)(?:\(at\)|\[at\]| at )[^\n]{0,70}(?:\(dot\)|\[dot\]| dot )", "local_phone": r"[0-9]{3}\)? ?[ .-]?[0-9]{3}[ .-][0-9]{4}",
    "secret": r"[0-9A-Za-z]{16}", "name": "{names}",
}
#: Gazetteers, with no claim to be complete.
GIVEN_NAMES = (
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Karen Nancy "
    "Daniel Lisa Anna Peter Paul Maria Laura Julia Hans Klaus Jean Pierre Sophie Carlos Ana Luis Carmen Charles Christopher Matthew Anthony Mark "
    "Donald Steven Andrew Kenneth George Joshua Kevin Brian Edward Ronald Timothy Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry "
    "Margaret Betty Sandra Ashley Kimberly Emily Donna Michelle Carol Amanda Dorothy Melissa Deborah Stephanie Rebecca Sharon Cynthia Kathleen Amy "
    "Jürgen Stefan Wolfgang Uwe Ursula Monika Petra Sabine Andreas Markus Jan Lukas Felix Lena Hannah Jacques Michel Philippe Nathalie Isabelle "
    "Camille Antoine Juan Javier Miguel Alejandro Pablo Elena Lucía Marta Pilar Isabel Giulia Marco Francesca Olga Ivan Dmitri Wei Yuki Ahmed Fatima"
).split()
FAMILY_NAMES = (
    "smith johnson williams brown jones garcia miller davis rodriguez martinez hernandez lopez gonzalez wilson anderson thomas taylor moore jackson "
    "martin lee perez thompson white harris sanchez clark ramirez lewis robinson walker young allen king wright scott torres nguyen hill flores green "
    "adams nelson baker hall rivera campbell mitchell carter roberts müller schmidt schneider fischer weber meyer wagner becker schulz hoffmann koch "
    "bauer richter klein wolf neumann schwarz zimmermann bernard dubois durand moreau laurent simon lefebvre leroy roux david bertrand morel fournier "
    "girard fernandez gomez diaz ruiz alvarez moreno munoz romero alonso gutierrez navarro rossi russo ferrari ivanov petrov kim chen wang"
).split()
#: Words that stand after a given name without being a family name.
NO_NAMES = "street avenue road university college hospital island river school church bridge said was and has the of in on at is january february march april june july august monday friday sunday".split()
COMMON_WORDS = "the a an is are was it this that these here there look looking arrived stay meet me you him her us them point".split()
#: By first letter, so that a word is held against a few names alone.
_GIVEN = "|".join(f"{a}(?:{'|'.join(n[1:] for n in own)})" for a, own in itertools.groupby(sorted(GIVEN_NAMES), key=lambda n: n[0]))
NAME_PATTERN = rf"(?=[A-Z])(?<![\p{{L}}])(?:{_GIVEN}) [A-Z][a-z]{{2,20}}+(?![\p{{L}}])"
TLDS = "com org net edu gov mil int info biz name pro io ai co me tv dev app cloud shop xyz online de fr es uk eu it nl be ch at pl cz se no dk fi ie pt gr ro hu ru ua tr us ca mx br ar cl au nz jp cn kr in sg hk za il".split()
CUES = {
    "email": "mail|contact|write to|@", "ip": "ip|server|host|address|login", "card": "card|visa|mastercard|amex|payment|credit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax", "spelled_email": "mail|contact|reach|write", "local_phone": "phone|tel|call|mobile|fax",
    "secret": "token|secret|key|password|passwd|pwd|bearer|auth", "name": "mr|mrs|ms|dr|prof|name|sincerely|regards|by",
}
AGAINST = "version|isbn|issn|doi|order|invoice|part no|serial|sha1|sha256|md5|commit|checksum|release"

SPAN = "struct<kind:string,start:int,stop:int,base:boolean,votes:array<int>>"


def pattern(kind: str) -> str:
    return PATTERNS[kind].replace("{names}", NAME_PATTERN)


#: Code points of a piece of a text, and spans that are put together at once.
PIECE, BLOCK = 8192, 256


def pieces(text: str) -> Column:
    """A text in pieces of PIECE code points, so that a part of it is found without counting from its start."""
    t = F.col(text)
    return F.when(F.length(t) <= PIECE, F.array(t)).otherwise(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))


def part(held: Column, start: Column, stop: Column) -> Column:
    """Code points start to stop of a text in pieces."""
    first = F.floor(start / PIECE).cast("int")
    near = F.array_join(F.slice(held, first + 1, F.floor((stop - 1) / PIECE).cast("int") - first + 1), "")
    return F.when(stop > start, F.substring(near, F.pmod(start, F.lit(PIECE)) + 1, stop - start)).otherwise(F.lit(""))


def blocks(items: Column) -> Column:
    """An array in runs of BLOCK, the last one shorter or empty."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(items) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))


def find_spans(text: str, regex: str, hint: str) -> Column:
    """array<struct<start, stop, said>> of a pattern's matches: texts between matches give the places.

    Places add up by blocks of matches, so that thousands of matches in a text don't cost the square of their number.
    """
    t = F.col(text)
    found = F.regexp_extract_all(t, F.lit(regex), F.lit(0))
    gaps = F.transform(F.split(t, regex, -1), lambda g: F.length(g))
    sized = F.arrays_zip(found.alias("said"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap"))
    parts = blocks(sized)
    empty = F.expr("cast(array() as array<struct<start:int,stop:int,said:string>>)")

    def place(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        stop = start + F.length(x["said"])
        return F.struct(stop.alias("at"), F.array_append(s["out"], F.struct(start.alias("start"), stop.alias("stop"), x["said"].alias("said"))).alias("out"))

    def width(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda s, x: s + x["gap"] + F.length(x["said"]))

    def block_places(s: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(s["at"].alias("at"), empty.alias("out")), place, lambda r: r["out"])
        return F.struct((s["at"] + width(part)).alias("at"), F.array_append(s["out"], inner).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<struct<start:int,stop:int,said:string>>>)").alias("out"))
    placed = F.flatten(F.aggregate(parts, start, block_places, lambda r: r["out"]))
    there = F.contains(t, F.lit(hint)) if hint in ("@", "+") else t.rlike(hint.replace("{names}", NAME_PATTERN))
    return F.when(there, placed).otherwise(empty)


def is_base(kind: str, said: Column) -> Column:
    """Whether a match of a base pattern passes its check."""
    digits = F.regexp_replace(said, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(said, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) < 4) & F.forall(F.split(said, r"\."), lambda p: F.coalesce(F.right(F.concat(F.lit("000"), p), F.lit(3)).try_cast("int"), F.lit(999)) <= 255)
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(False)


def _vote(yes: Column, no: Column | None = None) -> Column:
    vote = F.when(F.coalesce(yes, F.lit(False)), 1)
    return (vote.when(F.coalesce(no, F.lit(False)), -1) if no is not None else vote).otherwise(0)


def votes(kind: str, x: Column, held: Column) -> Column:
    """The labelers' votes on a candidate of a text in pieces, in the order of LABELERS."""
    said = x["said"]
    digits = F.regexp_replace(said, "[^0-9]", "")
    # slices end by themselves where the text does
    before, after = part(held, F.greatest(x["start"] - AROUND, F.lit(0)), x["start"]), part(held, x["stop"], x["stop"] + AROUND)
    around = F.lower(F.concat_ws(" ", before, after))
    tld = F.lower(F.regexp_extract(said, r"([A-Za-z]+)$", 1))
    if kind in BASE_KINDS:
        form = _vote(is_base(kind, said), ~is_base(kind, said))
    elif kind == "local_phone":
        form = _vote(said.rlike(r"^(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}([ .-]))[2-9][0-9]{2}[ .-][0-9]{4}$"), said.rlike(r"^\(?[01]"))
    elif kind == "secret":
        form = _vote(said.rlike("[0-9]") & said.rlike("(?i)[a-z]"), ~(said.rlike("[0-9]") & said.rlike("(?i)[a-z]")))
    elif kind == "spelled_email":
        common = rf"(?i)(?:^|[ (\[])(?:{'|'.join(COMMON_WORDS)})(?:$| ?[(\[]| )"
        form = _vote(said.rlike(r"(?i)^[a-z][a-z0-9._%+-]* ?\(?\[?at\]?\)? ?[a-z][a-z0-9-]+ ?\(?\[?dot\]?\)? ?[a-z]{2,6}$") & ~said.rlike(common), said.rlike(common))
    else:
        family = F.lower(F.regexp_extract(said, r"([A-Za-z]+)$", 1))
        form = _vote(~family.isin(*NO_NAMES) & ~after.rlike(r"^ (?:Street|Avenue|Road|University|College|Hospital|Inc|Ltd|GmbH|Day|River|Bay)\b"), family.isin(*NO_NAMES) | after.rlike(r"^ (?:Street|Avenue|Road|University|College|Hospital|Inc|Ltd|GmbH|Day|River|Bay)\b"))
    gazetteer = {
        "email": _vote(tld.isin(*TLDS), tld == ""), "spelled_email": _vote(tld.isin(*TLDS), ~tld.isin(*TLDS)),
        "ip": _vote(~said.rlike(r"^0*(?:0|127|255)\."), said.rlike(r"^0*0\.")), "card": _vote(digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), digits.rlike("^0")),
        "phone": _vote(digits.rlike("^(?:1|3[0-9]|4[0-9]|5[1-8]|6|7|8|9)"), digits.rlike("^0")), "local_phone": _vote(digits.rlike("^(?:555|[2-9]11)"), digits.rlike("^0")),
        "secret": _vote(said.rlike("(?i)^(?:sk|pk|ghp|xox|akia)"), said.rlike(r"^(.)\1+$")), "name": _vote(F.lower(F.regexp_extract(said, r"([A-Za-z]+)$", 1)).isin(*FAMILY_NAMES), F.lower(F.regexp_extract(said, r"([A-Za-z]+)$", 1)).isin(*NO_NAMES)),
    }[kind]
    context = _vote(around.rlike(rf"(?<![a-z])(?:{CUES[kind]})(?![a-z])") & ~around.rlike(rf"(?<![a-z])(?:{AGAINST})(?![a-z])"), around.rlike(rf"(?<![a-z])(?:{AGAINST})(?![a-z])"))
    shape = {
        "card": _vote(said.rlike(r"^[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$"), said.rlike(r"^(?:[0-9] )+")), "phone": _vote(said.rlike(r"[ ().-]"), F.length(digits) < 9),
        "ip": _vote(~said.rlike(r"(?:^|\.)0[0-9]"), said.rlike(r"(?:^|\.)0[0-9]")), "local_phone": _vote(said.rlike(r"^\(|^[0-9]{3}-[0-9]{3}-")),
        "secret": _vote(F.length(said).isin(32, 40, 64), F.size(F.array_distinct(F.split(F.lower(said), ""))) < 8), "name": _vote(said.rlike(r" [A-Z][a-z]+(?:son|man|er|ez|ski|berg|s)$")),
        "email": _vote(said.rlike("^[A-Za-z]"), said.rlike(r"\.\.|^\.")), "spelled_email": _vote(said.rlike(r"\((?:at|dot)\)|\[(?:at|dot)\]"), said.rlike("(?i) at .* dot ")),
    }[kind]
    return F.array(*[v.cast("int") for v in (form, gazetteer, context, shape)])


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found): per row the candidates of all kinds, with their votes."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    df = df.select("doc_id", "__text", pieces("__text").alias("__pieces"))
    return df.select("doc_id", found_in("__text", "__pieces").alias("found"))


def found_in(text: str, held: str) -> Column:
    def of(kind: str) -> Column:
        return F.transform(
            find_spans(text, pattern(kind), HINTS[kind]),
            lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), F.coalesce(is_base(kind, x["said"]), F.lit(False)).alias("base"), votes(kind, x, F.col(held)).alias("votes")),
        ).cast(f"array<{SPAN}>")

    return F.concat(*[of(k) for k in KINDS])


# -- reliabilities and classifier: over a table of vote patterns, len(KINDS) * 3**len(LABELERS) rows at most -------------


def vote_counts(found: DataFrame) -> list[tuple[str, tuple[int, ...], int]]:
    rows = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes").count().collect()
    return sorted((r["kind"], tuple(r["votes"]), r["count"]) for r in rows)


def estimate(counts: list[tuple[str, tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, dict[str, float]]:
    """(posterior by pattern, reliability[labeler, class, vote + 1], rate by kind) by expectation-maximisation."""
    votes_ = np.array([v for _, v, _ in counts], int).reshape(-1, len(LABELERS))
    n = np.array([c for *_, c in counts], float)
    kind = np.array([KINDS.index(k) for k, *_ in counts], int)
    post = 1 / (1 + np.exp(-1.5 * votes_.sum(1).astype(float)))
    for _ in range(EM_ROUNDS):
        weight = np.stack([n * (1 - post), n * post])  # class by pattern
        rate = np.array([(SMOOTHING + weight[1][kind == k].sum()) / (2 * SMOOTHING + n[kind == k].sum()) for k in range(len(KINDS))])
        rel = np.full((len(LABELERS), 2, 3), SMOOTHING)
        for j, z, v in itertools.product(range(len(LABELERS)), (0, 1), (-1, 0, 1)):
            rel[j, z, v + 1] += weight[z][votes_[:, j] == v].sum()
        rel /= rel.sum(2, keepdims=True)
        log = np.log(np.stack([1 - rate, rate]))[:, kind]
        for j in range(len(LABELERS)):
            log += np.log(rel[j][:, votes_[:, j] + 1])
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
    return post, rel, dict(zip(KINDS, rate.tolist(), strict=True))


def features(kind: str, votes_: tuple[int, ...]) -> list[float]:
    return [1.0, *(float(kind == k) for k in KINDS), *(float(v == s) for v in votes_ for s in (1, -1))]


def train(counts: list[tuple[str, tuple[int, ...], int]], ridge: float = 0.1, rounds: int = 40) -> list[float]:
    """Weights of a logistic classifier of spans, fitted to the posteriors by Newton steps."""
    width = len(features(KINDS[0], (0,) * len(LABELERS)))
    if not counts:
        return [0.0] * width
    post, _, _ = estimate(counts)
    x = np.array([features(k, v) for k, v, _ in counts])
    n = np.array([c for *_, c in counts], float)
    n *= len(n) / n.sum()
    w = np.zeros(width)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - post)) + ridge * w
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(width)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return [round(float(v), 9) for v in w]


def accepted(weights: list[float], c: Column, threshold: float = THRESHOLD) -> Column:
    """Whether the classifier takes a candidate: one sum of built-in expressions. What fails its format check stays out."""
    score = F.lit(weights[0])
    for k, w in zip(KINDS, weights[1:], strict=False):
        score += F.when(c["kind"] == k, w).otherwise(0.0)
    rest = weights[1 + len(KINDS) :]
    for j in range(len(LABELERS)):
        vote = F.get(c["votes"], F.lit(j))
        score += F.when(vote == 1, rest[2 * j]).when(vote == -1, rest[2 * j + 1]).otherwise(0.0)
    return (F.get(c["votes"], F.lit(0)) >= 0) & (score > math.log(threshold / (1 - threshold)))


# -- results ---------------------------------------------------------------------------------------------------------


def _ordered(found: Column) -> Column:
    """Spans by start, then kind as listed, then end."""
    order = F.transform(found, lambda c: F.struct(c["start"].alias("start"), F.array_position(F.array(*[F.lit(k) for k in KINDS]), c["kind"]).alias("rank"), c["stop"].alias("stop"), c["kind"].alias("kind")))
    return F.array_sort(order)


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: list[float] | None = None) -> DataFrame:
    """Per row: doc_id, base and spans: arrays of (start, rank, stop, kind), by start."""
    found = written(candidates(docs, id_col, text_col), "pii")
    weights = train(vote_counts(found)) if weights is None else weights
    base = F.filter("found", lambda c: c["base"])
    every = F.filter("found", lambda c: c["base"] | accepted(weights, c))
    return found.select("doc_id", _ordered(base).alias("base"), _ordered(every).alias("spans"))


def _reach(parts: Column) -> Column:
    """How far the spans of each block and of those ahead of it reach."""
    ends = F.transform(parts, lambda b: F.coalesce(F.array_max(F.transform(b, lambda x: x["stop"])), F.lit(0)))
    return F.aggregate(ends, F.expr("cast(array() as array<int>)"), lambda s, x: F.array_append(s, F.greatest(F.coalesce(F.get(s, F.size(s) - 1), F.lit(0)), x)))


def _joined(block: Column, upto: Column, held: Column) -> Column:
    """The text from `upto` to the end of a block's spans, each of them replaced; one that begins within others goes with them."""

    def step(s: Column, x: Column) -> Column:
        out = F.concat(s["out"], part(held, s["upto"], x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(x["stop"], s["upto"]).alias("upto"), F.when(x["start"] >= s["upto"], out).otherwise(s["out"]).alias("out"))

    return F.aggregate(block, F.struct(upto.alias("upto"), F.lit("").alias("out")), step, lambda s: s["out"])


def redact(docs: DataFrame, text_col: str = "text", weights: list[float] | None = None) -> DataFrame:
    """docs with each span replaced by its kind in brackets; overlapping spans go together under the first one's kind."""
    names = docs.columns
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__t"))
    df = df.select("__row", "__t", pieces("__t").alias("__pieces"))
    df = written(df.select("__row", found_in("__t", "__pieces").alias("found")), "pii")
    weights = train(vote_counts(df)) if weights is None else weights
    df = df.select("__row", F.coalesce(F.col(f"__row.`{text_col}`"), F.lit("")).alias("__t"), _ordered(F.filter("found", lambda c: c["base"] | accepted(weights, c))).alias("__spans"))
    # spans are taken in blocks, each put together by itself from where those ahead of it end: the work grows with the text
    found = F.size("__spans") > 0
    df = df.select("__row", F.length("__t").alias("__length"), F.when(found, pieces("__t")).alias("__pieces"), F.when(found, blocks(F.col("__spans"))).alias("__blocks"))
    df = df.select("__row", "__length", "__pieces", "__blocks", _reach(F.col("__blocks")).alias("__ends"))
    texts = F.transform("__blocks", lambda b, k: _joined(b, F.coalesce(F.get("__ends", k - 1), F.lit(0)), F.col("__pieces")))
    clean = F.concat(F.array_join(texts, ""), part(F.col("__pieces"), F.element_at("__ends", -1), F.col("__length")))
    df = df.select("__row", F.when(F.col("__blocks").isNotNull(), clean).otherwise(F.col(f"__row.`{text_col}`")).alias("__clean"))
    return df.select(*[F.col("__clean").alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in names])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return out.select("doc_id", *counts, F.sha2(_said(F.col("base")), 256).alias("base_sha256"), _said(F.col("spans")).alias("spans"))
