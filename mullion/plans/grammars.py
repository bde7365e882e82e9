"""Queries over grammar files, with their SQL. The catalogue adds them."""

from __future__ import annotations

from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mullion.functions import grammar as g
from mullion.sources import fixtures as fx

FOLDER = Path(__file__).resolve().parent.parent / "grammars"
#: Lines of any number and name: what is repeated has parts, so the automaton decides.
OPEN_PLAN = r"""
root  ::= "<think>\n" entry* "</think>\n\n" rest
entry ::= key ": " value "\n"   # one line
key   ::= [A-Z]+
value ::= [^\n]*
rest  ::= ([^\né] | "\n")*
"""


@cache
def grammar(name: str) -> g.Grammar:
    return g.Grammar((FOLDER / f"{name}.gbnf").read_text(encoding="utf-8"))


def q_grammar_conforms(spark: SparkSession, d: str) -> DataFrame:
    """The first of the grammar files that a response conforms to."""
    x = F.col("raw_response")
    return fx.fixture(spark, d, "plans").select("ordinal", F.when(g.conforms(x, grammar("plan_3")), "plan_3").when(g.conforms(x, grammar("plan_5")), "plan_5").otherwise("none").alias("plan"))


def q_grammar_fields(spark: SparkSession, d: str) -> DataFrame:
    """The fields that the rules of either grammar file name, without the line's end."""
    rows = fx.fixture(spark, d, "plans").select("ordinal", *[g.fields(F.col("raw_response"), grammar(n)).alias(n) for n in ("plan_3", "plan_5")])
    there = {n: grammar(n).fields for n in ("plan_3", "plan_5")}
    of = lambda field: F.coalesce(*[F.col(f"{n}.{field}") for n, names in there.items() if field in names])
    line = lambda field: F.regexp_replace(of(field), r"\n\z", "").alias(field)
    return rows.where("plan_3 is not null or plan_5 is not null").select("ordinal", *[line(f) for f in ("goal", "approach", "state", "algo", "edge", "verify")], of("code").alias("code"))


def q_grammar_automaton(spark: SparkSession, d: str) -> DataFrame:
    """What the automata of both files and of a grammar with repeated lines accept."""
    x = F.col("raw_response")
    return fx.fixture(spark, d, "plans").select("ordinal", *[g.in_language(x, grammar(n)).alias(n) for n in ("plan_3", "plan_5")], g.conforms(x, g.Grammar(OPEN_PLAN)).alias("open"))


QUERIES = {f.__name__: f for f in (q_grammar_conforms, q_grammar_fields, q_grammar_automaton)}


def _re2(*names: str) -> str:
    return r"\A<think>\n" + "".join(rf"{n}: ([^\n]+)\n" for n in names) + r"</think>\n\n([\x09\x0A\x0D\x20-\x7E]+)\z"


_THREE, _FIVE = ("GOAL", "APPROACH", "EDGE"), ("GOAL", "STATE", "ALGO", "EDGE", "VERIFY")
_PLANS = f"WITH x AS ({fx.PLANS})"


def _fields(names: tuple[str, ...]) -> str:
    said = _re2(*names)
    of = {n.lower(): f"regexp_extract(raw_response, '{said}', {k + 1})" for k, n in enumerate((*names, "CODE"))}
    columns = ", ".join(f"{of.get(c, 'NULL::VARCHAR')} AS {c}" for c in ("goal", "approach", "state", "algo", "edge", "verify", "code"))
    return f"SELECT ordinal, {columns} FROM x WHERE regexp_matches(raw_response, '{said}')"


ORACLES = {
    "q_grammar_conforms": f"{_PLANS} SELECT ordinal, CASE WHEN regexp_matches(raw_response, '{_re2(*_THREE)}') THEN 'plan_3' WHEN regexp_matches(raw_response, '{_re2(*_FIVE)}') THEN 'plan_5' ELSE 'none' END AS plan FROM x",
    "q_grammar_fields": f"{_PLANS} {_fields(_THREE)} UNION ALL {_fields(_FIVE)}",
    "q_grammar_automaton": f"{_PLANS} SELECT ordinal, regexp_matches(raw_response, '{_re2(*_THREE)}') AS plan_3, regexp_matches(raw_response, '{_re2(*_FIVE)}') AS plan_5, "
    r"regexp_matches(raw_response, '\A<think>\n(?:[A-Z]+: [^\n]*\n)*</think>\n\n[^é]*\z') AS open FROM x",
}
