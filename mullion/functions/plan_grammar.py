"""Structured plans: whether a response conforms to a plan grammar, and its fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mullion.functions.patterns import PLAN_3, PLAN_5

ANSWER = r"[\x09\x0A\x0D\x20-\x7E]+"


def plan_pattern(fields: tuple[str, ...]) -> str:
    """The whole response: a think block with one line a field, a blank line, and an answer of printable ASCII."""
    return r"\A<think>\n" + "".join(rf"{f}: ([^\n]+)\n" for f in fields) + rf"</think>\n\n({ANSWER})\z"


def conforms(x: Column, fields: tuple[str, ...]) -> Column:
    return x.rlike(plan_pattern(fields))


def plan_kind(x: Column) -> Column:
    return F.when(conforms(x, PLAN_3), "plan_3").when(conforms(x, PLAN_5), "plan_5").otherwise("none")


def plan_fields(x: Column, fields: tuple[str, ...]) -> Column:
    """struct of the fields and the answer; null where the response doesn't conform."""
    found = [F.regexp_extract(x, plan_pattern(fields), i + 1).alias(f.lower()) for i, f in enumerate((*fields, "answer"))]
    return F.when(conforms(x, fields), F.struct(*found))
