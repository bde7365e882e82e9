"""Equality of JSON values, whatever the order of keys, the white space and the escapes: expressions only.

A value's canonical form has its keys sorted, and each scalar as a string that begins with its kind: `s` text, `i` integer
(its digits, so any length), `f` other number (the double that it is, so 1.0 is 1.00 and 10e-1 but isn't 1). true, false
and null stay. NaN and the infinities are numbers, as Python writes them. Of a key that comes twice the last counts, where
the session allows that (`spark.sql.variant.allowDuplicateKeys`, see with_repeated_keys); elsewhere such a text is no JSON.

The kinds are put in before parsing: tokens are strings, numbers and what lies between; numbers become strings, so that
parsing keeps them as they were written. A number before a colon is left alone and makes the text invalid, as it was.
A text that is no JSON counts as a string of that text. Null stays null. A parser nests to 1,000 levels; deeper is no JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_STRING = r'"(?:[^"\\]|\\.)*+"'
_NUMBER = r"(?:-?(?:(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+|Infinity)|NaN)"
_TOKEN = rf'(?s){_STRING}|{_NUMBER}\s*+:|{_NUMBER}|[^"0-9NI-]++|.'

#: The parser doesn't look at what follows a value, so the text is put before a key that has to come out. A text that adds
#: keys of its own adds them between the two, as its strings begin with f, i or s; one that closes the object loses the key.
_HELD = r'(?s)^\{"e":1,"v":(.*)\}$'


def _marked(token: Column) -> Column:
    number = token.rlike(f"^{_NUMBER}$")
    integer = token.rlike("^-?[0-9]+$")
    digits = F.when(token == "-0", F.lit("0")).otherwise(token)
    return (
        F.when(token.startswith('"') & (F.length(token) > 1), F.concat(F.lit('"s'), F.substring(token, 2, 2**31 - 1)))
        .when(number & integer, F.concat(F.lit('"i'), digits, F.lit('"')))
        .when(number, F.concat(F.lit('"f'), token.try_cast("double").cast("string"), F.lit('"')))
        .otherwise(token)
    )


def _parsed(text: Column) -> Column:
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    held = F.concat(F.lit('{"v":'), F.array_join(F.transform(tokens, _marked), ""), F.lit(',"e":1}'))
    return F.nullif(F.regexp_extract(F.to_json(F.try_parse_json(held)), _HELD, 1), F.lit(""))


def is_json(text: Column) -> Column:
    return _parsed(text).isNotNull()


def canonical_json(text: Column) -> Column:
    """The canonical form of a JSON text, or of the text itself as a string where it is none."""
    return F.coalesce(_parsed(text), F.to_json(F.concat(F.lit("s"), text).cast("variant")))


def same_json(left: Column, right: Column) -> Column:
    """Whether two texts are the same value; null where one is null."""
    return canonical_json(left) == canonical_json(right)


def with_repeated_keys(spark: SparkSession) -> SparkSession:
    """A session of its own in which the last of repeated keys counts; the caller's stays as it is."""
    own = spark.newSession()
    own.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return own
