"""Row-local text functions, as expressions of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mullion.functions import patterns as p

BLOAT_THRESHOLD, COMMENT_BLOAT_THRESHOLD = 2048, 1024


def lstrip(x: Column) -> Column:
    return F.regexp_replace(x, p.LEADING_SPACE, "")


def rstrip(x: Column) -> Column:
    return F.regexp_replace(x, p.TRAILING_SPACE, "")


def strip(x: Column) -> Column:
    """Without white space at both ends: Unicode's, and U+001C to U+001F."""
    return rstrip(lstrip(x))


def strip_think_tags(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, p.LEADING_THINK_TAGS, ""), p.TRAILING_THINK_TAGS, "")


def strip_unmatched_fence(code: Column) -> Column:
    """Code without an opening fence that nothing closes, and without a closing fence that nothing opened."""
    opened = strip(F.regexp_replace(strip(code), p.OPENING_FENCE, ""))
    return F.when(opened.endswith(p.FENCE_MARK), strip(F.left(opened, F.length(opened) - 3))).otherwise(opened)


def after_last(x: Column, mark: str) -> Column:
    return F.substring_index(x, mark, -1)


def before_first(x: Column, mark: str) -> Column:
    return F.substring_index(x, mark, 1)


def occurrences(x: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal text."""
    return F.floor((F.length(x) - F.length(F.replace(x, F.lit(literal), F.lit("")))) / len(literal)).cast("bigint")


def last_match(x: Column, pattern: str, group: int = 1) -> Column:
    """The last match's group; null where nothing matches."""
    return F.get(F.reverse(F.regexp_extract_all(x, F.lit(pattern), F.lit(group))), F.lit(0))


def count_tokens(x: Column) -> Column:
    """A quarter of the characters, 1 at least; null of null, which greatest() alone would pass over."""
    return F.when(x.isNotNull(), F.greatest(F.lit(1), F.floor(F.length(x) / 4))).cast("bigint")


def lines(x: Column) -> Column:
    """Lines at every Unicode line break, without an empty one after the last break; an empty text has none."""
    parts = F.split(x, p.LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def comment_metrics(code: Column) -> Column:
    """struct<code_lines, code_comment_lines, code_comment_tokens> of whole-line comments."""
    own = lines(code)
    comments = F.transform(F.filter(own, lambda x: F.substring(lstrip(x), 1, 1) == "#"), lambda x: strip(F.substr(lstrip(x), F.lit(2))))
    said = F.array_join(F.filter(comments, lambda x: x != ""), "\n")
    return F.struct(
        F.size(own).cast("bigint").alias("code_lines"),
        F.size(comments).cast("bigint").alias("code_comment_lines"),
        F.when(said == "", F.lit(0)).otherwise(count_tokens(said)).cast("bigint").alias("code_comment_tokens"),
    )


def post_think_tokens(total: Column, think: Column) -> Column:
    return F.when((total - think).isNotNull(), F.greatest(total - think, F.lit(0))).cast("bigint")


def bloated(tokens: Column, threshold: int) -> Column:
    return tokens >= threshold


def function_name(metadata: Column, starter: Column) -> Column:
    """The first non-empty name in the metadata, else the starter's first function, else ''."""
    named = [F.nullif(F.get_json_object(metadata, f"$.{k}"), F.lit("")) for k in ("func_name", "function_name", "fn_name", "entry_point")]
    return F.coalesce(*named, F.nullif(F.regexp_extract(F.coalesce(starter, F.lit("")), p.STARTER_FUNCTION, 1), F.lit("")), F.lit(""))


def test_count(cases: Column) -> Column:
    return F.coalesce(F.json_array_length(F.nullif(cases, F.lit(""))), F.lit(0)).cast("bigint")


def defines(code: Column, name: Column) -> Column:
    return F.rlike(code, F.concat(F.lit(r"(?mU)^\s*def\s+\Q"), name, F.lit(r"\E\s*\(")))


def entry_point_found(code: Column, name: Column, contest: bool) -> Column:
    """Whether code shows the function; of contest problems a Solution class will do, but there must be a name."""
    there = strip(code) != ""
    if contest:
        return there & (name != "") & (code.rlike(p.SOLUTION_CLASS) | defines(code, name))
    return there & defines(code, name)


def with_prelude(code: Column) -> Column:
    """Code with the typing import after its leading __future__ imports."""
    own = lines(code)
    head = F.coalesce(F.array_position(F.transform(own, lambda x: x.startswith("from __future__ import ")), False), F.lit(0)) - 1
    head = F.when(head < 0, F.size(own)).otherwise(head).cast("int")
    made = F.concat(F.slice(own, F.lit(1), head), F.array(F.lit("from typing import *")), F.slice(own, head + 1, F.size(own)))
    return F.concat(F.array_join(made, "\n"), F.when(code.endswith("\n"), "\n").otherwise(""))


def message_text(content: Column, *reasoning: Column) -> Column:
    """A message's content, after its separate reasoning between think tags where there is any."""
    said = F.coalesce(*[F.nullif(r, F.lit("")) for r in reasoning])
    body = F.coalesce(content, F.lit(""))
    return F.when(said.isNotNull(), F.concat(F.lit("<think>\n"), strip_think_tags(said), F.lit("\n</think>\n\n"), body)).otherwise(body)


def snippet(x: Column, limit: int = 400) -> Column:
    own = strip(x)
    return F.when(F.length(own) > limit, F.concat(rstrip(F.left(own, F.lit(limit))), F.lit(" …"))).otherwise(own)


def chunks(x: Column) -> Column:
    """Lossless pieces: white space, identifiers, numbers, single characters; an empty text is one empty piece."""
    found = F.regexp_extract_all(x, F.lit(p.CHUNK), F.lit(0))
    return F.when(F.size(found) == 0, F.array(x)).otherwise(found)


def replay_prefix(pieces: Column, seconds: Column, at: Column) -> Column:
    """What a replay of `seconds` shows at a moment."""
    part = F.least(F.greatest(at / F.greatest(seconds, F.lit(0.001)), F.lit(0.0)), F.lit(1.0))
    return F.array_join(F.slice(pieces, F.lit(1), F.floor(part * F.size(pieces)).cast("int")), "")


def tokens_per_second(total: Column, seconds: Column) -> Column:
    return total / F.greatest(seconds, F.lit(0.001))


def split_at_close(x: Column) -> Column:
    """struct<think, rest>: up to and with the first close tag; without one all is think."""
    head = before_first(x, p.THINK_CLOSE)
    closed = F.contains(x, F.lit(p.THINK_CLOSE))
    size = F.length(head) + len(p.THINK_CLOSE)
    return F.struct(F.when(closed, F.left(x, size)).otherwise(x).alias("think"), F.when(closed, F.substr(x, size + 1)).otherwise(F.lit("")).alias("rest"))


def escape_html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def escape_script(x: Column) -> Column:
    return F.replace(x, F.lit("</"), F.lit("<\\/"))


def cut_error(stderr: Column) -> Column:
    """What of an error's output the classifier sees: the first 200 of its last 500 characters."""
    return F.left(F.right(stderr, F.lit(500)), F.lit(200))


def padded(x: Column, width: int) -> Column:
    """x with spaces before it, up to a width; longer ones stay whole."""
    return F.lpad(x, F.greatest(F.length(x), F.lit(width)), F.lit(" "))


def fixed(x: Column, places: int, signed: bool = False) -> Column:
    """A double with so many decimals (0 to 2), rounded from its exact value, ties to even.

    x is split into halves of few bits, so that twice its scaled value less an odd number has the right sign.
    """
    scale = 10**places
    size = F.abs(x)
    wide = size * F.lit(134217729.0)
    high = wide - (wide - size)
    low = size - high
    whole = F.floor(size * scale)
    over = (high * (2 * scale) - (whole * 2 + 1)) + low * (2 * scale)
    units = whole + F.when((over > 0) | ((over == 0) & (whole % 2 == 1)), 1).otherwise(0)
    sign = F.when(x < 0, "-").otherwise("+" if signed else "")
    digits = F.floor(units / scale).cast("bigint").cast("string") if places else units.cast("string")
    return F.concat(sign, digits, F.lit("."), F.lpad((units % scale).cast("string"), places, "0")) if places else F.concat(sign, digits)


def ids_line(ids: Column, limit: int = 16) -> Column:
    shown = F.array_join(F.slice(ids, F.lit(1), F.lit(limit)), ", ")
    more = F.when(F.size(ids) > limit, F.concat(F.lit(", ... (+"), (F.size(ids) - limit).cast("string"), F.lit(")"))).otherwise("")
    return F.when(F.size(ids) == 0, "-").otherwise(F.concat(shown, more))


def counts_line(counts: Column) -> Column:
    """A map of counts as k=v, by key."""
    pairs = F.array_sort(F.map_entries(counts))
    return F.when(F.size(pairs) == 0, "-").otherwise(F.array_join(F.transform(pairs, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ", "))
