"""Separating a response into reasoning and code, with how the code was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mullion.functions import patterns as p
from mullion.functions.text import after_last, before_first, last_match, lstrip, occurrences, strip, strip_think_tags, strip_unmatched_fence


def extract_think(x: Column) -> Column:
    """The reasoning: between the tags, before a lone close tag, before code, or all of the text."""
    closed = F.contains(x, F.lit(p.THINK_CLOSE))
    inside = F.regexp_extract(x, p.THINK_PAIR, 1)
    fenced = F.contains(x, F.lit(p.FENCE_MARK)) & x.rlike(p.FENCED_CODE)
    code = F.regexp_extract(x, p.CODE_FROM_START, 1)
    return (
        F.when(closed & x.rlike(p.THINK_PAIR), strip_think_tags(inside))
        .when(closed, strip_think_tags(before_first(x, p.THINK_CLOSE)))
        .when(fenced, strip(F.regexp_extract(x, p.BEFORE_FENCED_CODE, 1)))
        .otherwise(strip(F.left(x, F.length(x) - F.length(code))))
    )


def with_code(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """df with code, extraction_method and extraction_issue of a text column.

    The steps are projections over one another, so each pattern runs once a row, and only where a cheap test of a literal
    or an earlier step leaves the row to it.
    """
    t = F.col(text)
    given = df.columns
    df = df.withColumns({"__extract_after": after_last(t, p.THINK_CLOSE), "__extract_closes": occurrences(t, p.THINK_CLOSE)})
    df = df.withColumn("__extract_clean", lstrip(F.col("__extract_after")))
    has = lambda c: F.contains(F.col(c), F.lit(p.FENCE_MARK))
    df = df.withColumn("__extract_fenced", F.when(has("__extract_after"), last_match(F.col("__extract_after"), p.FENCED_CODE)))
    df = df.withColumn("__extract_anywhere", F.when(F.col("__extract_fenced").isNull() & has(text), last_match(t, p.FENCED_CODE)))
    open_ = F.col("__extract_fenced").isNull() & F.col("__extract_anywhere").isNull()
    df = df.withColumn("__extract_opened", F.when(open_ & has("__extract_clean"), F.struct(F.col("__extract_clean").rlike(p.OPENING_FENCE).alias("first"), F.regexp_extract("__extract_clean", p.AFTER_OPENING_FENCE, 1).alias("code"))))
    bare = open_ & F.col("__extract_opened").isNull()
    df = df.withColumn("__extract_label", F.when(bare & F.col("__extract_clean").rlike(p.LANGUAGE_LABEL), lstrip(F.regexp_replace("__extract_clean", p.LANGUAGE_LABEL, ""))))
    df = df.withColumn("__extract_label_code", F.when(F.col("__extract_label").isNotNull(), F.nullif(F.regexp_extract("__extract_label", p.CODE_FROM_START, 1), F.lit(""))))
    df = df.withColumn("__extract_start_code", F.when(bare & F.col("__extract_label_code").isNull(), F.nullif(F.regexp_extract("__extract_clean", p.CODE_FROM_START, 1), F.lit(""))))
    df = df.withColumn("__extract_def", F.when(bare & F.col("__extract_label_code").isNull() & F.col("__extract_start_code").isNull(), F.nullif(F.regexp_extract("__extract_clean", p.DEF_BLOCK, 1), F.lit(""))))

    def prose_before(whole: str, code: str) -> Column:
        return strip(F.left(F.col(whole), F.length(whole) - F.length(code))) != ""

    def row(method: str, issue: Column | str, code: Column, override: bool = True) -> Column:
        issue = F.lit(issue) if isinstance(issue, str) else issue
        issue = F.when(F.col("__extract_closes") > 1, "extra_think_tag_after_code").otherwise(issue) if override else issue
        return F.struct(code.alias("code"), F.lit(method).alias("method"), issue.alias("issue"))

    found = (
        F.when(F.col("__extract_fenced").isNotNull(), row("last_fenced_after_think", "none", F.col("__extract_fenced")))
        .when(F.col("__extract_anywhere").isNotNull(), row("last_fenced_anywhere", "none", F.col("__extract_anywhere"), False))
        .when(F.col("__extract_opened.first"), row("opening_fence_after_think", "unterminated_fence", strip_unmatched_fence(F.col("__extract_clean"))))
        .when(F.col("__extract_opened").isNotNull(), row("opening_fence_anywhere", "prose_before_unterminated_fence", strip_unmatched_fence(F.col("__extract_opened.code"))))
        .when(
            F.col("__extract_label_code").isNotNull(),
            row("code_start_after_language_label", F.when(prose_before("__extract_label", "__extract_label_code"), "language_label_then_prose_before_code").otherwise("language_label_before_code"), strip_unmatched_fence(F.col("__extract_label_code"))),
        )
        .when(
            F.col("__extract_start_code").isNotNull(),
            row("code_start_after_think", F.when(prose_before("__extract_clean", "__extract_start_code"), "prose_before_code").otherwise("no_fenced_block"), strip_unmatched_fence(F.col("__extract_start_code"))),
        )
        .when(F.col("__extract_def").isNotNull(), row("def_after_think", "no_fenced_block", F.col("__extract_def")))
        .otherwise(row("empty", "empty_code", F.lit(""), False))
    )
    df = df.withColumn("__extract_found", F.when(t.isNotNull(), found).otherwise(F.struct(F.lit(None).cast("string").alias("code"), F.lit("not_run").alias("method"), F.lit("generation_error").alias("issue"))))
    df = df.withColumns({f"{prefix}extracted_code": F.col("__extract_found.code"), "extraction_method": F.col("__extract_found.method"), "extraction_issue": F.col("__extract_found.issue")})
    return df.drop(*[c for c in df.columns if c.startswith("__extract_") and c not in given])
