"""Prompts and request rows, and the programs that test code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mullion.functions import patterns as p
from mullion.functions.text import strip

DATASETS = ("humaneval", "mbpp", "livecodebench")


def user_prompt(dataset: str, prompt: Column, question: Column, starter: Column) -> Column:
    if dataset == "humaneval":
        return F.concat(F.lit(p.FUNCTION_HEAD), prompt, F.lit(p.FUNCTION_TAIL))
    if dataset == "mbpp":
        return F.concat(prompt, F.lit(p.TEXT_TAIL))
    if dataset == "livecodebench":
        own = strip(F.coalesce(starter, F.lit("")))
        block = F.when(own != "", F.concat(F.lit("\n\nStarter code:\n```python\n"), own, F.lit("\n```"))).otherwise("")
        return F.concat(question, block, F.lit(p.CONTEST_TAIL))
    raise ValueError(f"unknown dataset {dataset}")


def grammar_allows_fence(grammar: Column) -> Column:
    return F.contains(grammar, F.lit("```python")) | F.contains(grammar, F.lit(r"\x20-\x7E"))


def system_prompt(grammar: Column) -> Column:
    return F.when(grammar_allows_fence(grammar), p.SYSTEM_PROMPT).otherwise(p.DIRECT_CODE_SYSTEM_PROMPT)


def rewritten_prompt(prompt: Column, grammar: Column) -> Column:
    """The prompt without its wish for a fence, where the grammar can't write one."""
    direct = prompt
    for wish in p.FENCE_REQUESTS:
        direct = F.replace(direct, F.lit(wish), F.lit(p.DIRECT_REQUEST))
    return F.when(grammar_allows_fence(grammar), prompt).otherwise(direct)


def request(mode: Column, prompt: Column, grammar: Column, max_tokens: int) -> Column:
    """struct<messages, max_tokens, temperature, grammar>; the grammar goes along with the fsm mode alone."""
    fsm = mode == "fsm"
    system = F.when(fsm, system_prompt(grammar)).when(mode == "prompt_terse", p.PROMPT_TERSE_SYSTEM_PROMPT).otherwise(p.SYSTEM_PROMPT)
    user = F.when(fsm, rewritten_prompt(prompt, grammar)).otherwise(prompt)
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.struct(
        F.array(message("system", system), message("user", user)).alias("messages"),
        F.lit(max_tokens).cast("bigint").alias("max_tokens"),
        F.lit(0.0).alias("temperature"),
        F.when(fsm, grammar).alias("grammar"),
    )


def test_program(code: Column, test: Column, entry_point: Column) -> Column:
    return F.concat(code, F.lit("\n\n"), test, F.lit("\n\ncheck("), F.coalesce(F.nullif(entry_point, F.lit("")), F.lit("candidate")), F.lit(")\n"))
