"""Inputs derived from the given tables, in SQL that both Spark and DuckDB run."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession

_LF = "chr(10)"
_F = "'```'"
_MODES = "(VALUES (0, 'free'), (1, 'fsm'), (2, 'prompt_terse')) AS m(ix, mode)"


def _text(*parts: str) -> str:
    return " || ".join(parts)


def _case(name: str, templates: dict[int, str], other: str = "NULL") -> str:
    return f"CASE {name} " + " ".join(f"WHEN {k} THEN {v}" for k, v in templates.items()) + f" ELSE {other} END"


_RESPONSE = {
    0: _text("'<think>'", _LF, "text", _LF, "'</think>'", _LF, _LF, _F, "'python'", _LF, "'def f(x):'", _LF, "'    # note'", _LF, "'    return x'", _LF, _F),
    1: _text("text", "'</think>'", _LF, _F, "'py'", _LF, "'import os'", _LF, _F, _LF, _LF, _F, "'python'", _LF, "'def g():'", _LF, "'    pass'", _LF, _F),
    2: _text("'<think>a</think>b'", _F, _LF, "'x=1'", _F, "'</think>tail'"),
    3: _text("'<think>'", "text", "'</think>'", _LF, _F, "'python'", _LF, "'def h():'", _LF, "'    return 1'"),
    4: _text("'<think>p</think>Here is code: '", _F, "'python'", _LF, "'def k(x):'", _LF, "'    return x'"),
    5: _text("'<think>p</think>'", _LF, "'python'", _LF, "'from math import pi'", _LF),
    6: _text("'<think>p</think>'", _LF, "'python'", _LF, "'Some prose.'", _LF, "'def k(x):'", _LF, "'    return x'"),
    7: _text("'<think>p</think>'", _LF, "'import os'", _LF, "'# c1'", _LF, "'  # c2'", _LF, "'print(1)'", _LF),
    8: _text("'<think>p</think>'", _LF, "'Sure. Here:'", _LF, "'class Solution:'", _LF, "'    pass'", _LF),
    9: _text("'<think>p</think>'", _LF, "'def f[T](x: T):'", _LF, "'    return x'", _LF, "'Done.'"),
    10: "text",
    11: _text("text", _LF, _F, "'python'", _LF, "'x = 1'", _LF, _F),
    12: _text("'<think>q</think></think>'", _F, _LF, "'y=1'", _LF, _F),
    13: _text("text", _LF, "'import os'", _LF, "'print(1)'"),
}
RESPONSES = f"""
SELECT doc_id AS ordinal, 'P' || CAST(doc_id AS VARCHAR(20)) AS task_id, ix, mode, k, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id * 7 % 4000 END AS completion_tokens,
  {_case("k", _RESPONSE)} AS raw_response
FROM (SELECT doc_id, text, ix, mode, (doc_id + 5 * ix) % 15 AS k FROM documents CROSS JOIN {_MODES}) x
"""

_ERR = {1: "'empty_code'", 2: "'TIMEOUT'", 3: "'SyntaxError: invalid syntax'", 4: "'IndentationError: unexpected indent'", 5: "'RuntimeError: entry point f not found'", 6: "'ValueError: x'", 7: "'AssertionError: test 0'", 8: "'TypeError: bad'", 9: "'NameError: q'", 10: "'ZeroDivisionError: division by zero'", 0: "'gen_error: Connection refused'"}
RESULTS = f"""
SELECT ordinal, task_id, ix, mode, pass, CASE WHEN pass THEN '' ELSE {_case("e", _ERR, "''")} END AS err,
  pass OR e NOT IN (0, 1, 6) AS entry_point_found,
  CASE WHEN NOT pass AND e = 0 THEN 'generation_error' WHEN NOT pass AND e = 1 THEN 'empty_code' WHEN ordinal % 17 = 0 THEN 'prose_before_code' ELSE 'none' END AS extraction_issue,
  CASE WHEN NOT pass AND e = 0 THEN 'not_run' WHEN NOT pass AND e = 1 THEN 'empty' WHEN ordinal % 17 = 0 THEN 'code_start_after_think' ELSE 'last_fenced_after_think' END AS extraction_method,
  CASE WHEN gone THEN NULL ELSE think END AS think_tokens, CASE WHEN gone THEN NULL ELSE think + more END AS total_tokens,
  CASE WHEN gone THEN 0 ELSE more END AS post_think_tokens, CASE WHEN gone THEN 0 ELSE (ordinal * 7 + ix) % 2000 END AS code_comment_tokens
FROM (SELECT *, NOT pass AND e = 0 AS gone FROM (
  SELECT doc_id AS ordinal, 'P' || CAST(doc_id AS VARCHAR(20)) AS task_id, ix, mode,
    CAST(floor(doc_id / CASE ix WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END) AS BIGINT) % 2 = 1 AS pass, (CAST(floor(doc_id / 8) AS BIGINT) + ix) % 12 AS e,
    (doc_id * 37 + ix * 911) % 5000 AS think, (doc_id * 13 + ix * 7) % 4000 AS more
  FROM documents CROSS JOIN {_MODES}
  WHERE NOT (mode = 'prompt_terse' AND doc_id % 11 = 0) AND NOT (mode = 'fsm' AND doc_id % 13 = 0)) x) y
"""

# The ids that failed in the published run of 164 problems.
FAILED = {
    "free": (9, 26, 32, 76, 91, 93, 129, 132, 141, 145, 151, 154, 163),
    "fsm": (32, 76, 86, 91, 97, 124, 125, 132, 134, 145, 151, 163),
    "prompt_terse": (12, 32, 76, 86, 91, 95, 132, 141, 145, 151, 154),
}
_FAIL_TEST = " ".join(f"WHEN '{m}' THEN id NOT IN ({', '.join(map(str, ids))})" for m, ids in FAILED.items())
GOLDEN = f"""
SELECT id AS ordinal, 'HumanEval/' || CAST(id AS VARCHAR(20)) AS task_id, ix, mode, CASE mode {_FAIL_TEST} END AS pass
FROM (SELECT hundreds.x * 100 + tens.x * 10 + ones.x AS id FROM (VALUES (0), (1)) AS hundreds(x)
  CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) AS tens(x) CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) AS ones(x)) ids
CROSS JOIN {_MODES} WHERE id < 164
"""

_FUNC = '{"testtype":"functional","input":"1","output":"2"}'
_STDIN = '{"testtype":"stdin","input":"1","output":"2"}'
_CASES = {1: "''", 2: "'[]'", 3: f"'[{_FUNC}]'", 4: f"'[{_FUNC},{_FUNC}]'", 5: f"'[{_FUNC},{_STDIN}]'", 6: "'not json'"}
_METADATA = {1: """'{"func_name":"f"}'""", 2: """'{"func_name":"","fn_name":"g"}'""", 3: "'bad'", 4: "'{}'"}
_STARTER = {1: _text("'class Solution:'", _LF, "'    def h(self, x):'", _LF, "'        '"), 2: "''"}
PROBLEMS = f"""
SELECT doc_id AS ordinal, 'P' || CAST(CASE WHEN doc_id % 100 = 99 THEN doc_id - 1 ELSE doc_id END AS VARCHAR(20)) AS task_id,
  CASE doc_id % 4 WHEN 0 THEN 'leetcode' WHEN 1 THEN 'atcoder' WHEN 2 THEN 'codeforces' END AS platform,
  CASE WHEN doc_id % 9 = 0 THEN NULL ELSE CAST(DATE '2024-07-01' + CAST(doc_id % 400 AS INT) AS VARCHAR(20)) || 'T00:00:00' END AS contest_date,
  {_case("doc_id % 7", _CASES)} AS public_test_cases, {_case("doc_id % 5", _METADATA)} AS metadata, {_case("doc_id % 3", _STARTER)} AS starter_code, text AS question_content,
  CASE WHEN doc_id % 6 = 0 THEN NULL ELSE 'def f' || CAST(doc_id AS VARCHAR(20)) || '(x):' || chr(10) END AS prompt
FROM documents
"""

OUTCOMES = """
SELECT CASE l_returnflag WHEN 'A' THEN 'free' WHEN 'N' THEN 'fsm' WHEN 'R' THEN 'prompt_terse' END AS mode, l_linestatus = 'F' AS pass,
  CAST(l_quantity * l_linenumber AS BIGINT) AS think_tokens, CAST(l_quantity * 100 AS BIGINT) AS total_tokens,
  CAST(l_quantity AS BIGINT) AS post_think_tokens, CAST(l_linenumber AS BIGINT) AS code_comment_tokens
FROM lineitem
"""

MESSAGES = """
SELECT conv_id * 100 + turn AS ordinal, CASE WHEN turn % 4 = 3 THEN NULL ELSE text END AS content,
  CASE turn % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE '<think> <think>' || left(text, 40) || '</think>' END AS reasoning_content,
  CASE WHEN turn % 5 = 1 THEN ' other ' || left(text, 10) END AS reasoning
FROM conversations
"""

PLANS = f"""
SELECT doc_id AS ordinal, CASE doc_id % 6
  WHEN 0 THEN {_text("'<think>'", _LF, "'GOAL: sort '", "CAST(doc_id AS VARCHAR(20))", _LF, "'APPROACH: merge'", _LF, "'EDGE: empty'", _LF, "'</think>'", _LF, _LF, "'def f(x): return x'")}
  WHEN 1 THEN {_text("'<think>'", _LF, "'GOAL: g'", _LF, "'STATE: s '", "CAST(doc_id AS VARCHAR(20))", _LF, "'ALGO: a: b'", _LF, "'EDGE: e'", _LF, "'VERIFY: v'", _LF, "'</think>'", _LF, _LF, "'x = 1'", _LF)}
  WHEN 2 THEN {_text("'<think>'", _LF, "'GOAL: sort'", _LF, "'APPROACH: merge'", _LF, "'</think>'", _LF, _LF, "'def f(x): return x'")}
  WHEN 3 THEN {_text("'<think>'", _LF, "'GOAL: g'", _LF, "'APPROACH: a'", _LF, "'EDGE: e'", _LF, "'</think>'", _LF, _LF, "'x = é'")}
  WHEN 4 THEN {_text("'<think>'", _LF, "'GOAL: '", _LF, "'APPROACH: a'", _LF, "'EDGE: e'", _LF, "'</think>'", _LF, _LF, "'x'")}
  ELSE text END AS raw_response
FROM documents
"""

ALL = {"responses": RESPONSES, "results": RESULTS, "golden": GOLDEN, "problems": PROBLEMS, "outcomes": OUTCOMES, "messages": MESSAGES, "plans": PLANS}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the inputs, over the tables of a folder."""
    sql = ALL[name]
    for table in ("documents", "lineitem", "conversations"):
        if f"FROM {table}" in sql:
            view = f"{table}_{zlib.crc32(sf_dir.encode()):08x}"
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(view)
            sql = sql.replace(f"FROM {table}", f"FROM {view}")
    return spark.sql(sql)
