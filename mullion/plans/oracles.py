"""The queries in DuckDB's SQL, written on their own: no look-ahead, no Java classes, other functions."""

from __future__ import annotations

from mullion.sources import fixtures as fx

# Fixed values, written out once more: a wrong one of the library shows.
SYSTEM = (
    "You are an expert Python programmer.  Think carefully in your <think> block, then write correct, efficient, "
    "well-tested code.  Wrap your final code in a ```python ... ``` fenced block."
)
DIRECT_SYSTEM = (
    "You are an expert Python programmer. Think only inside the required <think> block. After </think>, output runnable "
    "Python code directly. Do not use Markdown fences. Do not write prose, scratch work, or comments after </think>, "
    "even if the task prompt mentions a fenced code block."
)
TERSE_SYSTEM = (
    "You are an expert Python programmer.  Think carefully but tersely.  Use exactly this thinking format before the final "
    "answer:\n<think>\nGOAL: one short line\nAPPROACH: one short line\nEDGE: one short line\n</think>\n\nThen write correct, "
    "efficient, well-tested code.  Wrap your final code in a ```python ... ``` fenced block."
)
FENCE_SHORT, FENCE_DOTS = "Return only runnable code in a ```python``` block.", "Return only runnable code in a ```python ... ``` fenced block."
DIRECT = "Return only runnable Python code directly, with no Markdown fences, comments, or explanatory prose."
FUNCTION_HEAD, FUNCTION_TAIL = "Complete the following Python function.  Return the full function including the signature and docstring.\n\n```python\n", "```\n"
TEXT_TAIL = "\n\nWrite the complete implementation in Python."
CONTEST_TAIL = "\n\nImplement the complete solution in Python.  If a class Solution signature is provided, use it.  Return only runnable code in a ```python``` block."
MODES = ("free", "fsm", "prompt_terse")


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_FAILURE = """CASE WHEN pass THEN 'pass' WHEN starts_with({err}, 'gen_error:') THEN 'generation_error' WHEN extraction_issue = 'empty_code' THEN 'extraction_empty_code'
  WHEN {err} = 'TIMEOUT' THEN 'timeout' WHEN regexp_matches({err}, 'SyntaxError|IndentationError') THEN 'syntax_error'
  WHEN contains({err}, 'entry point') AND contains({err}, 'not found') THEN 'missing_entry_point' WHEN entry_point_found = false THEN 'missing_entry_point'
  WHEN contains({err}, 'AssertionError') THEN 'wrong_answer' WHEN contains({err}, 'TypeError') THEN 'type_error' WHEN contains({err}, 'NameError') THEN 'runtime_name_error'
  WHEN {err} <> '' THEN 'runtime_error' ELSE 'unknown_failure' END"""
_RES = f"WITH r0 AS ({fx.RESULTS}), r AS (SELECT *, {_FAILURE.format(err='err')} AS failure_type, post_think_tokens >= 2048 AS answer_channel_bloat, code_comment_tokens >= 1024 AS comment_bloat FROM r0)"
_RESP = f"WITH q AS ({fx.RESPONSES})"
_PROB = f"WITH p AS ({fx.PROBLEMS})"
_W = "w AS (SELECT ordinal, task_id, bool_or(pass) FILTER (mode = 'free') AS f, bool_or(pass) FILTER (mode = 'fsm') AS s, bool_or(pass) FILTER (mode = 'prompt_terse') AS t FROM {src} GROUP BY ordinal, task_id)"
_LTRIM, _TRIM = r"regexp_replace({0}, '^[\s\x0b\x1c-\x1f]+', '')", r"regexp_replace(regexp_replace({0}, '^[\s\x0b\x1c-\x1f]+', ''), '[\s\x0b\x1c-\x1f]+$', '')"
_UNFENCE = _TRIM.format("regexp_replace(regexp_replace(" + _TRIM.format("{0}") + r", '(?i)^```(?:python|py)?[ \t\r]*\n?', ''), '```$', '')")
_START = r"(?m)(^(?:from\s+\S+\s+import\s+.+|import\s+.+|class\s+\w+\b.*|def\s+\w+\s*\(.*|@\w+.*)$(?s:.*))"
_FENCED = r"(?is)```(?:python|py)?[ \t\r]*\n?(.*?)```"
_UNTAG = r"regexp_replace(regexp_replace({0}, '^\s*(?:<think>\s*)*', ''), '(?:\s*</think>)*\s*$', '')"
#: Steps of the extraction: what each branch would find.
_CODE = f"""
c1 AS (SELECT *, string_split(raw_response, '</think>')[-1] AS after, len(string_split(raw_response, '</think>')) - 1 AS closes FROM q WHERE raw_response IS NOT NULL),
c2 AS (SELECT *, {_LTRIM.format('after')} AS clean, regexp_extract_all(after, '{_FENCED}', 1) AS fa, regexp_extract_all(raw_response, '{_FENCED}', 1) AS fr FROM c1),
c3 AS (SELECT *, {_LTRIM.format(r"regexp_replace(clean, '(?i)^\s*(?:python|py)\s*\n', '')")} AS lab, regexp_matches(clean, '(?i)^\\s*(?:python|py)\\s*\\n') AS has_label FROM c2),
c4 AS (SELECT *, regexp_extract(lab, '{_START}', 1) AS lab_code, regexp_extract(clean, '{_START}', 1) AS start_code, regexp_extract(clean, '(?ms)^(def\\s+\\w+.*?)(?:\\n\\S|\\z)', 1) AS def_code FROM c3),
c5 AS (SELECT *, CASE WHEN len(fa) > 0 THEN 'last_fenced_after_think' WHEN len(fr) > 0 THEN 'last_fenced_anywhere' WHEN starts_with(clean, '```') THEN 'opening_fence_after_think'
  WHEN contains(clean, '```') THEN 'opening_fence_anywhere' WHEN has_label AND lab_code <> '' THEN 'code_start_after_language_label' WHEN start_code <> '' THEN 'code_start_after_think'
  WHEN def_code <> '' THEN 'def_after_think' ELSE 'empty' END AS extraction_method FROM c4),
c6 AS (SELECT *, CASE extraction_method WHEN 'last_fenced_after_think' THEN fa[-1] WHEN 'last_fenced_anywhere' THEN fr[-1] WHEN 'opening_fence_after_think' THEN {_UNFENCE.format('clean')}
  WHEN 'opening_fence_anywhere' THEN {_UNFENCE.format(r"regexp_extract(clean, '(?is)```(?:python|py)?[ \t\r]*\n?(.*)', 1)")} WHEN 'code_start_after_language_label' THEN {_UNFENCE.format('lab_code')}
  WHEN 'code_start_after_think' THEN {_UNFENCE.format('start_code')} WHEN 'def_after_think' THEN def_code ELSE '' END AS code,
  CASE WHEN extraction_method = 'last_fenced_anywhere' THEN 'none' WHEN extraction_method = 'empty' THEN 'empty_code' WHEN closes > 1 THEN 'extra_think_tag_after_code'
  ELSE CASE extraction_method WHEN 'last_fenced_after_think' THEN 'none' WHEN 'opening_fence_after_think' THEN 'unterminated_fence' WHEN 'opening_fence_anywhere' THEN 'prose_before_unterminated_fence'
  WHEN 'code_start_after_language_label' THEN CASE WHEN trim(left(lab, length(lab) - length(lab_code)), chr(10) || ' ') = '' THEN 'language_label_before_code' ELSE 'language_label_then_prose_before_code' END
  WHEN 'code_start_after_think' THEN CASE WHEN trim(left(clean, length(clean) - length(start_code)), chr(10) || ' ') = '' THEN 'no_fenced_block' ELSE 'prose_before_code' END ELSE 'no_fenced_block' END END AS extraction_issue FROM c5)"""
_THINK = f"""CASE WHEN contains(raw_response, '</think>') AND regexp_matches(raw_response, '(?s)<think>.*?</think>') THEN {_UNTAG.format("regexp_extract(raw_response, '(?s)<think>(.*?)</think>', 1)")}
  WHEN contains(raw_response, '</think>') THEN {_UNTAG.format("string_split(raw_response, '</think>')[1]")}
  WHEN regexp_matches(raw_response, '{_FENCED}') THEN {_TRIM.format(r"regexp_extract(raw_response, '(?is)^(.*?)```(?:python|py)?[ \t\r]*\n?.*?```', 1)")}
  ELSE {_TRIM.format(f"left(raw_response, length(raw_response) - length(regexp_extract(raw_response, '{_START}', 1)))")} END"""
_ALL = f"{_RESP}, {_CODE}, m AS (SELECT ordinal, mode, code, extraction_method, extraction_issue, {_THINK} AS think, coalesce(completion_tokens, greatest(1, length(raw_response) // 4)) AS total FROM c6)"
_LINES = "list_filter(string_split(rtrim(code, chr(10)), chr(10)), lambda x: code <> '')"
_MEANS = ", ".join(f"sum(coalesce({c}, 0))::DOUBLE / count(*) AS {c}_mean" for c in ("think_tokens", "total_tokens", "post_think_tokens", "code_comment_tokens"))
_SUMMARY = "SELECT mode, count(*) AS n, avg(pass::INT) AS pass_rate, " + _MEANS + " FROM {0} WHERE pass IS NOT NULL GROUP BY mode"
_PAIR = "CASE WHEN f AND s THEN 'both_pass' WHEN f THEN 'free_only_pass' WHEN s THEN 'fsm_only_pass' ELSE 'both_fail' END"
_TRIPLE = """CASE f::INT * 4 + s::INT * 2 + t::INT WHEN 7 THEN 'all_pass' WHEN 0 THEN 'all_fail' WHEN 1 THEN 'prompt_terse_only_pass' WHEN 6 THEN 'prompt_terse_only_fail'
  WHEN 5 THEN 'prompt_terse_matches_free_not_fsm' WHEN 2 THEN 'prompt_terse_matches_free_not_fsm' ELSE 'prompt_terse_matches_fsm_not_free' END"""
_PAIRS = "(VALUES (0, 'both_pass'), (1, 'both_fail'), (2, 'fsm_only_pass'), (3, 'free_only_pass')) AS b(bucket_ix, bucket)"
_TRIPLES = "(VALUES ('all_pass'), ('all_fail'), ('prompt_terse_only_pass'), ('prompt_terse_only_fail'), ('prompt_terse_matches_free_not_fsm'), ('prompt_terse_matches_fsm_not_free')) AS b(bucket)"


def _overlap(check: str) -> str:
    case, there, names = (_PAIR, "f IS NOT NULL AND s IS NOT NULL", _PAIRS) if check == "free_vs_fsm" else (_TRIPLE, "f IS NOT NULL AND s IS NOT NULL AND t IS NOT NULL", _TRIPLES)
    return f"SELECT '{check}' AS \"check\", b.bucket, count(task_id) AS n, coalesce(string_agg(task_id, ',' ORDER BY ordinal), '') AS task_ids FROM {names} LEFT JOIN (SELECT *, {case} AS k FROM w WHERE {there}) x ON x.k = b.bucket GROUP BY b.bucket"


_NAME = "coalesce(" + ", ".join(f"nullif(CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.{k}') END, '')" for k in ("func_name", "function_name", "fn_name", "entry_point")) + r", nullif(regexp_extract(starter_code, 'def\s+(\w+)\s*\(', 1), ''), '')"
_ARRAY = "CASE WHEN json_valid(public_test_cases) AND starts_with(public_test_cases, '[') THEN json_array_length(public_test_cases) ELSE 0 END"
_FUNCTIONAL = f"{_ARRAY} > 0 AND len(list_filter(json_extract_string(CASE WHEN json_valid(public_test_cases) THEN public_test_cases END, '$[*].testtype'), lambda x: x = 'functional')) = {_ARRAY}"
_DATE = "coalesce(contest_date, '') >= '2025-01-01'"
_PLAT = "coalesce(platform, '') = 'leetcode'"
_STARTER = _TRIM.format("coalesce(starter_code, '')")
_USER = f"question_content || CASE WHEN {_STARTER} <> '' THEN chr(10) || chr(10) || 'Starter code:' || chr(10) || '```python' || chr(10) || {_STARTER} || chr(10) || '```' ELSE '' END || {_lit(CONTEST_TAIL)}"
_DIRECT = f"replace(replace({_USER}, {_lit(FENCE_SHORT)}, {_lit(DIRECT)}), {_lit(FENCE_DOTS)}, {_lit(DIRECT)})"
_TOKENS = r"regexp_extract_all({0}, '[\s\x0b\x1c-\x1f\x85\pZ]+|[A-Za-z_][A-Za-z_0-9]*|\p{{Nd}}+(?:\.\p{{Nd}}+)?|[^\s\x0b\x1c-\x1f\x85\pZA-Za-z_0-9]')"
_PANE = f"""{_RESP}, t0 AS (SELECT *, coalesce(nullif(raw_response, ''), 'gen_error: x') AS said FROM q),
t1 AS (SELECT *, {_TOKENS.format('said')} AS c FROM t0), t2 AS (SELECT *, coalesce(nullif(completion_tokens, 0), greatest(1, len(c))) AS total FROM t1),
pane AS (SELECT *, CASE WHEN ordinal % 2 = 0 THEN 12.5::DOUBLE ELSE total / 40.0::DOUBLE END AS seconds FROM t2)"""
_PLAN = r"^<think>\n{0}</think>\n\n[\x09\x0A\x0D\x20-\x7E]+$"
_P3, _P5 = (_PLAN.format("".join(rf"{f}: ([^\n]+)\n" for f in fs)) for fs in (("GOAL", "APPROACH", "EDGE"), ("GOAL", "STATE", "ALGO", "EDGE", "VERIFY")))
_MARK = "'{0}: `' || {1} || '`'"
_META = "concat_ws(' · ', " + ", ".join([
    f"CASE WHEN failure_type <> 'pass' THEN {_MARK.format('failure', 'failure_type')} END", f"CASE WHEN extraction_issue <> 'none' THEN {_MARK.format('extraction', 'extraction_issue')} END",
    _MARK.format("method", "extraction_method"), _MARK.format("post-think", "post_think_tokens::VARCHAR"), "CASE WHEN answer_channel_bloat THEN 'answer channel: `bloat`' END",
    _MARK.format("comment tokens", "code_comment_tokens::VARCHAR"), "CASE WHEN comment_bloat THEN 'comments: `bloat`' END", "CASE WHEN NOT entry_point_found THEN 'entry point: `not found`' END",
]) + ")"
_TAG = """CASE WHEN t AND NOT f AND NOT s THEN '🟡 PROMPT_TERSE-only pass' WHEN NOT t AND f AND s THEN '🟠 PROMPT_TERSE-only fail' ELSE
  CASE WHEN f AND s THEN '🟰 both pass' WHEN f AND NOT s THEN '🔻 FSM regression' WHEN NOT f AND s THEN '🔺 FSM wins' WHEN NOT f AND NOT s THEN '❌ both fail'
  WHEN f THEN 'free only: ✓' WHEN NOT f THEN 'free only: ✗' WHEN s THEN 'fsm only: ✓' WHEN NOT s THEN 'fsm only: ✗' WHEN t THEN 'prompt_terse only: ✓' WHEN NOT t THEN 'prompt_terse only: ✗' ELSE '—' END
  || CASE WHEN f IS NOT NULL AND s IS NOT NULL AND t IS NOT NULL THEN CASE WHEN t THEN '; prompt_terse=✓' ELSE '; prompt_terse=✗' END ELSE '' END END"""
_SECTION = f"'### ' || upper(mode) || '  ' || CASE WHEN pass THEN '✓ pass' ELSE '✗ fail' END || '  (think: ' || coalesce(think_tokens::VARCHAR, '-') || ' tok, total: ' || coalesce(total_tokens::VARCHAR, '-') || ' tok)' || chr(10) || chr(10) || '_meta:_ ' || {_META} || chr(10) || CASE WHEN err <> '' THEN chr(10) || '_error:_' || chr(10) || '```text' || chr(10) || err || chr(10) || '```' || chr(10) ELSE '' END"
_LATEST = "l AS (SELECT task_id, arg_max(coalesce(nullif(prompt, ''), question_content), ordinal) AS statement FROM p GROUP BY task_id)"
_SIDE = "SELECT task_id, arg_min(pass, ordinal) AS pass, arg_min(total_tokens, ordinal) AS total FROM r WHERE mode = '{0}' GROUP BY task_id"

ORACLES: dict[str, str] = {
    "q_scan_filter_date_platform": f"{_PROB} SELECT ordinal, task_id, platform, contest_date FROM p WHERE {_DATE} AND {_PLAT}",
    "q_functional_tests_only": f"{_PROB} SELECT ordinal, task_id, CAST({_ARRAY} AS BIGINT) AS n_tests FROM p WHERE {_DATE} AND {_PLAT} AND {_FUNCTIONAL}",
    "q_filter_funnel": f"{_PROB} SELECT * FROM (SELECT 0::BIGINT AS step, 'total' AS stage, count(*) AS n FROM p UNION ALL SELECT 1, 'after_date', count(*) FROM p WHERE {_DATE} UNION ALL SELECT 2, 'after_platform', count(*) FROM p WHERE {_DATE} AND {_PLAT} UNION ALL SELECT 3, 'after_functional', count(*) FROM p WHERE {_DATE} AND {_PLAT} AND {_FUNCTIONAL})",
    "q_head_n": f"{_PROB} SELECT ordinal, task_id FROM p WHERE {_DATE} AND {_PLAT} AND {_FUNCTIONAL} ORDER BY ordinal LIMIT 10",
    "q_fn_name": f"{_PROB} SELECT ordinal, {_NAME} AS fn_name FROM p",
    "q_test_counts": f"{_PROB} SELECT ordinal, CAST({_ARRAY} AS BIGINT) AS n_tests FROM p",
    "q_parse_test_args": f"{_PROB}, c AS (SELECT ordinal, unnest(range(0, CAST({_ARRAY} AS BIGINT))) AS case_ix, public_test_cases AS j FROM p) SELECT ordinal, CAST(case_ix AS BIGINT) AS case_ix, 1::BIGINT AS n_args, json_extract_string(j, '$[' || case_ix || '].input') AS args, json_extract_string(j, '$[' || case_ix || '].output') AS expected FROM c",
    "q_user_prompt": f"{_PROB} SELECT ordinal, 'humaneval' AS dataset, {_lit(FUNCTION_HEAD)} || coalesce(prompt, '') || {_lit(FUNCTION_TAIL)} AS prompt FROM p UNION ALL SELECT ordinal, 'mbpp', coalesce(prompt, '') || {_lit(TEXT_TAIL)} FROM p UNION ALL SELECT ordinal, 'livecodebench', {_USER} FROM p",
    "q_prompt_rewrite": f"{_PROB} SELECT ordinal, {_DIRECT} AS closed, {_USER} AS open FROM p",
    "q_system_prompt": f"{_PROB} SELECT ordinal, CASE WHEN ordinal % 2 = 0 THEN {_lit(DIRECT_SYSTEM)} ELSE {_lit(SYSTEM)} END AS prompt FROM p",
    "q_request_rows": f"{_PROB} SELECT ordinal, mode, CASE mode WHEN 'fsm' THEN {_lit(DIRECT_SYSTEM)} WHEN 'free' THEN {_lit(SYSTEM)} ELSE {_lit(TERSE_SYSTEM)} END AS system, md5(CASE mode WHEN 'fsm' THEN {_DIRECT} ELSE {_USER} END) AS user_md5, 8192::BIGINT AS max_tokens, 0.0::DOUBLE AS temperature, CASE WHEN mode = 'fsm' THEN 'code ::= [a-z]+' END AS grammar FROM p CROSS JOIN (VALUES ('free'), ('fsm'), ('prompt_terse')) AS m(mode)",
    "q_message_text": f"WITH m AS ({fx.MESSAGES}), n AS (SELECT *, coalesce(nullif(reasoning_content, ''), nullif(reasoning, '')) AS said FROM m) SELECT ordinal, CASE WHEN said IS NULL THEN coalesce(content, '') ELSE '<think>' || chr(10) || {_UNTAG.format('said')} || chr(10) || '</think>' || chr(10) || chr(10) || coalesce(content, '') END AS text FROM n",
    "q_strip_think_tags": f"{_RESP} SELECT ordinal, mode, md5({_UNTAG.format('raw_response')}) AS stripped, md5(string_split(raw_response, '</think>')[-1]) AS after, md5(string_split(raw_response, '</think>')[1]) AS before, CAST(len(string_split(raw_response, '</think>')) - 1 AS BIGINT) AS closes FROM q WHERE raw_response IS NOT NULL",
    "q_extract_think": f"{_RESP} SELECT ordinal, mode, {_THINK} AS think FROM q WHERE raw_response IS NOT NULL",
    "q_extract_code": f"{_RESP}, {_CODE} SELECT ordinal, mode, code, extraction_method, extraction_issue FROM c6",
    "q_extraction_methods": f"{_RESP}, {_CODE} SELECT mode, extraction_method, count(*) AS n FROM c6 GROUP BY ALL UNION ALL SELECT mode, 'not_run', count(*) FROM q WHERE raw_response IS NULL GROUP BY mode",
    "q_extraction_issues": f"{_RESP}, {_CODE} SELECT mode, extraction_issue, count(*) AS n FROM c6 WHERE extraction_issue <> 'none' GROUP BY ALL UNION ALL SELECT mode, 'generation_error', count(*) FROM q WHERE raw_response IS NULL GROUP BY mode",
    "q_token_counts": f"{_ALL} SELECT q.ordinal, q.mode, CAST(greatest(1, length(think) // 4) AS BIGINT) AS think_tokens, CAST(total AS BIGINT) AS total_tokens, CAST(coalesce(greatest(total - greatest(1, length(think) // 4), 0), 0) AS BIGINT) AS post_think_tokens FROM q LEFT JOIN m USING (ordinal, mode)".replace("CAST(greatest(1, length(think) // 4) AS BIGINT) AS think_tokens", "CASE WHEN think IS NOT NULL THEN CAST(greatest(1, length(think) // 4) AS BIGINT) END AS think_tokens").replace("CAST(coalesce(greatest(total", "CAST(coalesce(CASE WHEN think IS NOT NULL THEN greatest(total").replace("// 4), 0), 0) AS BIGINT) AS post", "// 4), 0) END, 0) AS BIGINT) AS post"),
    "q_comment_metrics": f"{_ALL}, n AS (SELECT *, {_LINES} AS ls FROM m), o AS (SELECT *, list_filter(list_transform(ls, lambda x: ltrim(x)), lambda x: starts_with(x, '#')) AS cs FROM n), e AS (SELECT *, array_to_string(list_filter(list_transform(cs, lambda x: trim(substr(x, 2))), lambda x: x <> ''), chr(10)) AS said FROM o) SELECT q.ordinal, q.mode, CAST(coalesce(len(ls), 0) AS BIGINT) AS code_lines, CAST(coalesce(len(cs), 0) AS BIGINT) AS code_comment_lines, CAST(CASE WHEN coalesce(said, '') = '' THEN 0 ELSE greatest(1, length(said) // 4) END AS BIGINT) AS code_comment_tokens FROM q LEFT JOIN e USING (ordinal, mode)",
    "q_bloat_flags": f"{_ALL} SELECT mode, CAST(count(*) FILTER (greatest(total - greatest(1, length(think) // 4), 0) >= 1024) AS BIGINT) AS answer_channel_bloat, CAST(count(*) FILTER (regexp_matches(code, '(?m)^\\s*#\\s*\\S')) AS BIGINT) AS comment_bloat FROM m GROUP BY mode",
    "q_entry_point_found": f"{_RESP}, {_CODE} SELECT ordinal, mode, trim(code, chr(10) || ' ') <> '' AND regexp_matches(code, '(?m)^\\s*def\\s+f\\s*\\(') AS plain, trim(code, chr(10) || ' ') <> '' AND (regexp_matches(code, '(?m)^\\s*class\\s+Solution\\b') OR regexp_matches(code, '(?m)^\\s*def\\s+h\\s*\\(')) AS contest FROM c6",
    "q_scoring_join": f"{_RESP}, {_CODE}, p AS ({fx.PROBLEMS}), o AS (SELECT task_id, max(ordinal) AS at FROM p GROUP BY task_id), n AS (SELECT p.task_id, CASE WHEN p.ordinal % 2 = 0 THEN 'livecodebench' ELSE 'humaneval' END AS dataset, CASE WHEN p.ordinal % 2 = 0 THEN {_NAME} ELSE 'f' END AS entry_point FROM p JOIN o ON o.task_id = p.task_id AND o.at = p.ordinal), e AS (SELECT q.ordinal, q.mode, dataset, entry_point, code FROM q LEFT JOIN n USING (task_id) LEFT JOIN c6 ON c6.ordinal = q.ordinal AND c6.mode = q.mode) SELECT ordinal, mode, dataset, entry_point, CASE WHEN dataset = 'livecodebench' THEN 'functional' WHEN dataset = 'humaneval' THEN 'check' END AS test_kind, coalesce(trim(code, chr(10) || ' ') <> '' AND CASE WHEN dataset = 'livecodebench' THEN entry_point <> '' AND (regexp_matches(code, '(?m)^\\s*class\\s+Solution\\b') OR regexp_matches(code, '(?m)^\\s*def\\s+' || entry_point || '\\s*\\(')) ELSE regexp_matches(code, '(?m)^\\s*def\\s+' || coalesce(entry_point, '') || '\\s*\\(') END, false) AS entry_point_found FROM e",
    "q_summary_json": f"{_RES}, s AS ({_SUMMARY.format('r')}) SELECT mode, to_json(struct_pack(n := n, pass_rate := pass_rate, think_tokens_mean := think_tokens_mean, total_tokens_mean := total_tokens_mean, post_think_tokens_mean := post_think_tokens_mean, code_comment_tokens_mean := code_comment_tokens_mean))::VARCHAR AS summary FROM s",
    "q_prelude": f"{_RESP}, {_CODE} SELECT ordinal, mode, CASE WHEN ordinal % 2 = 0 THEN 'from __future__ import annotations' || chr(10) ELSE '' END || 'from typing import *' || CASE WHEN code = '' AND ordinal % 2 = 1 THEN '' WHEN code = '' THEN chr(10) ELSE chr(10) || code END AS program FROM c6",
    "q_tokenize_chunks": f"{_RESP} SELECT ordinal, mode, CAST(len({_TOKENS.format('raw_response')}) AS BIGINT) AS n, array_to_string({_TOKENS.format('raw_response')}, '|') AS chunks, true AS lossless FROM q WHERE raw_response IS NOT NULL",
    "q_pane_payload": f"{_PANE} SELECT ordinal, mode, upper(mode) AS label, CAST(total AS BIGINT) AS total_tokens, seconds, CAST(len(c) AS BIGINT) AS n_chunks, false AS unsafe FROM pane",
    "q_tps": f"{_PANE} SELECT ordinal, max(total / greatest(seconds, 0.001)) AS tps, max(seconds) AS horizon FROM pane GROUP BY ordinal",
    "q_replay_prefix": f"{_PANE} SELECT ordinal, mode, '' AS at_0, array_to_string(c[: CAST(floor(0.375::DOUBLE * len(c)) AS BIGINT)], '') AS at_3, said AS at_9 FROM pane",
    "q_split_close": f"{_RESP} SELECT ordinal, mode, md5(CASE WHEN contains(raw_response, '</think>') THEN string_split(raw_response, '</think>')[1] || '</think>' ELSE raw_response END) AS think, md5(replace(replace(replace(CASE WHEN contains(raw_response, '</think>') THEN array_to_string(string_split(raw_response, '</think>')[2:], '</think>') ELSE '' END, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS rest FROM q WHERE raw_response IS NOT NULL",
    "q_plan_conforms": f"WITH x AS ({fx.PLANS}) SELECT ordinal, CASE WHEN regexp_matches(raw_response, '{_P3}') THEN 'plan_3' WHEN regexp_matches(raw_response, '{_P5}') THEN 'plan_5' ELSE 'none' END AS plan FROM x",
    "q_plan_fields": f"WITH x AS ({fx.PLANS}) SELECT ordinal, regexp_extract(raw_response, '{_P3}', 1) AS goal, regexp_extract(raw_response, '{_P3}', 2) AS approach, NULL::VARCHAR AS state, NULL::VARCHAR AS algo, regexp_extract(raw_response, '{_P3}', 3) AS edge, NULL::VARCHAR AS verify FROM x WHERE regexp_matches(raw_response, '{_P3}') UNION ALL SELECT ordinal, regexp_extract(raw_response, '{_P5}', 1), NULL, regexp_extract(raw_response, '{_P5}', 2), regexp_extract(raw_response, '{_P5}', 3), regexp_extract(raw_response, '{_P5}', 4), regexp_extract(raw_response, '{_P5}', 5) FROM x WHERE regexp_matches(raw_response, '{_P5}')",
    "q_classify_failure": f"{_RES}, c AS (SELECT *, left(right(repeat('x', 400) || err, 500), 200) AS cut FROM r) SELECT ordinal, mode, failure_type, {_FAILURE.format(err='cut')} AS as_cut FROM c",
    "q_failure_types": f"{_RES} SELECT mode, failure_type, count(*) AS n FROM r WHERE NOT pass GROUP BY ALL",
    "q_mode_summary": f"{_RES} {_SUMMARY.format('r')}",
    "q_mode_summary_big": f"WITH o AS ({fx.OUTCOMES}) {_SUMMARY.format('o')}",
    "q_accuracy_delta_compression": f"{_RES}, s AS ({_SUMMARY.format('r')}) SELECT (s.pass_rate - f.pass_rate) * 100 AS accuracy_delta_pp, f.think_tokens_mean / greatest(s.think_tokens_mean, 1) AS think_compression, f.total_tokens_mean / greatest(s.total_tokens_mean, 1) AS total_compression, f.think_tokens_mean / greatest(t.think_tokens_mean, 1) AS prompt_only_compression, t.think_tokens_mean / greatest(s.think_tokens_mean, 1) AS grammar_gain FROM s f, s, s t WHERE f.mode = 'free' AND s.mode = 'fsm' AND t.mode = 'prompt_terse'",
    "q_failure_accounting": f"{_RES} SELECT mode, count(*) AS n, CAST(count(*) FILTER (pass) AS BIGINT) AS passes, CAST(count(*) FILTER (NOT pass) AS BIGINT) AS failures, sum(post_think_tokens)::DOUBLE / count(*) AS post_think_tokens_mean, CAST(count(*) FILTER (answer_channel_bloat) AS BIGINT) AS answer_channel_bloat, sum(code_comment_tokens)::DOUBLE / count(*) AS code_comment_tokens_mean, CAST(count(*) FILTER (comment_bloat) AS BIGINT) AS comment_bloat FROM r GROUP BY mode",
    "q_overlap_pair": f"{_RES}, {_W.format(src='r')} {_overlap('free_vs_fsm')}",
    "q_overlap_triple": f"{_RES}, {_W.format(src='r')} {_overlap('prompt_terse_checks')}",
    "q_outcome_breakdown": f"{_RES}, {_W.format(src='r')} SELECT \"check\", bucket, n FROM ({_overlap('free_vs_fsm')}) UNION ALL SELECT \"check\", bucket, n FROM ({_overlap('prompt_terse_checks')})",
    "q_golden_overlap": f"WITH g AS ({fx.GOLDEN}), {_W.format(src='g')} SELECT * FROM ({_overlap('free_vs_fsm')}) UNION ALL SELECT * FROM ({_overlap('prompt_terse_checks')})",
    "q_pass_set_algebra": f"{_RES}, {_W.format(src='r')} SELECT {_PAIR} AS bucket, task_id FROM w WHERE f IS NOT NULL AND s IS NOT NULL",
    "q_outcome_tag": f"{_RES}, {_W.format(src='r')} SELECT ordinal, task_id, {_TAG} AS tag FROM w",
    "q_format_ids": f"{_RES}, {_W.format(src='r')}, k AS (SELECT {_PAIR} AS bucket, list(task_id ORDER BY ordinal) AS ids FROM w WHERE f IS NOT NULL AND s IS NOT NULL GROUP BY ALL) SELECT 'free_vs_fsm' AS \"check\", CAST(bucket_ix AS BIGINT) AS bucket_ix, rpad(b.bucket, 18, ' ') || ' ' || lpad(coalesce(len(ids), 0)::VARCHAR, greatest(3, length(coalesce(len(ids), 0)::VARCHAR))::INTEGER, ' ') || '  ' || CASE WHEN ids IS NULL THEN '-' ELSE array_to_string(ids[:16], ', ') || CASE WHEN len(ids) > 16 THEN ', ... (+' || (len(ids) - 16) || ')' ELSE '' END END AS line FROM {_PAIRS} LEFT JOIN k ON k.bucket = b.bucket",
    "q_format_counts": f"{_RES}, k AS (SELECT mode, failure_type, count(*) AS n FROM r WHERE NOT pass GROUP BY ALL) SELECT mode, string_agg(failure_type || '=' || n, ', ' ORDER BY failure_type) AS line FROM k GROUP BY mode",
    "q_modes_present": f"{_RES} SELECT DISTINCT CAST(ix AS BIGINT) AS ix, mode, upper(mode) AS label FROM r",
    "q_problem_lookup": f"{_RES}, p AS ({fx.PROBLEMS}), {_LATEST} SELECT ordinal, mode, md5(statement) AS statement FROM r LEFT JOIN l USING (task_id)",
    "q_report_markdown": f"{_RES} SELECT ordinal, mode, {_SECTION} AS markdown FROM r",
    "q_report_sections": f"""{_RES}, p AS ({fx.PROBLEMS}), {_LATEST}, {_W.format(src='r')},
c AS (SELECT ordinal, count(*) AS n, max(think_tokens) FILTER (mode = 'free') AS ft, max(think_tokens) FILTER (mode = 'fsm') AS st, string_agg({_SECTION}, chr(10) ORDER BY ix) AS parts FROM r GROUP BY ordinal),
h AS (SELECT w.ordinal, w.task_id, n, coalesce(ft > 0 AND st > 0, false) AS compared, '## ' || w.task_id || ' — ' || {_TAG} AS heading, ft, st, parts, {_TRIM.format('statement')} AS said, statement FROM w JOIN c USING (ordinal) LEFT JOIN l ON l.task_id = w.task_id)
SELECT ordinal, task_id, n AS sections, compared, heading, md5(heading || chr(10) || chr(10) ||
  CASE WHEN coalesce(statement, '') <> '' THEN '**Problem:**' || chr(10) || chr(10) || '```text' || chr(10) || CASE WHEN length(said) > 400 THEN regexp_replace(left(said, 400), '[\\s\\x0b\\x1c-\\x1f]+$', '') || ' …' ELSE said END || chr(10) || '```' || chr(10) || chr(10) ELSE '' END ||
  parts || chr(10) || CASE WHEN compared THEN '_think compression_: **' || printf('%.2f', ft / greatest(st, 1)) || '×** (' || ft || ' → ' || st || ' tokens)' || chr(10) || chr(10) ELSE '' END || '---' || chr(10)) AS markdown FROM h""",
    "q_summary_lines": f"""{_RES}, s AS ({_SUMMARY.format('r')}), m AS (SELECT CASE mode WHEN 'free' THEN 0 WHEN 'fsm' THEN 1 ELSE 2 END::BIGINT AS ix, * FROM s)
SELECT ix, rpad(upper(mode), 13, ' ') || printf(':  pass@1 = %5.1f%%   mean think = %6.0f tok   mean total = %6.0f tok   post-think = %6.0f tok   comments = %6.0f tok', pass_rate * 100, think_tokens_mean, total_tokens_mean, post_think_tokens_mean, code_comment_tokens_mean) AS line FROM m
UNION ALL SELECT 3, printf('Accuracy delta (FSM − FREE): %+5.1f pp', (b.pass_rate - a.pass_rate) * 100) FROM s a, s b WHERE a.mode = 'free' AND b.mode = 'fsm'
UNION ALL SELECT 4, printf('Think-token compression    : %5.2f×', a.think_tokens_mean / greatest(b.think_tokens_mean, 1)) FROM s a, s b WHERE a.mode = 'free' AND b.mode = 'fsm'""",
    "q_verdicts": f"""{_RESP}, {_CODE}, v0 AS (SELECT q.ordinal, q.mode, coalesce(extraction_issue, 'generation_error') AS extraction_issue, coalesce(trim(code, chr(10) || ' ') <> '' AND regexp_matches(code, '(?m)^\\s*def\\s+f\\s*\\('), false) AS entry_point_found FROM q LEFT JOIN c6 ON c6.ordinal = q.ordinal AND c6.mode = q.mode),
v AS (SELECT *, ordinal % 2 = 0 AND extraction_issue NOT IN ('generation_error', 'empty_code') AS pass, CASE WHEN extraction_issue = 'generation_error' THEN 'gen_error: AssertionError: test 0' WHEN extraction_issue = 'empty_code' THEN 'empty_code' WHEN ordinal % 2 = 0 THEN '' ELSE 'AssertionError: test 0' END AS err FROM v0)
SELECT ordinal, mode, pass, err, {_FAILURE.format(err='err')} AS failure_type FROM v""",
    "q_test_program": f"{_RESP}, {_CODE} SELECT ordinal, mode, md5(code || chr(10) || chr(10) || 'def check(g):' || chr(10) || '    assert g(1) == 1' || chr(10) || chr(10) || 'check(' || CASE WHEN ordinal % 2 = 0 THEN 'f' ELSE 'candidate' END || ')' || chr(10)) AS program FROM c6",
    "q_accounting_lines": f"""{_RES}, t AS (SELECT mode, string_agg(k || '=' || n, ', ' ORDER BY k) AS said FROM (SELECT mode, failure_type AS k, count(*) AS n FROM r WHERE NOT pass GROUP BY ALL) GROUP BY mode),
i AS (SELECT mode, string_agg(k || '=' || n, ', ' ORDER BY k) AS said FROM (SELECT mode, extraction_issue AS k, count(*) AS n FROM r WHERE extraction_issue <> 'none' GROUP BY ALL) GROUP BY mode),
a AS (SELECT mode, min(ix) AS ix, count(*) FILTER (NOT pass) AS f, sum(post_think_tokens)::DOUBLE / count(*) AS post, count(*) FILTER (answer_channel_bloat) AS ab, sum(code_comment_tokens)::DOUBLE / count(*) AS com, count(*) FILTER (comment_bloat) AS cb FROM r GROUP BY mode),
x AS (SELECT a.*, coalesce(t.said, '-') AS ts, coalesce(i.said, '-') AS is_ FROM a LEFT JOIN t ON t.mode = a.mode LEFT JOIN i ON i.mode = a.mode)
SELECT CAST(ix AS BIGINT) AS ix, CAST(part AS BIGINT) AS part, CASE part WHEN 0 THEN rpad(upper(mode), 13, ' ') || printf(' failures: %3d  ', f) || ts WHEN 1 THEN repeat(' ', 13) || ' extraction issues: ' || is_
  WHEN 2 THEN repeat(' ', 13) || printf(' post-think mean: %.0f  bloat: %d', post, ab) ELSE repeat(' ', 13) || printf(' comment mean: %.0f  bloat: %d', com, cb) END AS line FROM x, (VALUES (0), (1), (2), (3)) AS v(part)""",
    "q_modes_to_run": "SELECT asked, CAST(ix AS BIGINT) AS ix, mode FROM (VALUES ('both', 0, 'free'), ('both', 1, 'fsm'), ('all', 0, 'free'), ('all', 1, 'fsm'), ('all', 2, 'prompt_terse'), ('free', 0, 'free'), ('fsm', 0, 'fsm'), ('prompt_terse', 0, 'prompt_terse')) AS v(asked, ix, mode)",
    "q_status_lines": f"{_RES} SELECT ordinal, task_id, string_agg(mode || '=' || CASE WHEN pass THEN '✓' ELSE '✗' END || ' (' || coalesce(think_tokens::VARCHAR, '-') || 'tt)', '   ' ORDER BY ix) || coalesce('  |  ' || string_agg(mode || ': ' || left(err, 80), ' ; ' ORDER BY ix) FILTER (NOT pass AND err <> ''), '') AS line FROM r GROUP BY ordinal, task_id",
    "q_think_compression_per_task": f"{_RES}, k AS (SELECT ordinal, task_id, max(think_tokens) FILTER (mode = 'free') AS free_tokens, max(think_tokens) FILTER (mode = 'fsm') AS fsm_tokens FROM r GROUP BY ordinal, task_id) SELECT *, free_tokens / greatest(fsm_tokens, 1) AS ratio FROM k WHERE free_tokens > 0 AND fsm_tokens > 0",
    "q_results_lookup": f"{_RES} SELECT ordinal, mode, pass, failure_type, total_tokens FROM r WHERE task_id = 'P8' AND mode = 'fsm' ORDER BY ordinal LIMIT 1",
    "q_pair_runs": f"{_RES}, a AS ({_SIDE.format('free')}), b AS ({_SIDE.format('fsm')}) SELECT task_id, a.pass AS left_pass, a.total AS left_total_tokens, b.pass AS right_pass, b.total AS right_total_tokens FROM a JOIN b USING (task_id)",
    "q_results_wide": f"{_RES} SELECT ordinal, task_id, " + ", ".join(f"any_value({c}) FILTER (mode = '{m}') AS {m}_{c}" for m in MODES for c in ("pass", "think_tokens", "failure_type")) + " FROM r GROUP BY ordinal, task_id",
}
