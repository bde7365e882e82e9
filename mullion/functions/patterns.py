"""Regular expressions and literal texts of the response format, in the Java dialect.

Flags: d = only \\n ends a line, U = Unicode classes, s = dot matches \\n, m = ^ and $ at lines, i = ignore case.
"""

# Runs of white space are possessive and begin where none stands before, so each is tried once.
# Tags, fences and patterns of responses.
THINK_OPEN = "<think>"
THINK_CLOSE = "</think>"
FENCE_MARK = "```"

SPACE = r"[\s\x1c-\x1f]"
LEADING_SPACE = rf"(?U)\A{SPACE}+"
TRAILING_SPACE = rf"(?U)(?<!{SPACE}){SPACE}++\z"
LEADING_THINK_TAGS = rf"(?U)\A{SPACE}*+(?:<think>{SPACE}*+)*+"
TRAILING_THINK_TAGS = rf"(?U)(?<!{SPACE})(?<!</think>)(?:{SPACE}*+</think>)*+{SPACE}*+\z"
THINK_PAIR = r"(?s)<think>(.*?)</think>"
FENCED_CODE = r"(?isU)```(?:python|py)?[ \t\r]*\n?(.*?)```"
BEFORE_FENCED_CODE = r"(?is)\A(.*?)```(?:python|py)?[ \t\r]*\n?.*?```"
OPENING_FENCE = r"(?i)\A```(?:python|py)?[ \t\r]*\n?"
AFTER_OPENING_FENCE = r"(?is)```(?:python|py)?[ \t\r]*\n?(.*)\z"
LANGUAGE_LABEL = rf"(?iU)\A{SPACE}*(?:python|py){SPACE}*\n"
CODE_FROM_START = r"(?mdU)(^(?:from\s+\S+\s+import\s+.+|import\s+.+|class\s+\w+\b.*|def\s+\w+\s*\(.*|@\w+.*)$(?s:.*))"
DEF_BLOCK = r"(?msdU)^(def\s+\w+.*?)(?=\n\S|\z)"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
CHUNK = r"(?U)[\s\x1c-\x1f]+|[A-Za-z_][A-Za-z_0-9]*|\d+(?:\.\d+)?|[^\s\x1c-\x1fA-Za-z_0-9]"
STARTER_FUNCTION = r"(?U)def\s+(\w+)\s*\("
SOLUTION_CLASS = r"(?mU)^\s*class\s+Solution\b"

# The texts of prompts.
SYSTEM_PROMPT = (
    "You are an expert Python programmer.  Think carefully in your <think> block, then write correct, efficient, "
    "well-tested code.  Wrap your final code in a ```python ... ``` fenced block."
)
DIRECT_CODE_SYSTEM_PROMPT = (
    "You are an expert Python programmer. Think only inside the required <think> block. After </think>, output runnable "
    "Python code directly. Do not use Markdown fences. Do not write prose, scratch work, or comments after </think>, "
    "even if the task prompt mentions a fenced code block."
)
PROMPT_TERSE_SYSTEM_PROMPT = (
    "You are an expert Python programmer.  Think carefully but tersely.  Use exactly this thinking format before the final "
    "answer:\n<think>\nGOAL: one short line\nAPPROACH: one short line\nEDGE: one short line\n</think>\n\nThen write correct, "
    "efficient, well-tested code.  Wrap your final code in a ```python ... ``` fenced block."
)
FENCE_REQUESTS = ("Return only runnable code in a ```python``` block.", "Return only runnable code in a ```python ... ``` fenced block.")
DIRECT_REQUEST = "Return only runnable Python code directly, with no Markdown fences, comments, or explanatory prose."
FUNCTION_HEAD = "Complete the following Python function.  Return the full function including the signature and docstring.\n\n```python\n"
FUNCTION_TAIL = "```\n"
TEXT_TAIL = "\n\nWrite the complete implementation in Python."
CONTEST_TAIL = "\n\nImplement the complete solution in Python.  If a class Solution signature is provided, use it.  Return only runnable code in a ```python``` block."

# Modes and fields of plans.
#: (index, mode, label); the order of modes in every report.
MODES = ((0, "free", "FREE"), (1, "fsm", "FSM"), (2, "prompt_terse", "PROMPT_TERSE"))

PLAN_3 = ("GOAL", "APPROACH", "EDGE")
PLAN_5 = ("GOAL", "STATE", "ALGO", "EDGE", "VERIFY")
