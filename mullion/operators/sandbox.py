"""Running candidate code against tests in child processes. Opt-in: the code isn't trusted, and a timeout is no jail."""

from __future__ import annotations

import json
import os
import selectors
import signal
import subprocess
import sys
import tempfile
import time
from collections.abc import Iterator
from contextlib import suppress
from typing import IO

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mullion.functions.prompts import test_program
from mullion.functions.text import function_name, with_prelude

TIMEOUT = 30
#: What a process of a program may hold; 0: no limit.
MEMORY_MB = 4096
#: Bytes of stderr that are kept, of which 500 characters are told.
KEPT = 65536
#: What calls the entry point: cases are (arguments, wanted result), compared by their JSON with sorted keys.
HARNESS = """
def _run_cases(name, cases, scope):
    from json import dumps

    def entry_point():
        owner = scope.get("Solution")
        found = getattr(owner(), name, None) if hasattr(owner, name) else scope.get(name)
        if found is None:
            raise RuntimeError(f"entry point {name} not found")
        return found

    def same(left, right):
        return dumps(left, sort_keys=True) == dumps(right, sort_keys=True)

    target = entry_point()
    for number, (arguments, wanted) in enumerate(cases):
        result = target(*arguments)
        if not same(result, wanted):
            raise AssertionError(f"test {number}: expected {wanted!r}, got {result!r}")
"""


def value(text: str) -> object:
    """A JSON value, or the text itself where it is none."""
    try:
        return json.loads(text)
    except ValueError:
        return text


def run_program(program: str, timeout: float, memory_mb: int = MEMORY_MB) -> tuple[bool, str]:
    """(passed, last 500 characters of stderr, or TIMEOUT). From a file, as long programs don't fit a command line.

    The program leads a process group of its own, and whatever it started in there ends with it, however it ends. Each of
    its processes may hold memory_mb (0: no limit). Of stderr only the end is kept, so a chatty program fills no worker.
    """
    handle, path = tempfile.mkstemp(suffix=".py")
    process = None
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(program)
        limit = str(memory_mb * 1024) if memory_mb else "unlimited"
        process = subprocess.Popen(["sh", "-c", 'ulimit -v "$1" && exec "$2" "$3"', "sh", limit, sys.executable, path], stdin=subprocess.DEVNULL, stdout=subprocess.DEVNULL, stderr=subprocess.PIPE, start_new_session=True)
        deadline = time.monotonic() + timeout
        end = last_bytes(process.stderr, deadline)
        process.wait(max(0.0, deadline - time.monotonic()))
        return (True, "") if process.returncode == 0 else (False, end.decode("utf-8", "ignore")[-500:])
    except (TimeoutError, subprocess.TimeoutExpired):
        return False, "TIMEOUT"
    except Exception as e:  # what goes wrong with one row is that row's error
        return False, f"{type(e).__name__}: {e}"[:200]
    finally:
        os.unlink(path)
        if process:
            with suppress(ProcessLookupError):
                os.killpg(process.pid, signal.SIGKILL)
            process.wait()
            process.stderr.close()


def last_bytes(pipe: IO[bytes], deadline: float) -> bytes:
    """The end of what comes through a pipe until it is closed."""
    end = b""
    with selectors.DefaultSelector() as ready:
        ready.register(pipe, selectors.EVENT_READ)
        while True:
            if not ready.select(max(0.0, deadline - time.monotonic())):
                raise TimeoutError
            got = os.read(pipe.fileno(), 65536)
            if not got:
                return end
            if time.monotonic() > deadline:
                raise TimeoutError
            end = (end + got)[-KEPT:]


def functional_program(code: str, name: str, cases: str | None) -> tuple[str | None, str]:
    """(program, error): code with the typing prelude, its cases and the harness."""
    if not name:
        return None, "no_entry_point"
    try:
        tests = json.loads(cases or "[]")
    except ValueError as e:
        return None, f"bad_tests: {e}"
    if not tests:
        return None, "no_tests"
    try:
        made = [([value(x) for x in t["input"].splitlines() if x.strip()], value(t["output"])) for t in tests]
    except (AttributeError, KeyError, TypeError) as e:
        return None, f"bad_tests: {type(e).__name__} {e}"
    return f"{code}\n{HARNESS}\nimport json as _json\n_run_cases({name!r}, _json.loads({json.dumps(made)!r}), globals())\n", ""


def test_rows(df: DataFrame, contest: bool = False) -> DataFrame:
    """(task_id, mode, program, name, cases, contest) of rows (task_id, mode, code, and test, entry_point or metadata, starter_code, public_test_cases)."""
    if contest:
        made = [with_prelude(F.col("code")).alias("program"), function_name(F.col("metadata"), F.col("starter_code")).alias("name"), F.col("public_test_cases").alias("cases")]
    else:
        made = [test_program(F.col("code"), F.coalesce("test", F.lit("")), F.col("entry_point")).alias("program"), F.lit("").alias("name"), F.lit("").alias("cases")]
    return df.select("task_id", "mode", *made, F.lit(contest).alias("contest"))


def verdict(program: str, name: str, cases: str | None, contest: bool, timeout: float, memory_mb: int = MEMORY_MB) -> tuple[bool, str]:
    made, err = functional_program(program, name, cases) if contest else (program, "")
    return run_program(made, timeout, memory_mb) if made is not None else (False, err)


def run_tests(df: DataFrame, timeout: float = TIMEOUT, contest: bool = False, memory_mb: int = MEMORY_MB) -> DataFrame:
    """df, as test_rows() takes it, with pass and err.

    Rows whose code wasn't found should be left out before: a filter, not a test in here.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [verdict(*row, timeout, memory_mb) for row in zip(b["program"], b["name"], b["cases"], b["contest"], strict=True)]
            yield pd.DataFrame({"task_id": b["task_id"], "mode": b["mode"], "pass": [x for x, _ in done], "err": [e for _, e in done]})

    return test_rows(df, contest).mapInPandas(run, "task_id string, mode string, pass boolean, err string")
