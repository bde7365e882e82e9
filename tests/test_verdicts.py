"""Remembered test runs and what a program may leave behind."""

import time

from pyspark.sql import functions as F

from mullion.operators import sandbox, verdicts

COLUMNS = "task_id string, mode string, program string, name string, cases string, contest boolean"


def told(df):
    return {(r.task_id, r["mode"]): (r["pass"], r.err) for r in df.collect()}


def test_equal_programs_run_once_and_known_ones_never(spark, tmp_path):
    log, at = tmp_path / "log", f"{tmp_path}/verdicts"
    says = "with open({0!r}, 'a') as f:\n    f.write({1!r})\n{2}\n"
    slow, quick, bad = (says.format(str(log), *x) for x in (("s", "import time\ntime.sleep(2)"), ("q", ""), ("b", "raise ValueError('é')")))
    rows = [("1", "free", quick), ("1", "fsm", quick), ("2", "free", slow), ("3", "free", bad), ("4", "free", None)]
    df = spark.createDataFrame([(*r, "", "", False) if r[2] else (r[0], r[1], "x = 1", "", None, True) for r in rows], COLUMNS)
    got = told(verdicts.run_known(df, at, timeout=20, quick=1.0))
    assert got[("1", "free")] == got[("1", "fsm")] == got[("2", "free")] == (True, "") and got[("4", "free")] == (False, "no_entry_point")
    assert got[("3", "free")][0] is False and "ValueError: é" in got[("3", "free")][1]
    assert sorted(log.read_text()) == ["b", "q", "s", "s"]  # the slow one once in each pass
    assert told(verdicts.run_known(df, at, timeout=20, quick=1.0)) == got and len(log.read_text()) == 4
    more = df.union(spark.createDataFrame([("5", "free", quick + "#", "", "", False)], COLUMNS))
    assert told(verdicts.run_known(more, at, timeout=20))[("5", "free")] == (True, "") and sorted(log.read_text()) == ["b", "q", "q", "s", "s"]
    assert told(verdicts.run_known(df.where("task_id = '1'"), at, timeout=19)) and len(log.read_text()) == 6  # another timeout is another question
    assert verdicts.run_known(df.where("false"), f"{tmp_path}/none").count() == 0


def test_what_lasts_too_long_is_remembered_as_such(spark, tmp_path):
    df = spark.createDataFrame([("1", "free", "while True: pass", "", "", False)], COLUMNS)
    for _ in range(2):
        began = time.perf_counter()
        assert told(verdicts.run_known(df, f"{tmp_path}/v", timeout=3, quick=0.5)) == {("1", "free"): (False, "TIMEOUT")}
    assert spark.read.parquet(f"{tmp_path}/v").count() == 1 and time.perf_counter() - began < 30


def test_two_runs_at_once_agree(spark, tmp_path):
    rows = [("d", False, "TIMEOUT", 1.0), ("d", True, "", 1.0), ("e", False, "a", 1.0), ("e", False, "b", 1.0)]
    spark.createDataFrame(rows, verdicts.VERDICTS).write.parquet(f"{tmp_path}/v")
    assert {tuple(r) for r in verdicts.known_verdicts(spark, f"{tmp_path}/v").collect()} == {("d", True, ""), ("e", False, "b")}


def test_children_end_with_their_program(tmp_path):
    child = "import os, time\nif os.fork() == 0:\n    time.sleep(3)\n    open({0!r}, 'w').close()\n    os._exit(0)\n"
    assert sandbox.run_program(child.format(f"{tmp_path}/a") + "time.sleep(60)", 1) == (False, "TIMEOUT")
    assert sandbox.run_program(child.format(f"{tmp_path}/b").replace("    time.sleep(3)", "    os.close(2)\n    time.sleep(3)"), 20) == (True, "")
    time.sleep(4)
    assert list(tmp_path.iterdir()) == []


def test_memory_and_stderr_are_bounded():
    passed, err = sandbox.run_program("x = bytearray(3 << 30)", 20, memory_mb=1024)
    assert not passed and "MemoryError" in err
    assert sandbox.run_program("x = bytearray(10)", 20, memory_mb=0) == (True, "")
    passed, err = sandbox.run_program("import sys\nfor _ in range(100_000): sys.stderr.write('é' * 100)\nsys.exit(1)", 20)
    assert not passed and err == "é" * 500
    assert sandbox.run_program("import os, time\nos.close(2)\ntime.sleep(60)", 1) == (False, "TIMEOUT")


def test_a_run_with_verdicts(spark, tmp_path):
    from mullion.operators import evaluate

    rows = spark.createDataFrame([("a", "free", "def f(x): return x + 1")], "task_id string, mode string, code string")
    rows = rows.withColumns({"test": F.lit("def check(g):\n    assert g(1) == 2"), "entry_point": F.lit("f"), "test_kind": F.lit("program"), "metadata": F.lit(None).cast("string"), "starter_code": F.lit(""), "public_test_cases": F.lit("")})
    assert told(evaluate.run_programs(rows, 20, f"{tmp_path}/v")) == told(evaluate.run_programs(rows, 20)) == {("a", "free"): (True, "")}
