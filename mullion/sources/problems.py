"""Benchmark and result sources."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from mullion.functions.patterns import MODES
from mullion.sources.schemas import PROBLEMS, RESULT_ROWS, TEST_CASES


def load_problems(spark: SparkSession, dataset: str, path: str, version: str | None = None) -> DataFrame:
    """The problems of a data set; `version` is a partition folder (version=...), so the others aren't read."""
    if dataset not in ("humaneval", "mbpp", "livecodebench"):
        raise ValueError(f"unknown dataset {dataset}")
    reader = spark.read.schema(PROBLEMS)
    at = f"{path}/version={version}" if version else path
    try:
        rows = reader.json(at) if path.rstrip("/").endswith((".json", ".jsonl")) else reader.option("basePath", path).parquet(at)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        there = f"there are {', '.join(versions(spark, path)) or 'none'}" if version else "nothing is there"
        raise FileNotFoundError(f"cannot load {dataset}{f' version {version}' if version else ''} from {path}: {there}. Give a path, or a version, that exists; this library fetches nothing.") from e
    rows = rows.where(F.col("dataset").isNull() | (F.col("dataset") == dataset))
    return rows.withColumn("task_id", F.coalesce("task_id", "question_id", "question_title", F.lit("unknown"))) if dataset == "livecodebench" else rows


def versions(spark: SparkSession, path: str) -> list[str]:
    """The versions that a path has folders for."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(n.removeprefix("version=") for n in names if n.startswith("version="))


def since(cutoff: str) -> Column:
    """Dates are texts that compare as such; an empty cutoff keeps all, a missing date is the empty text."""
    return (F.col("contest_date") >= cutoff) if cutoff else F.lit(True)


def on_platform(name: str) -> Column:
    return (F.col("platform") == name) if name else F.lit(True)


def parsed_tests(cases: Column) -> Column:
    """The test cases, or null: bad JSON, and JSON that is no array (which from_json would wrap)."""
    return F.when(F.ltrim(cases).startswith("["), F.from_json(cases, TEST_CASES))


def functional_only(cases: Column) -> Column:
    tests = parsed_tests(cases)
    return (F.size(tests) > 0) & F.forall(tests, lambda t: t["testtype"].eqNullSafe("functional"))


def select_problems(problems: DataFrame, cutoff: str = "", platform: str = "leetcode", n: int = 0) -> DataFrame:
    """Cheap conditions first, each its own conjunct that reaches the scan; then the JSON; then the first n by ordinal."""
    out = problems.where(since(cutoff)).where(on_platform(platform)).where(functional_only(F.col("public_test_cases")))
    return head(out, n)


def head(problems: DataFrame, n: int) -> DataFrame:
    return problems.orderBy("ordinal").limit(n) if n > 0 else problems


def _left(cutoff: str, platform: str) -> list[Column]:
    """How many rows each filter of select_problems() leaves, as aggregates in order."""
    passed, out = F.lit(True), []
    for name, holds in (("total", F.lit(True)), ("after_date", since(cutoff)), ("after_platform", on_platform(platform)), ("after_functional", functional_only(F.col("public_test_cases")))):
        passed = passed & F.coalesce(holds, F.lit(False))
        out.append(F.count_if(passed).cast("bigint").alias(name))
    return out


def funnel(problems: DataFrame, cutoff: str = "", platform: str = "leetcode") -> DataFrame:
    """How many rows each filter leaves, counted in one pass."""
    counts = problems.agg(*_left(cutoff, platform))
    return counts.select(F.inline(F.array(*[F.struct(F.lit(i).cast("bigint").alias("step"), F.lit(n).alias("stage"), F.col(n).alias("n")) for i, n in enumerate(counts.columns)])))


def select_counted(problems: DataFrame, cutoff: str = "", platform: str = "leetcode", n: int = 0) -> tuple[DataFrame, Observation]:
    """select_problems() and the counts of funnel(), which the pass that reads the selection makes by the way.

    As every row is counted, no filter reaches the scan; where the counts aren't asked for, select_problems() reads less.
    The counts are there after the first action over the selection that reads all of it.
    """
    seen = Observation()
    return select_problems(problems.observe(seen, *_left(cutoff, platform)), cutoff, platform, n), seen


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("no problems to evaluate after filtering")
    return df


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a results file, one struct a mode; a missing mode is null. Blank lines are skipped."""
    return spark.read.schema(RESULT_ROWS).json(path)


def long_results(rows: DataFrame) -> DataFrame:
    """Rows of a results file as (ordinal, task_id, mode, ...), one for each mode that a row has.

    A row without an ordinal gets one by its place, which is the order of lines in a file.
    """
    order = {m: i for i, m, _ in MODES}
    rows = rows.withColumn("ordinal", F.coalesce("ordinal", F.monotonically_increasing_id()))
    each = F.array(*[F.struct(F.lit(i).alias("ix"), F.lit(m).alias("mode"), F.col(m).alias("of")) for m, i in order.items()])
    out = rows.select("ordinal", "task_id", F.explode(each).alias("r")).where("r.of is not null")
    return out.select("ordinal", "task_id", "r.ix", "r.mode", "r.of.*")


def read_grammar(path: str | None, modes: list[str]) -> str | None:
    """The grammar's text where a mode is to run that needs one; it is read only then, and has to be there."""
    if "fsm" not in modes:
        return None
    if not path:
        raise ValueError("mode fsm needs a grammar file")
    with open(path, encoding="utf-8") as f:
        return f.read()
