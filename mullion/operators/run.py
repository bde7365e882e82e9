"""A run as an object: its parameters with their defaults and checks, and its steps over problems and responses."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass
from functools import partial

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from mullion.functions.patterns import MODES
from mullion.functions.prompts import request, user_prompt
from mullion.functions.text import BLOAT_THRESHOLD, COMMENT_BLOAT_THRESHOLD
from mullion.operators import evaluate as ev
from mullion.operators.scoring import mode_dimension, modes_to_run
from mullion.sources.problems import head, load_problems, read_grammar, require_rows, select_counted, select_problems
from mullion.sources.scratch import scratch_folder

DATASETS = ("humaneval", "mbpp", "livecodebench")
ONLY = ("both", "all", *(m for _, m, _ in MODES))


@dataclass(frozen=True)
class Run:
    """Parameters of a run. Defaults are fixed values; what can't be run is refused when the object is made, with its name."""

    dataset: str
    model: str = ""
    n_problems: int = 30
    version: str | None = None
    date_cutoff: str = ""
    platform: str = "leetcode"
    grammar_file: str | None = None
    max_tokens: int = 8192
    timeout: float = 30.0
    bloat_threshold: int = BLOAT_THRESHOLD
    comment_bloat_threshold: int = COMMENT_BLOAT_THRESHOLD
    only: str = "both"
    verdicts: str | None = None

    def __post_init__(self) -> None:
        if self.dataset not in DATASETS:
            raise ValueError(f"dataset has to be one of {', '.join(DATASETS)}, not {self.dataset!r}")
        if self.only not in ONLY:
            raise ValueError(f"only has to be one of {', '.join(ONLY)}, not {self.only!r}")
        for name, least in (("n_problems", 0), ("max_tokens", 1), ("timeout", 0.001), ("bloat_threshold", 0), ("comment_bloat_threshold", 0)):
            if getattr(self, name) < least:
                raise ValueError(f"{name} has to be at least {least}, not {getattr(self, name)}")

    @property
    def modes(self) -> list[str]:
        return modes_to_run(self.only)

    def problems(self, spark: SparkSession, path: str) -> DataFrame:
        """The problems to run, the first n_problems by ordinal (0: all); those of contests are filtered first. None is an error."""
        rows = load_problems(spark, self.dataset, path, self.version)
        if self.dataset == "livecodebench":
            rows = select_problems(rows, self.date_cutoff, self.platform)
        return require_rows(rows.orderBy("ordinal").limit(self.n_problems) if self.n_problems else rows)

    def problem_table(self, spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, int]]:
        """problems() as a table of their own, and how many rows each filter left, both from one pass over the source."""
        rows = load_problems(spark, self.dataset, path, self.version)
        if self.dataset == "livecodebench":
            rows, seen = select_counted(rows, self.date_cutoff, self.platform, self.n_problems)
        else:
            seen = Observation()
            rows = head(rows.observe(seen, F.count(F.lit(1)).alias("total")), self.n_problems)
        table = scratch_folder(spark, "problems")
        rows.write.parquet(table)
        return require_rows(spark.read.schema(rows.schema).parquet(table)), dict(seen.get)

    def requests(self, problems: DataFrame) -> DataFrame:
        """(ordinal, task_id, mode, request) for each problem and mode of the run."""
        grammar = read_grammar(self.grammar_file, self.modes)
        rows = problems.crossJoin(F.broadcast(mode_dimension(problems.sparkSession).where(F.col("mode").isin(self.modes))))  # three modes at most
        prompt = user_prompt(self.dataset, F.coalesce("prompt", F.lit("")), F.col("question_content"), F.col("starter_code"))
        return rows.select("ordinal", "task_id", "mode", request(F.col("mode"), prompt, F.lit(grammar or ""), self.max_tokens).alias("request"))

    def scored(self, responses: DataFrame, problems: DataFrame) -> DataFrame:
        """The responses in the run's modes, with all that doesn't need a test run."""
        mine = responses.where(F.col("mode").isin(self.modes))
        return ev.scored(mine, problems, bloat=self.bloat_threshold, comment_bloat=self.comment_bloat_threshold)

    def judged(self, rows: DataFrame, problems: DataFrame, judge=None) -> DataFrame:
        """Results of scored() rows; judge() as in evaluate.judged(), the default runs their programs."""
        return ev.judged(rows, problems, judge or partial(ev.run_programs, timeout=self.timeout, known=self.verdicts))

    def results(self, responses: DataFrame, problems: DataFrame, judge=None) -> DataFrame:
        """Results of the responses in the run's modes."""
        return self.judged(self.scored(responses, problems), problems, judge)

    def execute(self, spark: SparkSession, path: str, responses: DataFrame, folder: str, judge=None) -> dict:
        """Loads, evaluates and writes a run into a folder; its summary, with the seconds of each stage in order and the funnel of its problems.

        What a stage makes is written as a table and read by the next, so each runs once, and its seconds are its own.
        """
        seconds: dict[str, float] = {}
        began = last = time.perf_counter()

        def ended(stage: str) -> None:
            nonlocal last
            seconds[stage], last = round(time.perf_counter() - last, 3), time.perf_counter()

        problems, left = self.problem_table(spark, path)
        ended("load")
        rows = self.scored(responses, problems)
        ended("extract")
        table = scratch_folder(spark, "results")
        made = self.judged(rows, problems, judge)
        made.write.parquet(table)
        made = spark.read.schema(made.schema).parquet(table)
        ended("tests")
        ev.sinks.write_results(ev.aggregate.results_wide(made), f"{folder}/results.jsonl")
        ended("results")
        return ev.write_run(made, problems, folder, asdict(self), round(time.perf_counter() - began, 3), seconds, results_too=False, funnel=left)
