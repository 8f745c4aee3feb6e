"""A task as column expressions: what a row scores, which rows belong together, what counts as a failure. Every task gets the same tables from it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorefold.operators.inference import chi2_rx2, failure_counts
from scorefold.operators.resample import bootstrap, ratio


@dataclass(frozen=True)
class Task:
    """name; runs (columns that name one run); score (NULL: not scored); failed (an answer that cannot be scored); cluster (resampling unit); strata
    (columns whose strata are told apart). Expressions are over the task's log."""

    name: str
    runs: Sequence[str]
    score: Column
    failed: Column
    cluster: Column
    strata: Column = field(default_factory=lambda: F.lit("all"))

    def rows(self, log: DataFrame) -> DataFrame:
        """The log as (task, run, cluster, stratum, score, failed)."""
        run = F.concat_ws("/", *[F.col(c).cast("string") for c in self.runs])
        return log.select(F.lit(self.name).alias("task"), run.alias("run"), self.cluster.cast("string").alias("cluster"), self.strata.cast("string").alias("stratum"),
                          self.score.cast("double").alias("score"), self.failed.cast("int").alias("failed"))


KEYS = ("task", "run")


def together(tasks: Sequence[tuple[Task, DataFrame]]) -> DataFrame:
    """The rows of several tasks, so that one plan serves them all."""
    first, *rest = [t.rows(log) for t, log in tasks]
    for r in rest:
        first = first.unionByName(r)
    return first


def score_table(rows: DataFrame, strata: bool = False) -> DataFrame:
    """Rows, scored rows, failures and mean score per run (and stratum)."""
    return rows.groupBy(*KEYS, *(["stratum"] if strata else [])).agg(
        F.count(F.lit(1)).alias("n"), F.count("score").alias("scored"), F.sum("failed").alias("failures"), F.avg("score").alias("mean_score"))


def score_intervals(rows: DataFrame, reps: int, seed: int) -> DataFrame:
    """Cluster bootstrap interval of the mean score per run."""
    b = bootstrap(rows.where(F.col("score").isNotNull()), KEYS, "cluster", ratio(F.col("score")), reps, seed)
    return b.select(*KEYS, "point", "lo", "hi", "dropped")


def failure_independence(rows: DataFrame) -> DataFrame:
    """Whether failures depend on the stratum: chi-square per run."""
    return chi2_rx2(failure_counts(rows, KEYS, "stratum", F.col("failed") == 1), KEYS).select(*KEYS, "n", "stat", "dof", "p")
