"""Run averages, the window of recent runs, the drift verdict, variant comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from snapgrade.functions import rules
from snapgrade.functions.text import key_of_name

# Allowed drop in points, number of runs looked back on.
DRIFT_THRESHOLD = 10.0
ROLLING_RUNS = 5

NO_SCORE, FIRST_RUN, NO_PRIOR_SCORES, DRIFT, STABLE = (
    "no_score", "first_run", "no_prior_scores", "drift", "stable",
)


def run_averages(evals: DataFrame, run: str = "ingest_run_id") -> DataFrame:
    """Average score per run and kind. A run without scores has no row."""
    return (
        evals.filter(F.col("score").isNotNull())
        .groupBy(run, "eval_type")
        .agg(F.avg("score").alias("avg_score"))
    )


def last_completed(
    runs: DataFrame, run_id: int, count: int = ROLLING_RUNS, *, run: str = "ingest_run_id", prior_only: bool = False
) -> DataFrame:
    """The newest completed runs other than ``run_id``: later ones too, unless ``prior_only``."""
    others = runs.filter((F.col("status") == "COMPLETED") & (F.col(run) != run_id))
    if prior_only:
        others = others.filter(F.col(run) < run_id)
    return others.select(run).orderBy(F.col(run).desc()).limit(count)


def verdict(current: Column, recent: Column, scored: Column, rolling: Column, threshold: float) -> Column:
    return (
        F.when(current.isNull(), NO_SCORE)
        .when(recent == 0, FIRST_RUN)
        .when(scored == 0, NO_PRIOR_SCORES)
        .when(rolling - current > threshold, DRIFT)
        .otherwise(STABLE)
    )


def drift_check(
    evals: DataFrame,
    runs: DataFrame,
    run_id: int,
    *,
    eval_type: str = "PLAVALOVA",
    window: int = ROLLING_RUNS,
    threshold: float = DRIFT_THRESHOLD,
    run: str = "ingest_run_id",
    prior_only: bool = False,
) -> DataFrame:
    """One row: this run's average against the mean of the recent runs' averages.

    The limit on recent runs applies before runs without scores fall out. The recent run ids
    (``window`` numbers at most) are fetched from the ledger first, so that a score table
    partitioned by run is read in ``window + 1`` partitions only.
    """
    ids = [row[0] for row in last_completed(runs, run_id, window, run=run, prior_only=prior_only).collect()]
    scores = evals.filter((F.col("eval_type") == eval_type) & F.col(run).isin(run_id, *ids))
    average, now = F.col("avg_score"), F.col(run) == run_id
    summary = run_averages(scores, run).agg(
        F.max(F.when(now, average)).alias("current_avg"),
        F.lit(len(ids)).cast("long").alias("recent_runs"),
        F.count(F.when(~now, average)).alias("scored_runs"),
        F.avg(F.when(~now, average)).alias("rolling_avg"),
    )
    return summary.select(
        F.lit(run_id).cast("long").alias("run_id"),
        "current_avg",
        "recent_runs",
        "scored_runs",
        "rolling_avg",
        (F.col("rolling_avg") - F.col("current_avg")).alias("drop"),
        verdict(
            F.col("current_avg"), F.col("recent_runs"), F.col("scored_runs"), F.col("rolling_avg"), threshold
        ).alias("verdict"),
    )


def variant_scores(
    entities: DataFrame, answers: DataFrame, variants: DataFrame, *, name: str, expected: str, pass_mark: int = 75
) -> DataFrame:
    """Per variant the average score and passes over all entities; no answer counts as 0.

    ``answers(variant, name_key, code)`` holds one row per variant and name. Each answer is
    scored by an inner join on the name; entities without an answer add nothing to the sum, so
    they need only be counted, and no entity × variant product is built.
    """
    scored = (
        entities.select(key_of_name(F.col(name)).alias("name_key"), F.col(expected).alias("_want"))
        .join(answers.select("variant", "name_key", "code"), "name_key")
        .withColumn("_score", rules.component_score(F.col("_want"), F.col("code")))
        .groupBy("variant")
        .agg(
            F.sum("_score").alias("_points"),
            F.count_if(F.col("_score") >= pass_mark).alias("passed"),
            F.count(F.lit(1)).alias("answered"),
        )
    )
    total = entities.agg(F.count(F.lit(1)))
    return (
        variants.select("variant")
        .join(scored, "variant", "left")
        .withColumn("entities", total.scalar())
        .select(
            "variant",
            "entities",
            F.coalesce("answered", F.lit(0)).cast("long").alias("answered"),
            F.when(F.col("entities") > 0, F.coalesce("_points", F.lit(0)) / F.col("entities"))
            .otherwise(F.lit(0.0))
            .alias("avg_score"),
            F.coalesce("passed", F.lit(0)).cast("long").alias("passed"),
        )
    )
