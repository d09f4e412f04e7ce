"""Queries: run averages, drift, ledger, constraint checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from snapgrade.operators import checks, drift, ledger
from snapgrade.operators.batches import with_position
from snapgrade.plans.registry import query, table
from snapgrade.plans.standins import EVENT_DAYS_SQL, event_days, event_runs
from snapgrade.session import materialise
from snapgrade.sources.landed import changes_of_run


@query(
    "run_averages",
    f"WITH {EVENT_DAYS_SQL} SELECT ingest_run_id, eval_type, round(avg(score), 6) AS avg_score FROM days GROUP BY ALL",
)
def run_averages(spark: SparkSession, sf: str) -> DataFrame:
    return drift.run_averages(event_days(spark, sf)).withColumn("avg_score", F.round("avg_score", 6))


@query(
    "last_runs",
    f"""WITH {EVENT_DAYS_SQL} SELECT ingest_run_id FROM runs WHERE status = 'COMPLETED' AND ingest_run_id <> 28
    ORDER BY ingest_run_id DESC LIMIT 5""",
)
def last_runs(spark: SparkSession, sf: str) -> DataFrame:
    return drift.last_completed(event_runs(spark, sf), 28)


# Two unscored runs, a run with a drop, and a run that does not exist are among those looked at.
_LOOKED_AT = (3, 15, 28, 30, 99)


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores per day: those of two days are missing, those of one are a quarter."""
    run, score = F.col("ingest_run_id"), F.col("score")
    given = F.when(run == 30, F.floor(score / 4).cast("int")).when(~run.isin(27, 29), score)
    return event_days(spark, sf).withColumn("score", given)


def _drift_sql(prior_only: bool) -> str:
    parts = []
    for run in _LOOKED_AT:
        prior = f"AND ingest_run_id < {run}" if prior_only else ""
        parts.append(
            f"""SELECT CAST({run} AS BIGINT) AS run_id,
              (SELECT avg_score FROM a WHERE ingest_run_id = {run}) AS current_avg,
              count(*) AS recent_runs, count(avg_score) AS scored_runs, avg(avg_score) AS rolling_avg
            FROM (SELECT ingest_run_id FROM runs WHERE status = 'COMPLETED' AND ingest_run_id <> {run} {prior}
                  ORDER BY ingest_run_id DESC LIMIT 5) r LEFT JOIN a USING (ingest_run_id)"""
        )
    return f"""WITH {EVENT_DAYS_SQL}, a AS (
        SELECT ingest_run_id, avg(CASE WHEN ingest_run_id = 30 THEN score // 4
          WHEN ingest_run_id NOT IN (27, 29) THEN score END) AS avg_score FROM days WHERE eval_type = 'purchase' GROUP BY 1),
      s AS ({" UNION ALL ".join(parts)})
      SELECT run_id, round(current_avg, 6) AS current_avg, recent_runs, scored_runs, round(rolling_avg, 6) AS rolling_avg,
        round(rolling_avg - current_avg, 6) AS drop,
        CASE WHEN current_avg IS NULL THEN 'no_score' WHEN recent_runs = 0 THEN 'first_run'
          WHEN scored_runs = 0 THEN 'no_prior_scores' WHEN rolling_avg - current_avg > 10 THEN 'drift'
          ELSE 'stable' END AS verdict FROM s"""


def _drift(spark: SparkSession, sf: str, prior_only: bool) -> DataFrame:
    evals, runs = _scores(spark, sf), materialise(event_runs(spark, sf), "runs")
    rows = [
        drift.drift_check(evals, runs, run, eval_type="purchase", prior_only=prior_only) for run in _LOOKED_AT
    ]
    rounded = {c: F.round(c, 6) for c in ("current_avg", "rolling_avg", "drop")}
    return reduce(DataFrame.unionByName, rows).withColumns(rounded)


@query("drift_check", _drift_sql(prior_only=False))
def drift_check(spark: SparkSession, sf: str) -> DataFrame:
    return _drift(spark, sf, prior_only=False)


@query("drift_check_prior_only", _drift_sql(prior_only=True))
def drift_check_prior(spark: SparkSession, sf: str) -> DataFrame:
    return _drift(spark, sf, prior_only=True)


@query(
    "run_filter_sort",
    """SELECT event_type AS change_type, 'user ' || user_id AS planet_name, event_id,
      row_number() OVER (ORDER BY event_type, 'user ' || user_id, event_id) - 1 AS position FROM events WHERE day(ts) = 15""",
)
def run_filter_sort(spark: SparkSession, sf: str) -> DataFrame:
    """Change rows of one run by type and name; the position makes the order checkable."""
    changes = table(spark, sf, "events").select(
        F.dayofmonth("ts").alias("ingest_run_id"),
        F.col("event_type").alias("change_type"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("planet_name"),
        "event_id",
    )
    of_run = changes_of_run(changes, 15).select("change_type", "planet_name", "event_id")
    return with_position(of_run, ["change_type", "planet_name", "event_id"])


@query(
    "counts_by_type",
    """SELECT CAST(day(ts) AS INTEGER) AS ingest_run_id, count(*) FILTER (event_type = 'signup') AS inserts,
      count(*) FILTER (event_type IN ('click', 'view', 'purchase')) AS updates, count(*) FILTER (event_type = 'error') AS deletes
    FROM events GROUP BY 1""",
)
def counts_by_type(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("eval_type")
    return event_days(spark, sf).groupBy("ingest_run_id").agg(
        F.count_if(kind == "signup").alias("inserts"),
        F.count_if(kind.isin("click", "view", "purchase")).alias("updates"),
        F.count_if(kind == "error").alias("deletes"),
    )


@query(
    "ledger_latest",
    """SELECT user_id AS id, event_id, event_type AS status FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def ledger_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Events as state rows of their user: the newest state counts."""
    states = table(spark, sf, "events").select(
        F.col("user_id").alias("id"), "event_id", F.col("event_type").alias("status"), "ts"
    )
    return ledger.latest_states(states, "id", [F.col("ts").desc(), F.col("event_id").desc()]).drop("ts")


@query(
    "unique_check",
    """SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1""",
)
def unique_check(spark: SparkSession, sf: str) -> DataFrame:
    return checks.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "null_check",
    """SELECT 'not_null' AS "check", c AS "column", v AS violations FROM (
      SELECT unnest(['doc_id', 'quality', 'toxic']) AS c, unnest([count(*) FILTER (d.doc_id IS NULL),
        count(*) FILTER (quality IS NULL), count(*) FILTER (toxic IS NULL)]) AS v
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
)
def null_check(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return checks.null_counts(joined, ["doc_id", "quality", "toxic"])


@query(
    "length_check",
    """SELECT 'max_length' AS "check", c AS "column", v AS violations FROM (
      SELECT unnest(['url', 'html']) AS c,
        unnest([count(*) FILTER (length(url) > 40), count(*) FILTER (length(html) > 4000)]) AS v FROM pages)""",
)
def length_check(spark: SparkSession, sf: str) -> DataFrame:
    return checks.too_long(table(spark, sf, "pages"), {"url": 40, "html": 4000})


@query(
    "fk_check",
    """SELECT doc_id, count(*) AS rows FROM (
      SELECT l_partkey AS doc_id FROM lineitem) WHERE doc_id NOT IN (SELECT doc_id FROM documents) GROUP BY 1""",
)
def fk_check(spark: SparkSession, sf: str) -> DataFrame:
    """Line items' part numbers read as document numbers: those beyond the documents are orphans."""
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("doc_id"))
    return checks.orphans(lines, "doc_id", table(spark, sf, "documents"), "doc_id")


@query(
    "width_check",
    """SELECT CAST(min(len(embedding)) AS INTEGER) AS narrowest, CAST(max(len(embedding)) AS INTEGER) AS widest,
      min(len(embedding)) = max(len(embedding)) AS one_width FROM embeddings""",
)
def width_check(spark: SparkSession, sf: str) -> DataFrame:
    return checks.vector_widths(table(spark, sf, "embeddings"), "embedding")


@query(
    "domain_check",
    """SELECT event_type AS value, count(*) AS rows FROM events WHERE event_type NOT IN ('click', 'view', 'signup') GROUP BY 1""",
)
def domain_check(spark: SparkSession, sf: str) -> DataFrame:
    return checks.outside_domain(table(spark, sf, "events"), "event_type", ("click", "view", "signup"))
