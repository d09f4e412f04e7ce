"""Queries: batches, batch and judge texts, reports, content lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from snapgrade.functions.text import content_text, num_to_text, preview, question_text
from snapgrade.operators import retrieval, texts
from snapgrade.operators.answers import ask_missing
from snapgrade.operators.batches import assign_batches
from snapgrade.operators.diff import snapshot_diff
from snapgrade.plans.q_diff import CUSTOMER_DIFF_SQL
from snapgrade.plans.q_retrieval import _ENTITY_SQL, _own_label
from snapgrade.plans.registry import number_text, query, table
from snapgrade.plans.run import change_batches, label_texts
from snapgrade.plans.standins import CUSTOMER_FIELDS, ORDER_ENTITIES_SQL, clean_customers, order_entities
from snapgrade.session import scratch_path
from snapgrade.sources.sinks import read_or_empty


@query(
    "assign_batches",
    """SELECT o_orderkey, position, position // 50 AS batch FROM (
      SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders)""",
)
def batches(spark: SparkSession, sf: str) -> DataFrame:
    ordered = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return assign_batches(ordered, ["o_orderdate", "o_orderkey"], 50).select("o_orderkey", "position", "batch")


_LINE_SQL = """'name=' || planet_name || ', disc_year=' || discovery_year || ', method=' || discovery_method
  || ', mass_earth=' || coalesce(printf('%.2f', planet_mass), '?')
  || ', radius_earth=' || coalesce(printf('%.2f', planet_radius), '?') || ', period_days=' || printf('%.2f', orbital_period)
  || ', ecc=' || printf('%.3f', eccentricity) || ', temp_k=' || printf('%.0f', equilibrium_temp)
  || ', density=' || printf('%.2f', planet_density) || ', insol=?'"""


@query(
    "batch_text",
    f"""WITH {ORDER_ENTITIES_SQL}, lines AS (SELECT {_LINE_SQL} AS line,
        row_number() OVER (ORDER BY planet_name) - 1 AS position FROM given)
    SELECT position // 50 AS batch, count(*) AS entities,
      'HEAD' || chr(10) || string_agg(line, chr(10) ORDER BY position) || chr(10) || 'END' || chr(10) AS text
    FROM lines GROUP BY 1""",
)
def batch_text(spark: SparkSession, sf: str) -> DataFrame:
    columns = [column for _, column, _ in texts.LINE_FIELDS]
    placed = assign_batches(order_entities(spark, sf).select(*columns), ["planet_name"], 50)
    lines = placed.select("batch", "position", texts.entity_line().alias("line"))
    return texts.batch_text(lines, batch="batch", position="position", line="line", header="HEAD", footer="END")


@query(
    "answers_kept",
    f"""WITH {ORDER_ENTITIES_SQL}, lines AS (SELECT {_LINE_SQL} AS line,
        row_number() OVER (ORDER BY planet_name) - 1 AS position FROM given),
    sent AS (SELECT position // 50 AS batch, 'HEAD' || chr(10) || string_agg(line, chr(10) ORDER BY position) || chr(10)
        || 'END' || chr(10) AS text FROM lines GROUP BY 1)
    SELECT batch, CASE WHEN length(text) % 3 = 0 THEN 'second' ELSE 'first' END || ':' || sha256(text) AS answer,
      length(text) % 3 = 0 AS asked_again FROM sent""",
)
def answers_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Label batches asked twice: what got no answer at first is asked again, nothing else is."""
    sent = batch_text(spark, sf).select("batch", "text")
    store, asked = scratch_path(spark, "answers"), scratch_path(spark, "asked")
    answer = lambda name: F.concat(F.lit(f"{name}:"), F.sha2("text", 256))
    refused = F.length("text") % 3 == 0

    def second(open_batches: DataFrame) -> DataFrame:
        open_batches.select("batch").write.parquet(asked)
        return open_batches.select("batch", answer("second").alias("text"))

    ask_missing(sent, store, lambda s: s.select("batch", F.when(~refused, answer("first")).alias("text")), model="m")
    answers = ask_missing(sent, store, second, model="m").withColumnRenamed("text", "answer")
    again = read_or_empty(spark, asked, sent.select("batch").schema).withColumn("asked_again", F.lit(True))
    return answers.join(again, "batch", "left").select("batch", "answer", F.coalesce("asked_again", F.lit(False)).alias("asked_again"))


@query(
    "change_batch_text",
    f"""WITH {_ENTITY_SQL}, changes AS ({CUSTOMER_DIFF_SQL}),
    placed AS (SELECT c_name, row_number() OVER (ORDER BY change_type, c_name, field_name NULLS FIRST) - 1 AS seq FROM changes),
    context AS (SELECT entity, '  RESEARCH CONTEXT:' || chr(10) || string_agg(
        '  - vector ' || ref_id || ' (relevance: ' || printf('%.2f', round(s, 4)) || ')', chr(10) ORDER BY rank) AS block
      FROM found GROUP BY 1),
    lines AS (SELECT seq // 50 AS batch, seq, 'name=' || c.c_name || ', balance=' || printf('%.2f', c.c_acctbal)
        || coalesce(chr(10) || block, '') AS line
      FROM placed p JOIN customer c ON c.c_name = p.c_name LEFT JOIN context ON entity = c.c_nationkey)
    SELECT batch, count(*) AS entities, 'HEAD' || chr(10) || string_agg(line, chr(10) ORDER BY seq) || chr(10) || '--- END PLANETS ---' || chr(10) AS text
    FROM lines GROUP BY 1""",
)
def change_batch_text(spark: SparkSession, sf: str) -> DataFrame:
    """A run's changes in batches; each change row's stored entity, with context where there is
    some. Changes without a stored entity drop out, repeats stay."""
    stored = table(spark, sf, "customer")
    changes = snapshot_diff(stored, clean_customers(spark, sf), ["c_name"], CUSTOMER_FIELDS)
    placed = change_batches(changes, name="c_name")
    queries, refs = _own_label(spark, sf)
    contents = refs.select("ref_id", F.concat(F.lit("vector "), F.col("ref_id").cast("string")).alias("content"))
    found = retrieval.topk_same_entity(queries, refs).withColumn("similarity", F.round("similarity", 4))
    lists = retrieval.context_lists(found, contents, entity="entity")
    line = texts.entity_line((("name", "c_name", None), ("balance", "c_acctbal", 2)))
    context = stored.join(lists.withColumnRenamed("entity", "c_nationkey"), "c_nationkey").select("c_name", "context")
    return label_texts(placed, stored, name="c_name", line=line, context=context, header="HEAD")


@query(
    "judge_text",
    f"""WITH {ORDER_ENTITIES_SQL}, lines AS (SELECT 'name=' || planet_name || ', classification=' || given_label
        || ', plavalova_code=' || coalesce(given_code, '?') || ', mass_earth=' || coalesce(printf('%.2f', planet_mass), '?')
        || ', radius_earth=' || coalesce(printf('%.2f', planet_radius), '?') || ', period_days=' || printf('%.2f', orbital_period)
        || ', ecc=' || printf('%.3f', eccentricity) || ', temp_k=' || printf('%.0f', equilibrium_temp)
        || ', density=' || printf('%.2f', planet_density) || ', disc_year=' || discovery_year AS line,
        row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM given)
    SELECT position // 50 AS batch, count(*) AS entities,
      'HEAD' || chr(10) || string_agg(line, chr(10) ORDER BY position) || chr(10) || 'END' || chr(10) AS text
    FROM lines GROUP BY 1""",
)
def judge_text(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["o_orderkey", "planet_name", "classification", *[column for _, column, _ in texts.JUDGE_LINE_FIELDS]]
    placed = assign_batches(order_entities(spark, sf).select(*columns), ["o_orderkey"], 50)
    lines = placed.select("batch", "position", texts.judge_line("planet_name", "classification").alias("line"))
    return texts.batch_text(lines, batch="batch", position="position", line="line", header="HEAD", footer="END")


@query(
    "variant_texts",
    """WITH lines AS (SELECT 'name=' || c_name || ', balance=' || printf('%.2f', c_acctbal) AS line,
        row_number() OVER (ORDER BY c_name) - 1 AS position FROM customer),
    bodies AS (SELECT position // 50 AS batch,
      'LIST' || chr(10) || string_agg(line, chr(10) ORDER BY position) || chr(10) || 'END' || chr(10) AS body FROM lines GROUP BY 1)
    SELECT variant, batch, header || chr(10) || body AS text FROM bodies, (VALUES ('full', 'All rules.'), ('bare', 'No rules.')) v(variant, header)""",
)
def variant_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The same entities under every variant's header."""
    placed = assign_batches(table(spark, sf, "customer").select("c_name", "c_acctbal"), ["c_name"], 50)
    line = texts.entity_line((("name", "c_name", None), ("balance", "c_acctbal", 2)))
    lines = placed.select("batch", "position", line.alias("line"))
    bodies = texts.batch_text(lines, batch="batch", position="position", line="line", header="LIST", footer="END")
    return texts.variant_texts(bodies, batch="batch", headers={"full": "All rules.", "bare": "No rules."})


def _event_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Events as change rows of their day: sign-ups insert, errors delete, the rest update."""
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.dayofmonth("ts").alias("ingest_run_id"),
        F.when(kind == "signup", "INSERT").when(kind == "error", "DELETE").otherwise("UPDATE").alias("change_type"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("planet_name"),
        F.concat(kind, F.lit(" "), F.col("event_id").cast("string")).alias("field_name"),
        F.when(F.col("value") > 20, num_to_text(F.col("value"))).alias("old_value"),
        F.get_json_object("props", "$.k").alias("new_value"),
    )


_REPORT_SQL = f"""changes AS (SELECT CAST(day(ts) AS INTEGER) AS ingest_run_id,
    CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS change_type,
    'user ' || user_id AS planet_name, event_type || ' ' || event_id AS field_name,
    CASE WHEN value > 20 THEN {number_text('value')} END AS old_value, props ->> '$.k' AS new_value FROM events),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY ingest_run_id ORDER BY change_type, planet_name, field_name) AS rn,
    CASE change_type WHEN 'UPDATE' THEN 'UPDATE: ' || planet_name || ' — ' || field_name || ': [' || coalesce(old_value, 'null')
      || '] → [' || coalesce(new_value, 'null') || ']' ELSE change_type || ': ' || planet_name END AS line FROM changes),
  reports AS (SELECT ingest_run_id, count(*) FILTER (change_type = 'INSERT') AS inserts,
    count(*) FILTER (change_type = 'UPDATE') AS updates, count(*) FILTER (change_type = 'DELETE') AS deletes,
    'HEAD' || chr(10) || 'Summary: ' || count(*) FILTER (change_type = 'INSERT') || ' inserts, '
      || count(*) FILTER (change_type = 'UPDATE') || ' updates, ' || count(*) FILTER (change_type = 'DELETE') || ' deletes.'
      || chr(10) || chr(10) || '--- CHANGES (sample, max 50) ---' || chr(10)
      || string_agg(line, chr(10) ORDER BY rn) FILTER (rn <= 50)
      || CASE WHEN count(*) > 50 THEN chr(10) || '... and ' || (count(*) - 50) || ' more.' ELSE '' END
      || chr(10) || '--- END CHANGES ---' || chr(10) AS text
    FROM ranked GROUP BY 1)"""


@query("report_text", f"WITH {_REPORT_SQL} SELECT * FROM reports")
def report_text(spark: SparkSession, sf: str) -> DataFrame:
    return texts.report_text(_event_changes(spark, sf), run="ingest_run_id", entity="planet_name", header="HEAD")


@query(
    "report_record",
    f"""WITH {_REPORT_SQL} SELECT ingest_run_id, 'none' AS model_used, text AS prompt_sent,
      'rows: ' || (inserts + updates + deletes) AS report_text, CAST(length(text) AS INTEGER) AS tokens_used FROM reports""",
)
def report_record(spark: SparkSession, sf: str) -> DataFrame:
    """The audit row of each run's report; the received text is made from the counts."""
    sent = texts.report_text(_event_changes(spark, sf), run="ingest_run_id", entity="planet_name", header="HEAD")
    total = (F.col("inserts") + F.col("updates") + F.col("deletes")).cast("string")
    received = sent.select(
        "ingest_run_id", F.concat(F.lit("rows: "), total).alias("report_text"), F.length("text").alias("tokens_used")
    )
    return texts.report_record(sent, received, run="ingest_run_id", model="none")


@query(
    "content_text",
    """SELECT p_partkey, p_name || ', ' || p_brand || CASE WHEN p_type <> 'PROMO' THEN ', discovered via ' || p_type ELSE '' END
      || CASE WHEN p_size > 10 THEN ', mass=' || printf('%.2f', p_size / 4.0::DOUBLE) || ' Earth masses' ELSE '' END
      || ', temp=' || printf('%.0f', p_size * 3.0::DOUBLE) || ' K' || ', density=' || printf('%.2f', p_retailprice) || ' g/cm3' AS content
    FROM part""",
)
def content(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        "p_partkey",
        content_text(
            F.col("p_name"),
            F.col("p_brand"),
            F.when(F.col("p_type") != "PROMO", F.col("p_type")),
            [
                ("mass", F.when(size > 10, size / 4.0), 2, "Earth masses"),
                ("temp", size * 3.0, 0, "K"),
                ("density", F.col("p_retailprice"), 2, "g/cm3"),
            ],
        ).alias("content"),
    )


@query(
    "preview",
    """SELECT doc_id, CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '...' ELSE text END AS shown,
      length(text) AS characters FROM documents""",
)
def previews(spark: SparkSession, sf: str) -> DataFrame:
    """The display cut of a text, next to the length of the whole text."""
    return table(spark, sf, "documents").select(
        "doc_id", preview(F.col("text")).alias("shown"), F.length("text").cast("long").alias("characters")
    )


@query("question_text", "SELECT c_custkey, 'What is known about ' || c_name || '? Papers and findings.' AS question FROM customer")
def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        "c_custkey",
        question_text(F.col("c_name"), "What is known about {name}? Papers and findings.").alias("question"),
    )
