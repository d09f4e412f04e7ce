"""Queries: landed files, sinks, streams, whole runs. Files are written to the shared folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from snapgrade.functions import rules
from snapgrade.functions.text import json_field, num_to_text
from snapgrade.functions.vectors import text_to_vector, vector_to_text
from snapgrade.operators import texts
from snapgrade.operators.batches import assign_batches
from snapgrade.operators.dedupe import GroupedPairs
from snapgrade.plans import run as runs
from snapgrade.plans.q_diff import CUSTOMER_DIFF_SQL
from snapgrade.plans.registry import query, table
from snapgrade.plans.standins import (
    CLEAN_CUSTOMERS_SQL, CUSTOMER_FIELDS, incoming_customers,
)
from snapgrade.session import scratch_path
from snapgrade.sources import landed, sinks
from snapgrade.streaming.landing import land_snapshot, reference_job, snapshot_job

_FILE_ROWS = 5000


def _land_arrays(rows: DataFrame, order: list[str], element: Column, folder: str) -> None:
    """Write an element text per row as JSON array files of ``_FILE_ROWS`` elements each."""
    placed = assign_batches(rows, order, _FILE_ROWS, batch="chunk")
    rows = F.array_sort(F.collect_list(F.struct("position", element.alias("element"))))
    arrays = placed.groupBy("chunk").agg(rows.alias("rows"))
    text = F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["element"]), ",\n"), F.lit("]"))
    arrays.select("chunk", text.alias("value")).write.partitionBy("chunk").text(folder, compression="gzip")


def _part_element() -> Column:
    """Parts as snapshot elements: a missing key, a JSON null, values of the wrong kind."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    odd = F.when(F.col("p_brand") == "Brand#3", F.lit('"none"')).otherwise(num_to_text(price))
    year = F.when(size > 25, (size + 1970).cast("string")).otherwise(F.lit("null"))
    method = F.when(
        F.col("p_type") != "PROMO", F.concat(F.lit('"discoverymethod": "'), "p_type", F.lit('", '))
    ).otherwise(F.lit(""))
    return F.concat(
        F.lit('{"pl_name": "'), "p_name", F.lit(" "), F.col("p_partkey").cast("string"), F.lit('", "hostname": "'),
        "p_brand", F.lit('", '), method, F.lit('"disc_year": '), year, F.lit(', "pl_bmasse": '), odd,
        F.lit(', "extra": [1]}'),
    )


@query(
    "json_snapshot",
    """SELECT p_name || ' ' || p_partkey AS planet_name, p_brand AS host_star,
      CASE WHEN p_type <> 'PROMO' THEN p_type END AS discovery_method,
      CASE WHEN p_size > 25 THEN p_size + 1970 END AS discovery_year,
      CASE WHEN p_brand <> 'Brand#3' THEN p_retailprice END AS planet_mass, NULL::DOUBLE AS planet_radius FROM part""",
)
def json_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_path(spark, "json-snapshot")
    _land_arrays(table(spark, sf, "part"), ["p_partkey"], _part_element(), folder)
    return landed.read_snapshot(spark, folder).select(
        "planet_name", "host_star", "discovery_method", "discovery_year", "planet_mass", "planet_radius"
    )


_REFERENCE_COLUMNS = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_returnflag",
]


def _reference_element() -> Column:
    """A line item as reference to its part, by its supplier: (part, supplier) repeats."""
    return F.concat(
        F.lit('{"pl_name": " part '), F.col("l_partkey").cast("string"), F.lit('", "pl_refname": "supplier '),
        F.col("l_suppkey").cast("string"), F.lit('\\t", "pl_pubdate": "'), F.date_format("l_shipdate", "yyyy-MM"),
        F.lit('", "pl_bmasse": '), num_to_text(F.col("l_quantity")), F.lit(', "discoverymethod": "'),
        "l_returnflag", F.lit('"}'),
    )


_REFERENCES_SQL = """lines AS (SELECT 'part ' || l_partkey AS planet_name, 'supplier ' || l_suppkey AS reference_name,
    strftime(l_shipdate, '%Y-%m') AS pub_date, l_quantity, l_returnflag FROM lineitem
    WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10))"""


@query(
    "json_references",
    f"WITH {_REFERENCES_SQL} SELECT planet_name, reference_name, pub_date, l_quantity AS planet_mass, "
    "l_returnflag AS discovery_method FROM lines",
)
def json_references(spark: SparkSession, sf: str) -> DataFrame:
    """References of the known parts only, names trimmed."""
    rows = _read_part_references(spark, sf)
    return rows.select(
        F.btrim("planet_name").alias("planet_name"),
        F.btrim("reference_name", F.lit(" \t")).alias("reference_name"),
        "pub_date", "planet_mass", "discovery_method",
    )


def _read_part_references(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_path(spark, "json-references")
    lines = table(spark, sf, "lineitem").select(*_REFERENCE_COLUMNS)
    _land_arrays(lines, _REFERENCE_COLUMNS, _reference_element(), folder)
    known = table(spark, sf, "part").filter(F.col("p_size") > 10).select(
        F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("planet_name")
    )
    return landed.read_references(spark, folder, known)


@query(
    "load_references",
    f"""WITH {_REFERENCES_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY planet_name, reference_name
        ORDER BY pub_date, l_quantity, l_returnflag) AS rn FROM lines),
      fresh AS (SELECT * FROM ranked WHERE rn = 1 AND (planet_name, reference_name) NOT IN
        (SELECT 'part ' || p_partkey, 'supplier ' || s_suppkey FROM part JOIN supplier ON p_size = s_nationkey))
    SELECT planet_name, reference_name, pub_date, ' ' || planet_name || ', ' || reference_name || chr(9) || ', discovered via '
        || l_returnflag || ', mass=' || printf('%.2f', l_quantity) || ' Earth masses' AS content,
      (row_number() OVER (ORDER BY planet_name, reference_name) - 1) // 100 AS batch FROM fresh""",
)
def load_references(spark: SparkSession, sf: str) -> DataFrame:
    """New references with their content text in embedding batches."""
    rows = _read_part_references(spark, sf)
    # a part is stored with each supplier of the nation that its size numbers
    stored = GroupedPairs(
        table(spark, sf, "part").select(
            F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("planet_name"), F.col("p_size").alias("number")
        ),
        table(spark, sf, "supplier").select(
            F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")).alias("reference_name"), F.col("s_nationkey").alias("number")
        ),
        "number",
    )
    loaded = runs.load_references(
        rows, stored, order=("pub_date", "planet_mass", "discovery_method"),
        measures=[("mass", "planet_mass", 2, "Earth masses")], method="discovery_method",
    )
    return loaded.drop("position")


@query(
    "first_comma_split",
    """SELECT c_name AS planet_name, c_mktsegment || ', balance ' || regexp_replace(CAST(c_acctbal AS VARCHAR), '\\.0$', '') AS content
    FROM customer WHERE c_nationkey > 2""",
)
def first_comma_split(spark: SparkSession, sf: str) -> DataFrame:
    """Customers through a quoted two-column file; nations 0..2 give unusable lines."""
    nation = F.col("c_nationkey")
    balance = num_to_text(F.col("c_acctbal"))
    line = (
        F.when(nation == 0, F.lit("no separator here"))
        .when(nation == 1, F.concat(F.lit('" ",'), "c_mktsegment"))
        .when(nation == 2, F.concat("c_name", F.lit(',""')))
        .otherwise(F.concat(F.lit(' "'), "c_name", F.lit('","'), "c_mktsegment", F.lit(", balance "), balance, F.lit('" ')))
    )
    folder = scratch_path(spark, "two-column")
    lines = table(spark, sf, "customer").select(line.alias("planet_name,content"))
    lines.write.options(header=True, quote="", escape="", sep="\x01", ignoreLeadingWhiteSpace=False,
                        ignoreTrailingWhiteSpace=False).csv(folder)
    return landed.read_two_column_csv(spark, folder)


@query(
    "json_fields",
    """SELECT event_id, CAST(props ->> '$.k' AS INTEGER) AS whole, CAST(props ->> '$.k' AS DOUBLE) AS number,
      NULL::VARCHAR AS text, event_type AS kind, CASE WHEN value > 20 THEN value END AS high FROM events""",
)
def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Single fields of JSON texts by kind; a number is no text, and a missing field is null."""
    high = F.when(F.col("value") > 20, num_to_text(F.col("value"))).otherwise(F.lit("null"))
    document = F.concat(
        F.expr("left(props, length(props) - 1)"), F.lit(', "kind": "'), "event_type", F.lit('", "high": '), high, F.lit("}")
    )
    parsed = table(spark, sf, "events").select("event_id", F.try_parse_json(document).alias("d"))
    field = lambda key, kind: json_field(F.col("d"), key, kind)
    return parsed.select(
        "event_id", field("k", "int").alias("whole"), field("k", "double").alias("number"),
        field("k", "string").alias("text"), field("kind", "string").alias("kind"), field("high", "double").alias("high"),
    )


@query(
    "round_trip_sink",
    """SELECT event_id, event_type, CAST(day(ts) AS INTEGER) AS ingest_run_id, 1 AS written FROM events
    UNION ALL SELECT event_id, event_type, CAST(day(ts) AS INTEGER), 2 FROM events WHERE event_type = 'error'""",
)
def round_trip_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Three appends to one partitioned table, one of them without rows."""
    path = scratch_path(spark, "evidence")
    rows = table(spark, sf, "events").select("event_id", "event_type", F.dayofmonth("ts").alias("ingest_run_id"))
    errors = rows.filter(F.col("event_type") == "error")
    sinks.append_rows(rows.withColumn("written", F.lit(1)), path, ["ingest_run_id"])
    sinks.append_rows(errors.withColumn("written", F.lit(2)), path, ["ingest_run_id"])
    sinks.append_rows(rows.filter(F.lit(False)).withColumn("written", F.lit(3)), path, ["ingest_run_id"])
    return landed.read_table(spark, path).select("event_id", "event_type", "ingest_run_id", "written")


@query(
    "append_references",
    """SELECT vec_id AS id, 'vector ' || vec_id AS reference_name, CAST(len(embedding) AS INTEGER) AS width,
      array_to_string(list_transform(embedding, lambda x: CAST(round(x::DOUBLE * 1000000) AS BIGINT)), ' ') AS millionths
    FROM embeddings""",
)
def append_references(spark: SparkSession, sf: str) -> DataFrame:
    """Reference rows appended with the vector cast from its text; every value of it is shown."""
    path = scratch_path(spark, "references")
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("reference_name"),
        text_to_vector(vector_to_text(F.col("embedding"))).alias("embedding"),
    )
    sinks.append_rows(rows, path)
    values = F.transform("embedding", lambda x: F.round(x.cast("double") * 1_000_000).cast("long").cast("string"))
    return landed.read_table(spark, path).select(
        "id", "reference_name", F.size("embedding").alias("width"), F.array_join(values, " ").alias("millionths")
    )


_CUSTOMER_STATE = T.StructType(
    [
        T.StructField("c_name", T.StringType()),
        T.StructField("c_nationkey", T.IntegerType()),
        T.StructField("c_acctbal", T.DoubleType()),
        T.StructField("c_mktsegment", T.StringType()),
    ]
)
_LANDED_CUSTOMER = T.StructType([T.StructField("source_row", T.LongType()), *_CUSTOMER_STATE.fields])


@query("stream_snapshot_diff", CUSTOMER_DIFF_SQL)
def stream_snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Two snapshots land one after the other; the change rows of the second."""
    base = scratch_path(spark, "landing")
    columns = _LANDED_CUSTOMER.names
    first = table(spark, sf, "customer").withColumn("source_row", F.col("c_custkey")).select(*columns)
    second = incoming_customers(spark, sf).select(*columns)
    landing, tables = f"{base}/in", {n: f"{base}/{n}" for n in ("state", "pairs", "changes", "checkpoint")}
    for number, snapshot in enumerate((first, second)):
        land_snapshot(snapshot, landing, str(number))
        snapshot_job(
            spark, landing, _LANDED_CUSTOMER, **tables, state_schema=_CUSTOMER_STATE, keys=["c_name"],
            fields=CUSTOMER_FIELDS, order=["source_row"],
        ).start().awaitTermination()
    return spark.read.parquet(f"{tables['changes']}/version=1")


@query(
    "stream_references",
    """SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL""",
)
def stream_references(spark: SparkSession, sf: str) -> DataFrame:
    """Events land by type and half; each (user, type) is stored once, from the earlier half."""
    base = scratch_path(spark, "references")
    events = table(spark, sf, "events").select(
        F.concat(F.lit(" "), F.col("user_id").cast("string")).alias("user"), "event_type", "event_id"
    )
    landed_schema = events.schema
    half = events.agg(F.avg("event_id")).first()[0]
    stored = f"{base}/table"
    for part in (events.filter(F.col("event_id") <= half), events.filter(F.col("event_id") > half)):
        part.write.mode("append").parquet(f"{base}/in")
        reference_job(
            spark, f"{base}/in", landed_schema, table=stored, checkpoint=f"{base}/checkpoint",
            keys=["user", "event_type"], order=["event_id"],
        ).start().awaitTermination()
    return spark.read.parquet(stored).select(F.col("user").cast("long").alias("user_id"), "event_type", "event_id")


_AT = "2024-02-01 10:00:00"

# The state after the run, and the label each changed customer gets.
_RUN_SQL = f"""changes AS ({CUSTOMER_DIFF_SQL}), clean AS (WITH {CLEAN_CUSTOMERS_SQL} SELECT * FROM cleaned),
  state AS (SELECT coalesce(o.c_name, n.c_name) AS c_name,
      CASE WHEN n.c_name IS NULL THEN o.c_nationkey ELSE n.c_nationkey END AS c_nationkey,
      CASE WHEN n.c_name IS NULL THEN o.c_acctbal ELSE n.c_acctbal END AS c_acctbal,
      CASE WHEN n.c_name IS NULL THEN o.c_mktsegment ELSE n.c_mktsegment END AS c_mktsegment,
      o.c_name IS NULL AS is_new
    FROM customer o FULL JOIN clean n ON o.c_name = n.c_name),
  labels AS (SELECT c_name, CASE WHEN c_acctbal IS NULL THEN 'CANDIDATE|J???' ELSE 'CONFIRMED|J???' END AS label
    FROM state WHERE c_name IN (SELECT c_name FROM changes)),
  log AS (SELECT c_name AS planet_name, change_type, field_name, old_value, new_value, NULL::VARCHAR AS ai_classification,
      NULL::VARCHAR AS ai_reasoning, 'diff' AS stage FROM changes
    UNION ALL SELECT c_name, 'UPDATE', 'classification',
      CASE WHEN row_number() OVER (PARTITION BY c_name ORDER BY field_name NULLS FIRST) > 1 THEN label END,
      label, label, 'by rule', 'label' FROM changes JOIN labels USING (c_name)),
  codes AS (SELECT *, CASE WHEN c_acctbal IS NULL THEN '?' WHEN c_acctbal < 0.1 THEN 'm' WHEN c_acctbal < 10 THEN 'e'
      WHEN c_acctbal < 100 THEN 'N' WHEN c_acctbal < 4000 THEN 'J' ELSE 'W' END || '???' AS expected_code
    FROM state JOIN labels USING (c_name)),
  grades AS (SELECT c_name AS planet_name, 'CLASSIFICATION' AS eval_type, split_part(label, '|', 1) AS expected_value,
      split_part(label, '|', 1) AS actual_value, 100 AS score, 'accuracy' AS dimension, 'PASS' AS pass_fail FROM codes
    UNION ALL SELECT c_name, 'PLAVALOVA', expected_code, 'J???', CASE WHEN expected_code = 'J???' THEN 100 ELSE 75 END,
      'accuracy', 'PASS' FROM codes)"""


def _run_customers(spark: SparkSession, sf: str, tables: runs.RunTables) -> DataFrame:
    """A whole run over the customers; answers of the remote model are made from the texts sent."""
    stored = table(spark, sf, "customer").select(
        "c_name", *CUSTOMER_FIELDS, F.lit(None).cast("string").alias("classification"),
        F.lit(None).cast("timestamp").alias("created"), F.lit(None).cast("timestamp").alias("updated"),
    )
    rule = F.when(F.col("c_acctbal").isNull(), "CANDIDATE").otherwise("CONFIRMED")
    none = F.lit(None).cast("double")
    line_fields = (("name", "c_name", None), ("balance", "c_acctbal", 2))

    def answer(element) -> runs.Ask:
        lines = F.regexp_extract_all("text", F.lit(r"(?m)^(name=.*)$"), 1)
        array = F.concat(F.lit("["), F.array_join(F.transform(lines, element), ","), F.lit("]"))
        return lambda sent: sent.select("batch", array.alias("text"))

    def label_element(line: Column) -> Column:
        name = F.upper(F.regexp_extract(line, r"name=([^,]+)", 1))
        quality = F.when(line.endswith("balance=?"), "CANDIDATE").otherwise("CONFIRMED")
        return F.concat(
            F.lit('{"planet_name": "'), name, F.lit('", "classification": "'), quality,
            F.lit('", "plavalova_code": "J???", "reasoning": "by rule"}'),
        )

    def judge_element(line: Column) -> Column:
        name = F.regexp_extract(line, r"name=([^,]+)", 1)
        score = F.when(line.contains("CANDIDATE"), "3").otherwise("9")
        return F.concat(F.lit('{"planet_name": "'), name, F.lit('", "score": '), score, F.lit("}"))

    return runs.whole_run(
        spark, tables, 1, stored, incoming_customers(spark, sf), name="c_name", fields=CUSTOMER_FIELDS,
        order=["source_row"], at=F.lit(_AT).cast("timestamp"), created="created", updated="updated",
        label_line=texts.entity_line(line_fields), judge_line=texts.judge_line("c_name", "classification", line_fields[1:]),
        expected_label=rule, expected_code=rules.four_letter_code(F.col("c_acctbal"), none, none, none),
        ask_labels=answer(label_element), ask_judge=answer(judge_element),
        ask_report=lambda sent: sent.select("ingest_run_id", F.lit("done").alias("report_text"), F.lit(0).alias("tokens_used")),
    )


def _finished_run(spark: SparkSession, sf: str) -> runs.RunTables:
    """Tables of a run of its own over this folder's customers."""
    tables = runs.RunTables(scratch_path(spark, "run"))
    _run_customers(spark, sf, tables)
    return tables


@query(
    "snapshot_run",
    f"""WITH {_RUN_SQL}, all_in AS (WITH {CLEAN_CUSTOMERS_SQL} SELECT count(*) AS n FROM incoming)
    SELECT (SELECT n FROM all_in) AS fetched, (SELECT count(*) FROM clean) AS valid_incoming,
      (SELECT count(*) FROM log) AS change_rows, (SELECT count(*) FROM state) AS stored_rows,
      (SELECT count(*) FROM grades) AS grade_rows, CAST(1 AS BIGINT) AS reports, CAST(2 AS BIGINT) AS ledger_rows,
      CAST(1 AS BIGINT) AS verdicts, (SELECT count(*) FROM labels) AS judge_rows""",
)
def snapshot_run(spark: SparkSession, sf: str) -> DataFrame:
    """Rows left by a run whose every stage ran twice."""
    tables = _finished_run(spark, sf)
    result = _run_customers(spark, sf, tables)
    rows_of = lambda df: df.agg(F.count(F.lit(1))).scalar()
    judged = F.col("eval_type") == "LLM_JUDGE"
    evals = tables.read(spark, "eval_result")
    return result.select(
        "fetched",
        "valid_incoming",
        rows_of(tables.read(spark, "change_log")).alias("change_rows"),
        rows_of(spark.read.parquet(tables.state_path(1))).alias("stored_rows"),
        rows_of(evals.filter(~judged)).alias("grade_rows"),
        rows_of(tables.read(spark, "change_report")).alias("reports"),
        rows_of(tables.read(spark, "ingest_run")).alias("ledger_rows"),
        rows_of(tables.read(spark, "drift_verdict")).alias("verdicts"),
        rows_of(evals.filter(judged)).alias("judge_rows"),
    )


@query(
    "run_change_log",
    f"WITH {_RUN_SQL} SELECT 1 AS ingest_run_id, *, '{_AT}' AS detected_at FROM log",
)
def run_change_log(spark: SparkSession, sf: str) -> DataFrame:
    log = _finished_run(spark, sf).read(spark, "change_log")
    return log.withColumn("detected_at", F.col("detected_at").cast("string"))


@query(
    "run_state",
    f"""WITH {_RUN_SQL} SELECT c_name, c_nationkey, c_acctbal, c_mktsegment, label AS classification,
      CASE WHEN is_new THEN '{_AT}' END AS created, CASE WHEN label IS NOT NULL THEN '{_AT}' END AS updated
    FROM state LEFT JOIN labels USING (c_name)""",
)
def run_state(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled state; times only where the run touched a row."""
    state = spark.read.parquet(_finished_run(spark, sf).state_path(1, "labelled"))
    return state.withColumns({c: F.col(c).cast("string") for c in ("created", "updated")})


@query(
    "run_grades",
    f"""WITH {_RUN_SQL} SELECT *, '{_AT}' AS evaluated_at FROM grades
    UNION ALL SELECT c_name, 'LLM_JUDGE', NULL, CASE WHEN c_acctbal IS NULL THEN 'score=3|' ELSE 'score=9|' END,
      CASE WHEN c_acctbal IS NULL THEN 30 ELSE 90 END, 'reasoning', CASE WHEN c_acctbal IS NULL THEN 'FAIL' ELSE 'PASS' END, '{_AT}' FROM codes""",
)
def run_grades(spark: SparkSession, sf: str) -> DataFrame:
    evals = _finished_run(spark, sf).read(spark, "eval_result")
    return evals.withColumn("evaluated_at", F.col("evaluated_at").cast("string")).drop("ingest_run_id", "stage")


@query(
    "run_report",
    f"""WITH {_RUN_SQL}, sums AS (SELECT count(*) FILTER (change_type = 'INSERT') AS i, count(*) FILTER (change_type = 'UPDATE') AS u,
        count(*) FILTER (change_type = 'DELETE') AS d, count(*) AS n FROM log)
    SELECT 'external' AS model_used, 'done' AS report_text, 0 AS tokens_used, '{_AT}' AS generated_at, i AS inserts, u AS updates,
      d AS deletes, greatest(n - 50, 0) AS not_shown FROM sums""",
)
def run_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report record, with the numbers its text names: label rows are counted too."""
    record = _finished_run(spark, sf).read(spark, "change_report")
    number = lambda pattern: F.coalesce(
        F.nullif(F.regexp_extract("prompt_sent", pattern, 1), F.lit("")).cast("long"), F.lit(0).cast("long")
    )
    return record.select(
        "model_used", "report_text", "tokens_used", F.col("generated_at").cast("string").alias("generated_at"),
        number(r"Summary: (\d+) inserts").alias("inserts"), number(r"(\d+) updates").alias("updates"),
        number(r"(\d+) deletes").alias("deletes"), number(r"and (\d+) more").alias("not_shown"),
    )


@query(
    "run_verdict",
    f"""WITH {_RUN_SQL} SELECT CAST(1 AS BIGINT) AS run_id, round(avg(score), 6) AS current_avg, CAST(0 AS BIGINT) AS recent_runs,
      'first_run' AS verdict FROM grades WHERE eval_type = 'PLAVALOVA'""",
)
def run_verdict(spark: SparkSession, sf: str) -> DataFrame:
    verdicts = _finished_run(spark, sf).read(spark, "drift_verdict")
    return verdicts.select("run_id", F.round("current_avg", 6).alias("current_avg"), "recent_runs", "verdict")


@query(
    "audit_scan",
    f"""WITH {_RUN_SQL}, counts AS (SELECT count(*) FILTER (stage = 'diff' AND change_type = 'INSERT') AS i,
        count(*) FILTER (stage = 'diff' AND change_type = 'DELETE') AS d FROM log)
    SELECT 'ingest_run' AS audit_table, 'RUNNING' AS kind, CAST(1 AS BIGINT) AS rows
    UNION ALL SELECT 'ingest_run', 'COMPLETED +' || i || ' -' || d, 1 FROM counts
    UNION ALL SELECT 'change_log', change_type, count(*) FROM log GROUP BY change_type
    UNION ALL SELECT 'eval_result', eval_type, count(*) FROM grades GROUP BY eval_type
    UNION ALL SELECT 'eval_result', 'LLM_JUDGE', count(*) FROM labels
    UNION ALL SELECT 'change_report', 'external', 1 UNION ALL SELECT 'drift_verdict', 'first_run', 1""",
)
def audit_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The five audit tables a run leaves behind, by kind of row."""
    tables = _finished_run(spark, sf)
    counters = F.concat(F.lit(" +"), F.col("rows_new").cast("string"), F.lit(" -"), F.col("rows_deleted").cast("string"))
    kinds = {
        "ingest_run": F.concat("status", F.coalesce(counters, F.lit(""))),
        "change_log": F.col("change_type"),
        "eval_result": F.col("eval_type"),
        "change_report": F.col("model_used"),
        "drift_verdict": F.col("verdict"),
    }
    scans = [
        tables.read(spark, name).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("rows"))
        .select(F.lit(name).alias("audit_table"), "kind", "rows")
        for name, kind in kinds.items()
    ]
    return reduce(DataFrame.unionByName, scans)


@query(
    "ledger_states",
    """SELECT * FROM (VALUES (1, 'RUNNING', false, false), (1, 'COMPLETED', true, false), (2, 'RUNNING', false, false),
      (2, 'FAILED', true, true)) v(id, status, closed, has_error)
    WHERE (SELECT count(*) FROM customer) > 0""",
)
def ledger_states(spark: SparkSession, sf: str) -> DataFrame:
    """Ledger rows of a run that ended well and of one whose snapshot is broken, each tried twice."""
    tables = runs.RunTables(scratch_path(spark, "ledger"))
    stored = table(spark, sf, "customer").select("c_name", *CUSTOMER_FIELDS)
    incoming = incoming_customers(spark, sf)
    broken = incoming.withColumn("c_nationkey", F.raise_error(F.lit("broken snapshot")).cast("int"))
    how = {"keys": ["c_name"], "fields": CUSTOMER_FIELDS, "order": ["source_row"], "at": F.lit(_AT).cast("timestamp")}
    for run_id, snapshot in ((1, incoming), (1, incoming), (2, broken), (2, broken)):
        try:
            runs.ingest(spark, tables, run_id, stored, snapshot, **how)
        except Exception as error:
            if "broken snapshot" not in str(error):
                raise
    rows = tables.read(spark, "ingest_run")
    return rows.select(
        "id", "status", F.col("completed_at").isNotNull().alias("closed"),
        F.coalesce(F.col("error_message").contains("broken snapshot"), F.lit(False)).alias("has_error"),
    )
