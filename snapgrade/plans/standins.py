"""Catalogue-like frames derived from the driver's tables, and the same derivations as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from snapgrade.functions import rules
from snapgrade.operators.dedupe import clean_keys, first_per_key
from snapgrade.plans.registry import table

CUSTOMER_FIELDS = ["c_nationkey", "c_acctbal", "c_mktsegment"]


def incoming_customers(spark: SparkSession, sf: str) -> DataFrame:
    """A later snapshot of ``customer``: rows gone, changed, nulled, padded, repeated, new, blank."""
    customer, supplier = table(spark, sf, "customer"), table(spark, sf, "supplier")
    kept = customer.filter(F.col("c_acctbal") >= -900)
    nation = F.col("c_nationkey")
    changed = kept.select(
        F.col("c_custkey").alias("source_row"),
        F.when(nation == 5, F.concat(F.lit("\t "), "c_name", F.lit(" "))).otherwise(F.col("c_name")).alias("c_name"),
        F.when(nation == 24, F.lit(0)).otherwise(nation).alias("c_nationkey"),
        F.when(nation == 3, F.col("c_acctbal") * 2)
        .when(nation == 11, F.lit(None))
        .otherwise(F.col("c_acctbal"))
        .alias("c_acctbal"),
        F.when((nation == 7) & (F.col("c_mktsegment") == "BUILDING"), F.lit("MACHINERY"))
        .otherwise(F.col("c_mktsegment"))
        .alias("c_mktsegment"),
    )
    copies = kept.filter(nation == 1).select(
        (F.col("c_custkey") + 1_000_000_000).alias("source_row"),
        "c_name",
        "c_nationkey",
        F.lit(0.0).alias("c_acctbal"),
        "c_mktsegment",
    )

    def from_supplier(offset: int, name: F.Column) -> DataFrame:
        return supplier.select(
            (F.col("s_suppkey") + offset).alias("source_row"),
            name.alias("c_name"),
            F.col("s_nationkey").alias("c_nationkey"),
            F.col("s_acctbal").alias("c_acctbal"),
            F.lit(None).cast("string").alias("c_mktsegment"),
        )

    new = from_supplier(2_000_000_000, F.col("s_name"))
    blank = from_supplier(3_000_000_000, F.lit("\t "))
    return changed.unionByName(copies).unionByName(new).unionByName(blank)


def clean_customers(spark: SparkSession, sf: str) -> DataFrame:
    return first_per_key(clean_keys(incoming_customers(spark, sf), ["c_name"]), ["c_name"], ["source_row"])


INCOMING_CUSTOMERS_SQL = """incoming AS (
  SELECT c_custkey AS source_row,
    CASE WHEN c_nationkey = 5 THEN chr(9) || ' ' || c_name || ' ' ELSE c_name END AS c_name,
    CASE WHEN c_nationkey = 24 THEN 0 ELSE c_nationkey END AS c_nationkey,
    CASE WHEN c_nationkey = 3 THEN c_acctbal * 2 WHEN c_nationkey = 11 THEN NULL ELSE c_acctbal END AS c_acctbal,
    CASE WHEN c_nationkey = 7 AND c_mktsegment = 'BUILDING' THEN 'MACHINERY' ELSE c_mktsegment END AS c_mktsegment
  FROM customer WHERE c_acctbal >= -900
  UNION ALL SELECT c_custkey + 1000000000, c_name, c_nationkey, 0.0, c_mktsegment
    FROM customer WHERE c_acctbal >= -900 AND c_nationkey = 1
  UNION ALL SELECT s_suppkey + 2000000000, s_name, s_nationkey, s_acctbal, NULL FROM supplier
  UNION ALL SELECT s_suppkey + 3000000000, chr(9) || ' ', s_nationkey, s_acctbal, NULL FROM supplier)"""

CLEAN_CUSTOMERS_SQL = INCOMING_CUSTOMERS_SQL + """, named AS (
  SELECT source_row, trim(c_name, chr(9) || ' ') AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM incoming),
cleaned AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY c_name ORDER BY source_row) AS rn FROM named WHERE c_name <> '')
  WHERE rn = 1)"""

LINE_KEYS = ["l_orderkey", "l_linenumber"]
LINE_FIELDS = ["l_quantity", "l_discount", "l_returnflag"]
LINE_ORDER = [
    "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
    "l_linestatus", "l_shipdate",
]


def stored_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``lineitem`` with one row per key (keys repeat in the table)."""
    return first_per_key(table(spark, sf, "lineitem"), LINE_KEYS, LINE_ORDER)


def incoming_lines(spark: SparkSession, sf: str) -> DataFrame:
    kept = table(spark, sf, "lineitem").filter(F.col("l_extendedprice") >= 2000)
    return first_per_key(kept, LINE_KEYS, LINE_ORDER).withColumns(
        {
            "l_quantity": F.when(F.col("l_linestatus") == "F", F.col("l_quantity") + 1).otherwise(F.col("l_quantity")),
            "l_discount": F.when(F.col("l_discount") > 0.08, F.lit(None)).otherwise(F.col("l_discount")),
        }
    )


_LINES_SQL = """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
    PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount,
    l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn FROM lineitem {where}) WHERE rn = 1"""

LINES_SQL = (
    "stored AS (" + _LINES_SQL.format(where="") + "), picked AS ("
    + _LINES_SQL.format(where="WHERE l_extendedprice >= 2000")
    + """), fresh AS (SELECT * REPLACE (
    CASE WHEN l_linestatus = 'F' THEN l_quantity + 1 ELSE l_quantity END AS l_quantity,
    CASE WHEN l_discount > 0.08 THEN NULL ELSE l_discount END AS l_discount) FROM picked)"""
)


def order_entities(spark: SparkSession, sf: str) -> DataFrame:
    """``orders`` as catalogue entities with measures and an externally given label."""
    day = F.col("o_orderdate")
    base = table(spark, sf, "orders").select(
        "o_orderkey",
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("planet_name"),
        (F.year(day) - 5).alias("discovery_year"),
        F.col("o_orderpriority").alias("discovery_method"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("planet_mass"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.month(day) / 4.0).alias("planet_radius"),
        (F.dayofyear(day) / 2.0).alias("orbital_period"),
        (F.dayofmonth(day) / 40.0).alias("eccentricity"),
        (F.month(day) * 90.0).alias("equilibrium_temp"),
        (F.dayofyear(day) / 20.0).alias("planet_density"),
        F.lit(None).cast("double").alias("insolation_flux"),
        "o_orderstatus",
        "o_orderpriority",
    )
    expected = rules.four_letter_code(
        F.col("planet_mass"), F.col("equilibrium_temp"), F.col("eccentricity"), F.col("planet_density")
    )
    coded = base.withColumn("expected_code", expected)
    code, priority = F.col("expected_code"), F.col("o_orderpriority")
    given = (
        F.when(priority == "1-URGENT", F.lower(code))
        .when(priority == "2-HIGH", F.concat(F.lit("z"), F.substring(code, 2, 3)))
        .when(priority == "3-MEDIUM", F.substring(code, 1, 3))
        .when(priority == "4-NOT SPECIFIED", code)
    )
    label = (
        F.when(F.col("o_orderstatus") == "F", "CONFIRMED")
        .when(F.col("o_orderstatus") == "O", "CANDIDATE")
        .otherwise("ANOMALY")
    )
    return coded.withColumn("classification", rules.join_label(label, given))


ORDER_ENTITIES_SQL = """measured AS (
  SELECT o_orderkey, 'Order ' || o_orderkey AS planet_name, CAST(year(o_orderdate) - 5 AS INTEGER) AS discovery_year,
    o_orderpriority AS discovery_method, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS planet_mass,
    CASE WHEN o_orderpriority <> '5-LOW' THEN month(o_orderdate) / 4.0::DOUBLE END AS planet_radius,
    dayofyear(o_orderdate) / 2.0::DOUBLE AS orbital_period, day(o_orderdate) / 40.0::DOUBLE AS eccentricity,
    month(o_orderdate) * 90.0::DOUBLE AS equilibrium_temp, dayofyear(o_orderdate) / 20.0::DOUBLE AS planet_density,
    o_orderstatus, o_orderpriority FROM orders),
coded AS (SELECT *,
    CASE WHEN planet_mass IS NULL THEN '?' WHEN planet_mass < 0.1 THEN 'm' WHEN planet_mass < 10 THEN 'e'
         WHEN planet_mass < 100 THEN 'N' WHEN planet_mass < 4000 THEN 'J' ELSE 'W' END
    || CASE WHEN equilibrium_temp < 200 THEN 'F' WHEN equilibrium_temp < 450 THEN 'W'
            WHEN equilibrium_temp < 1000 THEN 'G' ELSE 'R' END
    || CASE WHEN eccentricity < 0.1 THEN '0' WHEN eccentricity < 0.3 THEN '1' WHEN eccentricity < 0.6 THEN '2'
            ELSE '3' END
    || CASE WHEN planet_density < 1 THEN 'g' WHEN planet_density < 3 THEN 'w' WHEN planet_density < 8 THEN 't'
            WHEN planet_density < 15 THEN 'i' ELSE 's' END AS expected_code,
    CASE WHEN discovery_year < 1992 OR discovery_year > 2026 THEN 'ANOMALY'
         WHEN planet_mass IS NULL AND planet_radius IS NULL THEN 'CANDIDATE' ELSE 'CONFIRMED' END AS expected_label
  FROM measured),
given AS (SELECT *,
    CASE o_orderstatus WHEN 'F' THEN 'CONFIRMED' WHEN 'O' THEN 'CANDIDATE' ELSE 'ANOMALY' END AS given_label,
    CASE o_orderpriority WHEN '1-URGENT' THEN lower(expected_code) WHEN '2-HIGH' THEN 'z' || substr(expected_code, 2, 3)
         WHEN '3-MEDIUM' THEN substr(expected_code, 1, 3) WHEN '4-NOT SPECIFIED' THEN expected_code END AS given_code
  FROM coded)"""


def event_days(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` with the day number of January 2024 as run id and whole scores."""
    return table(spark, sf, "events").select(
        F.dayofmonth("ts").alias("ingest_run_id"),
        F.col("event_type").alias("eval_type"),
        F.floor("value").cast("int").alias("score"),
        "event_id",
        "user_id",
        "ts",
    )


def event_runs(spark: SparkSession, sf: str) -> DataFrame:
    """A run ledger over the days: a day whose errors outnumber its views has failed."""
    errors = F.count_if(F.col("eval_type") == "error")
    views = F.count_if(F.col("eval_type") == "view")
    return (
        event_days(spark, sf)
        .groupBy("ingest_run_id")
        .agg(F.when(errors > views, "FAILED").otherwise("COMPLETED").alias("status"))
    )


EVENT_DAYS_SQL = """days AS (
  SELECT CAST(day(ts) AS INTEGER) AS ingest_run_id, event_type AS eval_type, CAST(floor(value) AS INTEGER) AS score,
    event_id, user_id, ts FROM events),
runs AS (
  SELECT ingest_run_id, CASE WHEN count(*) FILTER (eval_type = 'error') > count(*) FILTER (eval_type = 'view')
    THEN 'FAILED' ELSE 'COMPLETED' END AS status FROM days GROUP BY 1)"""
