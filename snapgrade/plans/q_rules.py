"""Queries: threshold rules, scores, labels, grading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from snapgrade.functions import rules
from snapgrade.functions.text import strip_fences
from snapgrade.operators import labels
from snapgrade.operators.drift import variant_scores
from snapgrade.plans.registry import query, table
from snapgrade.plans.standins import ORDER_ENTITIES_SQL, order_entities


def _line_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Measures on every side of every cut, with nulls, from ``lineitem``."""
    return table(spark, sf, "lineitem").select(
        F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice") / 20)
        .when(F.col("l_returnflag") != "N", F.col("l_discount"))
        .alias("mass"),
        (F.col("l_quantity") * 25).alias("temperature"),
        F.when(F.col("l_returnflag") != "R", F.col("l_tax") * 10).alias("eccentricity"),
        (F.col("l_discount") * 200).alias("density"),
    )


_LINE_MEASURES_SQL = """measures AS (
  SELECT CASE WHEN l_linestatus = 'O' THEN l_extendedprice / 20 WHEN l_returnflag <> 'N' THEN l_discount END AS mass,
    l_quantity * 25 AS temperature, CASE WHEN l_returnflag <> 'R' THEN l_tax * 10 END AS eccentricity,
    l_discount * 200 AS density FROM lineitem)"""


@query(
    "threshold_codes",
    f"""WITH {_LINE_MEASURES_SQL}, classes AS (SELECT
      CASE WHEN mass IS NULL THEN '?' WHEN mass < 0.1 THEN 'm' WHEN mass < 10 THEN 'e' WHEN mass < 100 THEN 'N'
           WHEN mass < 4000 THEN 'J' ELSE 'W' END AS mass_class,
      CASE WHEN temperature IS NULL THEN '?' WHEN temperature < 200 THEN 'F' WHEN temperature < 450 THEN 'W'
           WHEN temperature < 1000 THEN 'G' ELSE 'R' END AS temperature_class,
      CASE WHEN eccentricity IS NULL THEN '?' WHEN eccentricity < 0.1 THEN '0' WHEN eccentricity < 0.3 THEN '1'
           WHEN eccentricity < 0.6 THEN '2' ELSE '3' END AS eccentricity_class,
      CASE WHEN density IS NULL THEN '?' WHEN density < 1 THEN 'g' WHEN density < 3 THEN 'w' WHEN density < 8 THEN 't'
           WHEN density < 15 THEN 'i' ELSE 's' END AS density_class FROM measures)
    SELECT mass_class, temperature_class, eccentricity_class, density_class,
      mass_class || temperature_class || eccentricity_class || density_class AS code, count(*) AS entities
    FROM classes GROUP BY ALL""",
)
def threshold_codes(spark: SparkSession, sf: str) -> DataFrame:
    return (
        _line_measures(spark, sf)
        .select(
            rules.mass_class(F.col("mass")).alias("mass_class"),
            rules.temperature_class(F.col("temperature")).alias("temperature_class"),
            rules.eccentricity_class(F.col("eccentricity")).alias("eccentricity_class"),
            rules.density_class(F.col("density")).alias("density_class"),
            rules.four_letter_code(
                F.col("mass"), F.col("temperature"), F.col("eccentricity"), F.col("density")
            ).alias("code"),
        )
        .groupBy("mass_class", "temperature_class", "eccentricity_class", "density_class", "code")
        .agg(F.count(F.lit(1)).alias("entities"))
    )


@query("quality_label", f"WITH {ORDER_ENTITIES_SQL} SELECT o_orderkey, expected_label AS label FROM coded")
def quality_label(spark: SparkSession, sf: str) -> DataFrame:
    return order_entities(spark, sf).select("o_orderkey", _expected_label().alias("label"))


def _expected_label() -> Column:
    return rules.quality_label(F.col("discovery_year"), F.col("planet_mass"), F.col("planet_radius"))


_SCORE_SQL = """CASE WHEN given_code IS NULL OR length(given_code) <> 4 THEN 0 ELSE
    CASE WHEN upper(substr(given_code, 1, 1)) = upper(substr(expected_code, 1, 1)) THEN 25 ELSE 0 END
  + CASE WHEN upper(substr(given_code, 2, 1)) = upper(substr(expected_code, 2, 1)) THEN 25 ELSE 0 END
  + CASE WHEN upper(substr(given_code, 3, 1)) = upper(substr(expected_code, 3, 1)) THEN 25 ELSE 0 END
  + CASE WHEN upper(substr(given_code, 4, 1)) = upper(substr(expected_code, 4, 1)) THEN 25 ELSE 0 END END"""


@query(
    "component_score",
    f"WITH {ORDER_ENTITIES_SQL} SELECT o_orderkey, expected_code, given_code, {_SCORE_SQL} AS score FROM given",
)
def component_score(spark: SparkSession, sf: str) -> DataFrame:
    _, code = rules.split_label(F.col("classification"))
    return order_entities(spark, sf).select(
        "o_orderkey",
        "expected_code",
        code.alias("given_code"),
        rules.component_score(F.col("expected_code"), code).alias("score"),
    )


@query(
    "pass_rule",
    f"""WITH {ORDER_ENTITIES_SQL}, scored AS (SELECT {_SCORE_SQL} AS score, given_label, expected_label FROM given)
    SELECT score, CASE WHEN score >= 75 THEN 'PASS' ELSE 'FAIL' END AS code_result,
      CASE WHEN given_label = expected_label THEN 100 ELSE 0 END AS label_score, count(*) AS entities
    FROM scored GROUP BY ALL""",
)
def pass_rule(spark: SparkSession, sf: str) -> DataFrame:
    label, code = rules.split_label(F.col("classification"))
    return (
        order_entities(spark, sf)
        .select(
            rules.component_score(F.col("expected_code"), code).alias("score"),
            rules.equality_score(_expected_label(), label).alias("label_score"),
        )
        .withColumn("code_result", rules.pass_fail(F.col("score"), rules.CODE_PASS_MARK))
        .groupBy("score", "code_result", "label_score")
        .agg(F.count(F.lit(1)).alias("entities"))
    )


@query(
    "composite_split_join",
    """SELECT doc_id, source || CASE WHEN n_chars >= 1000 THEN '|' || lang ELSE '' END AS composite, source AS label,
      CASE WHEN n_chars >= 1000 THEN lang END AS code FROM documents""",
)
def composite(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "documents").select(
        "doc_id", rules.join_label(F.col("source"), F.when(F.col("n_chars") >= 1000, F.col("lang"))).alias("composite")
    )
    label, code = rules.split_label(F.col("composite"))
    return joined.select("doc_id", "composite", label.alias("label"), code.alias("code"))


@query(
    "clamp_scale",
    """SELECT CAST(l_quantity AS INTEGER) - 20 AS score, greatest(1, least(10, CAST(l_quantity AS INTEGER) - 20)) AS clamped,
      greatest(1, least(10, CAST(l_quantity AS INTEGER) - 20)) * 10 AS scaled, count(*) AS rows FROM lineitem GROUP BY ALL""",
)
def clamp_scale(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .groupBy((F.col("l_quantity").cast("int") - 20).alias("score"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(
            "score",
            rules.clamp_score(F.col("score")).alias("clamped"),
            rules.scaled_score(F.col("score")).alias("scaled"),
            "rows",
        )
    )


_GRADES_SQL = f"""{ORDER_ENTITIES_SQL}, scored AS (SELECT *, {_SCORE_SQL} AS code_score FROM given
    WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')),
  grades AS (
    SELECT planet_name, 'CLASSIFICATION' AS eval_type, expected_label AS expected_value, given_label AS actual_value,
      CASE WHEN given_label = expected_label THEN 100 ELSE 0 END AS score, 'accuracy' AS dimension,
      CASE WHEN given_label = expected_label THEN 'PASS' ELSE 'FAIL' END AS pass_fail FROM scored
    UNION ALL SELECT planet_name, 'PLAVALOVA', expected_code, given_code, code_score,
      CASE WHEN given_code IS NULL THEN 'completeness' ELSE 'accuracy' END,
      CASE WHEN code_score >= 75 THEN 'PASS' ELSE 'FAIL' END FROM scored)"""


def _order_grades(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with a returned line count as labelled in this run."""
    changes = table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R").select(
        F.concat(F.lit("Order "), F.col("l_orderkey").cast("string")).alias("planet_name"),
        F.lit("classification").alias("field_name"),
    )
    labelled = labels.labelled_entities(order_entities(spark, sf), changes)
    return labels.grade_labels(
        labelled,
        name="planet_name",
        label="classification",
        expected_label=_expected_label(),
        expected_code=F.col("expected_code"),
    )


@query("grade_labels", f"WITH {_GRADES_SQL} SELECT * FROM grades")
def grade_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _order_grades(spark, sf)


@query(
    "grade_summary",
    f"""WITH {_GRADES_SQL} SELECT eval_type, count(*) FILTER (pass_fail = 'PASS') AS passed, count(*) AS total,
      round(coalesce(avg(score), 0), 6) AS avg_score FROM grades GROUP BY eval_type""",
)
def grade_summary(spark: SparkSession, sf: str) -> DataFrame:
    return labels.grade_summary(_order_grades(spark, sf)).withColumn("avg_score", F.round("avg_score", 6))


@query(
    "grade_documents",
    """WITH judged AS (SELECT d.doc_id, CASE WHEN quality = 1 THEN 'CONFIRMED' ELSE 'CANDIDATE' END AS given,
        CASE WHEN n_chars >= 1500 THEN 'CONFIRMED' ELSE 'CANDIDATE' END AS expected
      FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
    SELECT given, expected, CASE WHEN given = expected THEN 'PASS' ELSE 'FAIL' END AS pass_fail, count(*) AS documents
    FROM judged GROUP BY ALL""",
)
def grade_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Given quality labels against a length rule over whole documents."""
    given = table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "CONFIRMED").otherwise("CANDIDATE").alias("given")
    )
    judged = given.join(table(spark, sf, "documents"), "doc_id")
    grades = labels.grade_labels(
        judged,
        name="doc_id",
        label="given",
        expected_label=F.when(F.col("n_chars") >= 1500, "CONFIRMED").otherwise("CANDIDATE"),
        expected_code=F.lit(None).cast("string"),
    )
    return (
        grades.filter(F.col("eval_type") == "CLASSIFICATION")
        .groupBy(F.col("actual_value").alias("given"), F.col("expected_value").alias("expected"), "pass_fail")
        .agg(F.count(F.lit(1)).alias("documents"))
    )


def _element(**values: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in values.items()]))


def _label_answers(spark: SparkSession, sf: str) -> DataFrame:
    """One answer text per order; the priority decides what is odd about it."""
    name = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))
    text_of = lambda c: c.cast("string")
    plain = _element(
        planet_name=name, classification=F.col("o_orderstatus"), plavalova_code=F.lit("eW0t"),
        reasoning=F.concat(F.lit("customer "), text_of(F.col("o_custkey"))),
    )
    second = _element(
        planet_name=F.upper(name), classification=F.lit("CONFIRMED"), reasoning=F.lit('says "yes" \\ twice')
    )
    lacking = _element(planet_name=F.lit("other"), classification=F.lit("X"))
    nothing = F.concat(F.lit('{"planet_name": null, "classification": "X", "reasoning": null}'))
    array = lambda *parts: F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]"))
    priority = F.col("o_orderpriority")
    text = (
        F.when(priority == "1-URGENT", F.concat(F.lit("```json\n"), array(plain, nothing), F.lit("\n```\n")))
        .when(priority == "2-HIGH", F.concat(F.lit("["), plain))
        .when(priority == "3-MEDIUM", array(plain, lacking))
        .when(priority == "4-NOT SPECIFIED", array(plain, second))
        .otherwise(F.concat(F.lit(" \n"), array(plain)))
    )
    return table(spark, sf, "orders").select("o_orderkey", text.alias("text"))


def _parsed_sql(lenient: bool) -> str:
    medium = "" if lenient else "AND o_orderpriority <> '3-MEDIUM'"
    last = "o_orderpriority = '4-NOT SPECIFIED'"
    return f"""SELECT o_orderkey, 'ORDER ' || o_orderkey AS name_key, CASE WHEN {last} THEN 1 ELSE 0 END AS position,
      CASE WHEN {last} THEN 'ORDER ' ELSE 'Order ' END || o_orderkey AS planet_name,
      CASE WHEN {last} THEN 'CONFIRMED' ELSE o_orderstatus || '|eW0t' END AS label,
      CASE WHEN {last} THEN 'says "yes" \\ twice' ELSE 'customer ' || o_custkey END AS reason
    FROM orders WHERE o_orderpriority <> '2-HIGH' {medium}"""


@query("parse_answers", _parsed_sql(lenient=False))
def parse_answers(spark: SparkSession, sf: str) -> DataFrame:
    parsed = labels.parse_answers(_label_answers(spark, sf), ["o_orderkey"], "text", labels.LABEL_FIELDS)
    return labels.labels_from_answers(parsed).select(
        "o_orderkey", "name_key", "position", "planet_name", "label", "reason"
    )


@query(
    "parse_answers_lenient",
    _parsed_sql(lenient=True)
    + " UNION ALL SELECT o_orderkey, 'OTHER', 1, 'other', 'X', '' FROM orders WHERE false",
)
def parse_answers_lenient(spark: SparkSession, sf: str) -> DataFrame:
    parsed = labels.parse_answers(
        _label_answers(spark, sf), ["o_orderkey"], "text", labels.LABEL_FIELDS, on_broken="skip_element"
    )
    return labels.labels_from_answers(parsed).select(
        "o_orderkey", "name_key", "position", "planet_name", "label", "reason"
    )


_NOT_BROKEN = "FROM orders WHERE o_orderpriority <> '2-HIGH'"


@query(
    "code_answers",
    f"""SELECT o_orderkey, 'ORDER ' || o_orderkey AS name_key, 0 AS position, 'Order ' || o_orderkey AS planet_name,
      'eW0t' AS plavalova_code {_NOT_BROKEN}""",
)
def code_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers read for their codes only: elements without a code are left out and break nothing."""
    return labels.parse_answers(_label_answers(spark, sf), ["o_orderkey"], "text", labels.CODE_FIELDS)


@query(
    "note_answers",
    f"""SELECT o_orderkey, 'ORDER ' || o_orderkey AS name_key, CASE WHEN last THEN 1 ELSE 0 END AS position,
        CASE WHEN last THEN 'ORDER ' ELSE 'Order ' END || o_orderkey AS planet_name,
        CASE WHEN last THEN 'CONFIRMED' ELSE o_orderstatus END AS classification,
        CASE WHEN last THEN '' ELSE 'eW0t' END AS plavalova_code, '' AS scientific_note
      FROM (SELECT *, o_orderpriority = '4-NOT SPECIFIED' AS last {_NOT_BROKEN})
    UNION ALL SELECT o_orderkey, 'OTHER', 1, 'other', 'X', '', '' FROM orders WHERE o_orderpriority = '3-MEDIUM'""",
)
def note_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers with optional notes: what an element lacks is an empty text."""
    return labels.parse_answers(_label_answers(spark, sf), ["o_orderkey"], "text", labels.NOTE_FIELDS)


@query(
    "answer_status",
    """SELECT CASE o_orderpriority WHEN '2-HIGH' THEN 'malformed' WHEN '3-MEDIUM' THEN 'broken_element' ELSE 'ok' END AS status,
      count(*) AS answers, CAST(sum(CASE o_orderpriority WHEN '2-HIGH' THEN 0 WHEN '5-LOW' THEN 1 ELSE 2 END) AS BIGINT) AS elements,
      count(*) FILTER (o_orderpriority = '3-MEDIUM') AS broken FROM orders GROUP BY 1""",
)
def answer_status(spark: SparkSession, sf: str) -> DataFrame:
    status = labels.answer_status(_label_answers(spark, sf), ["o_orderkey"], "text", labels.LABEL_FIELDS)
    return status.groupBy("status").agg(
        F.count(F.lit(1)).alias("answers"), F.sum("elements").alias("elements"), F.sum("broken").alias("broken")
    )


@query(
    "strip_fences",
    """SELECT conv_id, turn, trim(text, chr(10) || chr(13) || chr(9) || ' ') AS answer FROM conversations""",
)
def fences(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts, those of assistants fenced, with the fences taken off again."""
    fenced = F.when(
        F.col("role") == "assistant", F.concat(F.lit("```json\n"), "text", F.lit("\n``` \n"))
    ).otherwise(F.concat(F.lit(" \t"), "text", F.lit("\n")))
    return table(spark, sf, "conversations").select("conv_id", "turn", strip_fences(fenced).alias("answer"))


def _judge_answers(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("ORDER "), F.col("o_orderkey").cast("string"))
    score = (F.floor(F.col("o_totalprice") / 30000) - 2).cast("int")
    reason = F.when(F.col("o_orderpriority") != "3-MEDIUM", F.concat(F.lit("status "), "o_orderstatus"))
    plain = _element(planet_name=name, score=score, reasoning=reason)
    half = F.concat(F.lit('{"planet_name": "'), name, F.lit('", "score": 7.5}'))
    element = F.when(F.col("o_orderpriority") == "2-HIGH", half).otherwise(plain)
    return table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("["), element, F.lit("]")).alias("text"))


@query(
    "judge_rows",
    """WITH j AS (SELECT *, greatest(1, least(10, CAST(floor(o_totalprice / 30000) - 2 AS INTEGER))) AS points
      FROM orders WHERE o_orderpriority <> '2-HIGH')
    SELECT 'Order ' || o_orderkey AS planet_name, 'LLM_JUDGE' AS eval_type, NULL::VARCHAR AS expected_value,
      'score=' || points || '|' || CASE WHEN o_orderpriority = '3-MEDIUM' THEN '' ELSE 'status ' || o_orderstatus END AS actual_value,
      points * 10 AS score, 'reasoning' AS dimension, CASE WHEN points >= 7 THEN 'PASS' ELSE 'FAIL' END AS pass_fail FROM j""",
)
def judge_rows(spark: SparkSession, sf: str) -> DataFrame:
    judgments = labels.parse_answers(_judge_answers(spark, sf), ["o_orderkey"], "text", labels.JUDGE_FIELDS)
    return labels.judge_rows(order_entities(spark, sf), judgments, name="planet_name")


def _event_labels(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events as change rows of users in daily batches; a day's label is its last event's type,
    and days ending in an error have no label."""
    events = table(spark, sf, "events")
    changes = events.select(
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("planet_name"),
        F.dayofmonth("ts").cast("long").alias("batch"),
        F.col("event_id").alias("seq"),
        "event_type",
    )
    label_rows = (
        changes.groupBy("planet_name", "batch")
        .agg(F.max_by("event_type", "seq").alias("label"))
        .filter(F.col("label") != "error")
        .select("batch", F.upper("planet_name").alias("name_key"), "label", F.lit("last of day").alias("reason"))
    )
    users = events.groupBy(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("planet_name")).agg(
        F.min("event_type").alias("classification")
    )
    return changes.drop("event_type"), label_rows, users


_EVENT_LABELS_SQL = """changes AS (SELECT 'user ' || user_id AS planet_name, CAST(day(ts) AS BIGINT) AS batch, event_id AS seq, event_type FROM events),
  day_labels AS (SELECT planet_name, batch, max_by(event_type, seq) AS label FROM changes GROUP BY ALL),
  users AS (SELECT planet_name, min(event_type) AS stored FROM changes GROUP BY 1),
  labelled AS (SELECT c.planet_name, c.batch, c.seq, d.label FROM changes c JOIN day_labels d USING (planet_name, batch)
    WHERE d.label <> 'error')"""


@query(
    "apply_labels_chain",
    f"""WITH {_EVENT_LABELS_SQL} SELECT planet_name, batch, seq, 'UPDATE' AS change_type, 'classification' AS field_name,
      coalesce(lag(label) OVER (PARTITION BY planet_name ORDER BY batch, seq), stored) AS old_value, label AS new_value,
      label AS ai_classification, 'last of day' AS ai_reasoning FROM labelled JOIN users USING (planet_name)""",
)
def apply_labels_chain(spark: SparkSession, sf: str) -> DataFrame:
    changes, label_rows, users = _event_labels(spark, sf)
    return labels.apply_labels(changes, label_rows, users).changes


@query(
    "apply_labels_state",
    f"""WITH {_EVENT_LABELS_SQL}, final AS (SELECT planet_name, max_by(label, batch) AS label FROM labelled GROUP BY 1)
    SELECT planet_name, coalesce(label, stored) AS classification FROM users LEFT JOIN final USING (planet_name)""",
)
def apply_labels_state(spark: SparkSession, sf: str) -> DataFrame:
    changes, label_rows, users = _event_labels(spark, sf)
    return labels.apply_labels(changes, label_rows, users).entities


@query(
    "unmatched_changes_skipped",
    """SELECT o_custkey, o_orderkey, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0""",
)
def unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """Change rows with their entity: rows without one drop out, repeats stay."""
    entities = table(spark, sf, "customer").filter(F.col("c_acctbal") > 0)
    return table(spark, sf, "orders").join(entities, F.col("c_custkey") == F.col("o_custkey")).select(
        "o_custkey", "o_orderkey", "c_mktsegment"
    )


def _variants(entities: DataFrame) -> DataFrame:
    """Four sets of answers to the same entities: exact, other case, short, and partly missing."""
    code = F.col("expected_code")
    entry = lambda name, value: F.struct(F.lit(name).alias("variant"), value.alias("code"))
    answers = F.array(
        entry("exact", code),
        entry("lower", F.lower(code)),
        entry("short", F.substring(code, 1, 3)),
        entry("partial", F.when(F.col("planet_mass") > 250000, F.concat(F.substring(code, 1, 2), F.lit("zz")))),
    )
    return (
        entities.select(F.upper("planet_name").alias("name_key"), F.explode(answers).alias("a"))
        .select("name_key", "a.*")
        .filter(F.col("code").isNotNull())
    )


@query(
    "variant_scores",
    f"""WITH {ORDER_ENTITIES_SQL}, n AS (SELECT count(*) AS entities FROM coded),
      p AS (SELECT count(*) AS answered FROM coded WHERE planet_mass > 250000)
    SELECT 'exact' AS variant, entities, entities AS answered, 100.0::DOUBLE AS avg_score, entities AS passed FROM n
    UNION ALL SELECT 'lower', entities, entities, 100.0, entities FROM n
    UNION ALL SELECT 'short', entities, entities, 0.0, 0 FROM n
    UNION ALL SELECT 'partial', entities, answered, round(answered * 50 / entities::DOUBLE, 6), 0 FROM n, p
    UNION ALL SELECT 'silent', entities, 0, 0.0, 0 FROM n""",
)
def variants(spark: SparkSession, sf: str) -> DataFrame:
    entities = order_entities(spark, sf)
    names = spark.createDataFrame([(v,) for v in ("exact", "lower", "short", "partial", "silent")], "variant string")
    scores = variant_scores(entities, _variants(entities), names, name="planet_name", expected="expected_code")
    return scores.withColumn("avg_score", F.round("avg_score", 6))


@query(
    "two_set_compare",
    f"""WITH {ORDER_ENTITIES_SQL}, sides AS (SELECT planet_name,
        CASE WHEN discovery_year < 1996 THEN expected_code ELSE '?' END AS a, coalesce(given_code, '?') AS b FROM given)
    SELECT planet_name, a AS code_without, b AS code_with, CASE WHEN a = b THEN 'Same' ELSE 'DIFF' END AS code_match FROM sides""",
)
def two_set_compare(spark: SparkSession, sf: str) -> DataFrame:
    entities = order_entities(spark, sf)
    keyed = entities.withColumn("name_key", F.upper("planet_name"))
    _, given = rules.split_label(F.col("classification"))
    left = keyed.filter(F.col("discovery_year") < 1996).select("name_key", F.col("expected_code").alias("code"))
    right = keyed.select("name_key", given.alias("code")).filter(F.col("code").isNotNull())
    return labels.compare_label_sets(entities, left, right, name="planet_name", columns={"code": "?"})
