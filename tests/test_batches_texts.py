from pyspark.sql import functions as F

from conftest import plan_of
from snapgrade.operators import batches, texts


def test_positions_follow_the_order(spark):
    # a third of the rows share one value of the leading column
    df = spark.range(1000).select("id", F.when(F.col("id") < 333, 5).otherwise((F.col("id") * 37) % 101).alias("v"))
    got = [(r.position, r.v, r.id) for r in batches.with_position(df, ["v", "id"]).orderBy("position").collect()]
    assert [p for p, _, _ in got] == list(range(1000))
    assert [(v, i) for _, v, i in got] == sorted((v, i) for _, v, i in got)


def test_batch_sizes(spark):
    placed = batches.assign_batches(spark.range(230), ["id"], 50)
    sizes = {r.batch: r["count"] for r in placed.groupBy("batch").count().collect()}
    assert sizes == {0: 50, 1: 50, 2: 50, 3: 50, 4: 30}
    assert batches.assign_batches(spark.range(0), ["id"], 50).count() == 0


def test_data_rows_do_not_go_through_one_task(spark):
    plan = plan_of(batches.with_position(spark.range(100), ["id"]))
    data_side = plan.split("BroadcastExchange")[0]
    assert "SinglePartition" not in data_side


def test_batch_text_with_context(spark):
    entities = spark.createDataFrame(
        [(0, 1, "a", 2000, "Transit", 1.005, None), (0, 0, "b", None, None, None, [("c", 0.875)]), (1, 2, "d", 1, "x", 2.0, [])],
        "batch int, position int, planet_name string, discovery_year int, discovery_method string, planet_mass double, "
        "context array<struct<content:string,similarity:double>>",
    )
    fields = (("name", "planet_name", None), ("disc_year", "discovery_year", None), ("mass_earth", "planet_mass", 2))
    lines = entities.select(
        "batch", "position",
        F.concat_ws("\n", texts.entity_line(fields), texts.context_block(F.col("context"))).alias("line"),
    )
    got = {r.batch: (r.entities, r.text) for r in texts.batch_text(lines, batch="batch", position="position", line="line", header="H", footer="E").collect()}
    assert got == {
        0: (2, "H\nname=b, disc_year=?, mass_earth=?\n  RESEARCH CONTEXT:\n  - c (relevance: 0.88)\nname=a, disc_year=2000, mass_earth=1.00\nE\n"),
        1: (1, "H\nname=d, disc_year=1, mass_earth=2.00\nE\n"),
    }
    variants = texts.variant_texts(
        texts.batch_text(lines, batch="batch", position="position", line="line", header="H", footer="E"),
        batch="batch", headers={"v": "V", "w": "W"},
    )
    assert variants.count() == 4 and variants.filter("variant = 'w' and batch = 1").first().text.startswith("W\nH\n")


def test_judge_line(spark):
    df = spark.createDataFrame([("a", "OK|code", 1.0), ("b", "OK", None), ("c", None, None)], "n string, l string, m double")
    line = texts.judge_line("n", "l", (("mass_earth", "m", 2),))
    assert [r[0] for r in df.select(line).collect()] == [
        "name=a, classification=OK, plavalova_code=code, mass_earth=1.00",
        "name=b, classification=OK, plavalova_code=?, mass_earth=?",
        "name=c, classification=?, plavalova_code=?, mass_earth=?",
    ]


def test_report_text(spark):
    data = [(1, "UPDATE", "p", "f", None, "2"), (1, "INSERT", "q", None, None, None), (1, "DELETE", "r", None, None, None), (2, "INSERT", "s", None, None, None)]
    changes = spark.createDataFrame(data, "run int, change_type string, name string, field_name string, old_value string, new_value string")
    got = {r.run: r for r in texts.report_text(changes, run="run", entity="name", sample=2, header="H").collect()}
    assert got[1].text == (
        "H\nSummary: 1 inserts, 1 updates, 1 deletes.\n\n--- CHANGES (sample, max 2) ---\nDELETE: r\nINSERT: q\n... and 1 more.\n--- END CHANGES ---\n"
    )
    assert "more" not in got[2].text
    full = texts.report_text(changes, run="run", entity="name", header="H").filter("run = 1").first().text
    assert "UPDATE: p — f: [null] → [2]\n" in full
    answers = spark.createDataFrame([(1, "fine", 7)], "run int, report_text string, tokens_used int")
    record = texts.report_record(texts.report_text(changes, run="run", entity="name"), answers, run="run", model="m")
    assert [(r.run, r.model_used, r.report_text, r.tokens_used) for r in record.collect()] == [(1, "m", "fine", 7)]
