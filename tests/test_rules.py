import math

import pytest
from pyspark.sql import functions as F

from snapgrade.functions import rules

CUTS = [
    ("mass_class", rules.MASS_CUTS, "meNJW"),
    ("temperature_class", rules.TEMPERATURE_CUTS, "FWGR"),
    ("eccentricity_class", rules.ECCENTRICITY_CUTS, "0123"),
    ("density_class", rules.DENSITY_CUTS, "gwtis"),
]


@pytest.mark.parametrize("name,cuts,codes", CUTS)
def test_every_cut_and_the_double_below_it(spark, name, cuts, codes):
    given, expected = [], []
    for i, cut in enumerate(cuts):
        given += [cut, math.nextafter(cut, -math.inf)]
        expected += [codes[i + 1], codes[i]]
    given += [None, math.nan, -5.0, 1e30]
    expected += ["?", codes[-1], codes[0], codes[-1]]
    df = spark.createDataFrame(list(enumerate(given)), "i int, v double")
    got = [r.c for r in df.select("i", getattr(rules, name)(F.col("v")).alias("c")).orderBy("i").collect()]
    assert got == expected


def test_worked_codes(spark):
    given = [
        (1.0, 255.0, 0.017, 5.51, "eW0t"),
        (317.8, 110.0, 0.049, 1.33, "JF0w"),
        (18.7, 419.0, 0.0, 1.10, "NW0w"),
        (85.8, 900.0, 0.110, 0.35, "NG1g"),
        (11.0, 858.0, 0.0, 1.65, "NG0w"),
        (10.1, 1655.0, 0.0, 1.78, "NR0w"),
        (None, None, None, None, "????"),
    ]
    df = spark.createDataFrame(given, "m double, t double, e double, d double, want string")
    code = rules.four_letter_code(*[F.col(c) for c in "mted"])
    assert all(r.want == r.got for r in df.select("want", code.alias("got")).collect())


def test_quality_label_order(spark):
    given = [
        (1991, 1.0, 1.0, "ANOMALY"), (2027, None, None, "ANOMALY"), (1992, 1.0, None, "CONFIRMED"),
        (2026, None, 1.0, "CONFIRMED"), (None, 1.0, 1.0, "CANDIDATE"), (2000, None, None, "CANDIDATE"),
    ]
    df = spark.createDataFrame(given, "y int, m double, r double, want string")
    label = rules.quality_label(F.col("y"), F.col("m"), F.col("r"))
    assert all(r.want == r.got for r in df.select("want", label.alias("got")).collect())


def test_component_score(spark):
    given = [
        ("eW0t", "eW0t", 100), ("eW0t", "Ew0T", 100), ("eW0t", "eW0x", 75), ("eW0t", "xxxx", 0), ("eW0t", "W0t", 0),
        ("eW0t", "eW0tt", 0), ("W???", "w???", 100), ("eW0t", None, 0), ("abc", "abc", 0), ("wX??", "Wx!!", 50),
    ]
    df = spark.createDataFrame(given, "a string, b string, want int")
    there = rules.component_score(F.col("a"), F.col("b"))
    back = rules.component_score(F.col("b"), F.col("a"))
    for r in df.select("want", there.alias("there"), back.alias("back")).collect():
        assert r.there == r.back == r.want
        assert r.there in (0, 25, 50, 75, 100)


def test_clamp_pass_and_composites(spark):
    df = spark.createDataFrame([(0, "A", "x"), (11, "A", None), (7, "", "x"), (6, "A|B", None)], "s int, l string, c string")
    label, code = rules.split_label(F.col("joined"))
    got = (
        df.withColumn("joined", rules.join_label(F.col("l"), F.col("c")))
        .select("s", rules.scaled_score(F.col("s")), rules.pass_fail(F.col("s"), 7), "joined", label, code)
        .orderBy("s")
        .collect()
    )
    assert [tuple(r)[1:] for r in got] == [
        (10, "FAIL", "A|x", "A", "x"),
        (60, "FAIL", "A|B", "A", "B"),
        (70, "PASS", "|x", "", "x"),
        (100, "PASS", "A", "A", None),
    ]


def test_code_count_must_fit(spark):
    with pytest.raises(ValueError):
        rules.threshold_code(F.lit(1.0), (1.0, 2.0), "ab")
