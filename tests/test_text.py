import decimal
import random
import struct

import pytest
from pyspark.sql import functions as F

from snapgrade.functions import text
from snapgrade.functions.vectors import cosine_similarity, text_to_vector, vector_to_text


def one(spark, value, dtype, expression):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(expression(F.col("v"))).first()[0]


def test_number_text(spark):
    given = {
        5.0: "5", 5.25: "5.25", -3.5: "-3.5", 0.0: "0", 0.1: "0.1", 1e-4: "0.0001", 1e-5: "1E-05", 1.5e-7: "1.5E-07",
        1e7: "10000000", 12345678.9: "12345678.9", 1e14: "100000000000000", 1e15: "1E+15", 1e16: "1E+16",
        1.2345678901234568e17: "1.2345678901234568E+17", 1e100: "1E+100", 0.1 + 0.2: "0.30000000000000004",
        1.2345678901234567e-4: "0.00012345678901234567", 100.0: "100",
    }
    df = spark.createDataFrame([(k, v) for k, v in given.items()], "v double, want string")
    for r in df.select("want", text.num_to_text(F.col("v")).alias("got")).collect():
        assert r.got == r.want
    assert one(spark, float("nan"), "double", text.num_to_text) == "NaN"
    assert one(spark, None, "double", text.num_to_text) is None


def exact_fixed(x: float, decimals: int) -> str:
    """The binary value, rounded half away from zero."""
    step = decimal.Decimal(1).scaleb(-decimals)
    with decimal.localcontext() as context:
        context.prec = 60
        return str(decimal.Decimal(x).quantize(step, rounding=decimal.ROUND_HALF_UP))


@pytest.mark.parametrize("decimals", [0, 2, 3])
def test_fixed_matches_exact_rounding(spark, decimals):
    rng = random.Random(7)
    values = [1.005, 2.125, 2.675, 0.825, 2.5, 0.5, 1.5, 0.0, -1.005, -2.125, 999.995, 0.0005, 0.001, 123456789.125]
    values += [rng.randrange(10**6) / 1000 for _ in range(2000)]
    values += [rng.uniform(-1e6, 1e6) for _ in range(500)]
    values += [struct.unpack("d", struct.pack("q", struct.unpack("q", struct.pack("d", v))[0] - 1))[0] for v in (2.125, 0.375, 7.5)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", text.fixed(F.col("v"), decimals).alias("got")).collect():
        assert r.got == exact_fixed(r.v, decimals), r.v


def test_fixed_edges(spark):
    assert one(spark, None, "double", lambda c: text.fixed_or(c, 2)) == "?"
    assert one(spark, float("nan"), "double", lambda c: text.fixed(c, 2)) == "NaN"
    assert one(spark, 1e15, "double", lambda c: text.fixed(c, 2)) == "1000000000000000.00"
    assert one(spark, -0.001, "double", lambda c: text.fixed(c, 2)) == "-0.00"


def test_trim_covers_all_white_space(spark):
    assert one(spark, "\t   x y　\n", "string", text.trim_all) == "x y"
    assert one(spark, "  \t", "string", text.is_blank) is True
    assert one(spark, None, "string", text.is_blank) is True
    assert one(spark, None, "string", lambda c: text.equals_ignore_case(c, "x")) is False


def test_strip_fences(spark):
    cases = {"```json\n[1]\n```": "[1]", "```\n[1]```\n": "[1]", " [1] ": "[1]", "a ``` b": "a ``` b", "": ""}
    for given, want in cases.items():
        assert one(spark, given, "string", text.strip_fences) == want


def test_content_text_leaves_out_missing_parts(spark):
    df = spark.createDataFrame([("n", "r", "", None, 2.0), ("n", "r", "Transit", 1.0, None)], "a string, b string, m string, x double, t double")
    line = text.content_text(
        F.col("a"), F.col("b"), F.col("m"), [("mass", F.col("x"), 2, "Earth masses"), ("temp", F.col("t"), 0, "K")]
    )
    assert [r[0] for r in df.select(line).collect()] == [
        "n, r, temp=2 K", "n, r, discovered via Transit, mass=1.00 Earth masses",
    ]


def test_preview_and_question(spark):
    assert one(spark, "x" * 120, "string", text.preview) == "x" * 120
    assert one(spark, "x" * 121, "string", text.preview) == "x" * 120 + "..."
    assert one(spark, "b", "string", lambda c: text.question_text(c, "a {name} c")) == "a b c"


def test_vectors(spark):
    assert one(spark, [1.0, 0.5], "array<float>", vector_to_text) == "[1.0,0.5]"
    assert one(spark, "[1.0,0.5]", "string", text_to_vector) == [1.0, 0.5]
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(cosine_similarity(F.col("a"), F.col("b"))).collect()] == [pytest.approx(0.96), None]
