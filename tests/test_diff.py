import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import plan_of, rows
from snapgrade.operators import checks, dedupe, diff, dims

SCHEMA = "k string, a int, b string, c double"
FIELDS = ["a", "b", "c"]


def frame(spark, data, schema=SCHEMA):
    return spark.createDataFrame(data, schema)


@pytest.fixture
def sides(spark):
    stored = frame(spark, [("same", 1, "x", 1.5), ("num", 1, "x", 1.5), ("null", 1, "x", None), ("gone", 1, "x", 1.0), ("both", 1, None, 2.0)])
    incoming = frame(spark, [("same", 1, "x", 1.5), ("num", 2, "x", 1.5), ("null", 1, None, 5.0), ("new", 9, "z", None), ("both", 1, None, 2.0)])
    return stored, incoming


def test_change_rows(sides):
    got = rows(diff.snapshot_diff(*sides, ["k"], FIELDS))
    assert got == sorted(
        [
            ("new", "INSERT", None, None, None), ("gone", "DELETE", None, None, None), ("num", "UPDATE", "a", "1", "2"),
            ("null", "UPDATE", "b", "x", None), ("null", "UPDATE", "c", None, "5"),
        ],
        key=repr,
    )


def test_counts(sides):
    assert tuple(diff.diff_counts(*sides, ["k"], FIELDS).first()) == (1, 2, 1, 2)


def test_text_and_typed_compare_over_different_types(spark):
    stored, incoming = frame(spark, [("k", 5)], "k string, v int"), frame(spark, [("k", 5.0)], "k string, v double")
    assert rows(diff.snapshot_diff(stored, incoming, ["k"], ["v"])) == []
    assert rows(diff.snapshot_diff(stored, incoming, ["k"], ["v"], compare="typed")) == []
    text = frame(spark, [("k", "05")], "k string, v string")
    assert len(rows(diff.snapshot_diff(stored, text, ["k"], ["v"]))) == 1
    assert rows(diff.snapshot_diff(stored, text, ["k"], ["v"], compare="typed")) == []
    with pytest.raises(ValueError):
        diff.snapshot_diff(stored, text, ["k"], ["v"], compare="other")


def test_scale(spark):
    stored, incoming = frame(spark, [("k", 0.333333)], "k string, v double"), frame(spark, [("k", 1 / 3)], "k string, v double")
    assert len(rows(diff.snapshot_diff(stored, incoming, ["k"], ["v"]))) == 1
    assert rows(diff.snapshot_diff(stored, incoming, ["k"], ["v"], scale=(20, 6))) == []


def test_delete_reported_once(spark, sides):
    known = frame(spark, [("gone",), ("num",)], "k string")
    got = rows(diff.snapshot_diff(*sides, ["k"], FIELDS, reported_deletes=known))
    assert "DELETE" not in {r[1] for r in got} and len(got) == 4


def test_apply_keeps_other_columns_and_stamps(spark, sides):
    stored, incoming = sides
    stored = stored.withColumns({"label": F.lit("L"), "created": F.lit(1), "updated": F.lit(1)})
    got = {r.k: r for r in diff.apply_snapshot(stored, incoming, ["k"], FIELDS, now=F.lit(2), created="created", updated="updated").collect()}
    assert set(got) == {"same", "num", "null", "gone", "both", "new"}
    assert (got["num"].a, got["num"].label, got["num"].created, got["num"].updated) == (2, "L", 1, 2)
    assert (got["new"].label, got["new"].created, got["new"].updated) == (None, 2, 2)
    assert got["same"].updated == got["gone"].updated == 1
    assert "gone" not in {r.k for r in diff.apply_snapshot(stored, incoming, ["k"], FIELDS, delete_mode="drop").collect()}


entries = st.lists(
    st.tuples(
        st.sampled_from("pqrstu"), st.one_of(st.none(), st.integers(-2, 2)), st.one_of(st.none(), st.sampled_from("xy")),
        st.one_of(st.none(), st.sampled_from([0.5, 1.0, 2.25])),
    ),
    max_size=6,
    unique_by=lambda r: r[0],
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=entries, b=entries)
def test_diff_properties(spark, a, b):
    left, right = frame(spark, a), frame(spark, b)
    assert rows(diff.snapshot_diff(left, left, ["k"], FIELDS)) == []
    applied = diff.apply_snapshot(left, right, ["k"], FIELDS)
    again = rows(diff.snapshot_diff(applied, right, ["k"], FIELDS))
    assert {r[1] for r in again} <= {"DELETE"}
    new, updated, deleted, unchanged = diff.diff_counts(left, right, ["k"], FIELDS).first()
    assert new + updated + unchanged == len(b) and deleted == len({r[0] for r in a} - {r[0] for r in b})


def test_cleaning_and_first_row(spark):
    data = [(2, "\tp "), (1, "p"), (3, None), (4, " \n"), (5, "q ")]
    df = frame(spark, data, "i int, k string")
    cleaned = dedupe.clean_keys(df, ["k"])
    assert rows(cleaned) == [(1, "p"), (2, "p"), (5, "q")]
    assert rows(dedupe.first_per_key(cleaned, ["k"], ["i"])) == [(1, "p"), (5, "q")]


def test_hot_key_is_limited_before_the_exchange(spark):
    plan = plan_of(dedupe.first_per_key(spark.range(1000).selectExpr("id % 3 as k", "id"), ["k"], ["id"]))
    assert plan.count("WindowGroupLimit") == 2


def test_diff_plan_has_one_join_and_no_single_partition(spark, sides):
    plan = plan_of(diff.snapshot_diff(*sides, ["k"], FIELDS))
    assert plan.count("Join") == 1
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_anti_existing_and_difference(spark):
    new = frame(spark, [(1, "a"), (2, "a"), (3, "b"), (4, "c")], "i int, k string")
    stored = frame(spark, [("b",), ("z",)], "k string")
    assert [r[1:] for r in [(None, 1, "a"), (None, 4, "c")]] == [
        (r.i, r.k) for r in dedupe.anti_existing(new, stored, ["k"], ["i"]).orderBy("i").collect()
    ]
    assert rows(dedupe.key_difference(stored, new, ["k"])) == [("z",)]


LAYOUT = dims.SnapshotLayout(
    planet_key="planet_name", host_key="host_star", order=["row"], planet_fields=["mass"],
    system_fields={"distance": "distance_parsecs"}, star_fields={"temp": "temperature_k"},
)


def test_normalise_first_writer_wins(spark):
    flat = frame(
        spark,
        [(1, "p1", "s1", 1.0, 10.0, 5.0), (2, "p2", " s1", 2.0, 11.0, 6.0), (3, "p3", "old", 3.0, 12.0, 7.0),
         (4, "p0", "s9", 4.0, 13.0, 8.0), (5, "p1 ", "s8", 9.0, 9.0, 9.0), (6, "p4", " ", 1.0, 1.0, 1.0)],
        "row int, planet_name string, host_star string, mass double, distance double, temp double",
    )
    stars = frame(spark, [("old", 77, 66)], "name string, id long, solar_system_id long")
    planets = frame(spark, [("p0",)], "planet_name string")
    links = frame(spark, [], "planet_id long, star_id long")
    new = dims.normalise_snapshot(dims.clean_snapshot(flat, LAYOUT), LAYOUT, stars, planets, links)
    # a host seen only with a stored planet gets a star, but no link; the second p1 is dropped
    assert {r.name for r in new.stars.collect()} == {"s1", "s9"}
    assert {(r.name, r.distance_parsecs, r.temperature_k) for r in dims.star_with_system(new.stars, new.systems).collect()} == {
        ("s1", 10.0, 5.0), ("s9", 13.0, 8.0),
    }
    ids = {r.planet_name: (r.id, r.solar_system_id) for r in new.planets.collect()}
    assert set(ids) == {"p1", "p2", "p3"} and ids["p3"][1] == 66
    link = {r.planet_id: r.star_id for r in new.links.collect()}
    assert len(link) == 3 and link[ids["p3"][0]] == 77 and link[ids["p1"][0]] == link[ids["p2"][0]]


def test_checks(spark):
    df = frame(spark, [("a", 1), ("a", None), (None, 3)], "k string, v int")
    assert rows(checks.duplicate_keys(df, ["k"])) == [("a", 2)]
    with pytest.raises(ValueError):
        checks.require_unique(df, ["k"])
    assert checks.require_unique(df, ["v"]) is df
    assert rows(checks.null_counts(df, ["k", "v"])) == [("not_null", "k", 1), ("not_null", "v", 1)]
    assert rows(checks.too_long(df, {"k": 0})) == [("max_length", "k", 2)]
    parent = frame(spark, [(1,)], "id int")
    assert rows(checks.orphans(df, "v", parent, "id")) == [(3, 1)]
    assert rows(checks.outside_domain(df, "k", ["b"])) == [("a", 2)]
    vectors = frame(spark, [([1.0],), ([1.0, 2.0],)], "e array<float>")
    assert tuple(checks.vector_widths(vectors, "e").first()) == (1, 2, False)


def test_links_by_group_are_those_of_the_listed_links(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1), (3, 1), (4, 9), (None, 1), (5, 3)], "planet_id int, star_id int")
    planets = spark.createDataFrame([(1, 7), (2, 8), (2, 7), (3, None), (5, 8)], "planet_id int, g int")
    stars = spark.createDataFrame([(1, 7), (1, 7), (2, 8), (3, 8), (9, None)], "star_id int, g int")
    found = dims.link_once_by_group(pairs, planets, stars, "g")
    assert rows(found) == rows(dims.link_once(pairs, planets.join(stars, "g").select("planet_id", "star_id")))
    assert rows(found) == sorted([(1, 2), (3, 1), (4, 9), (None, 1)], key=repr)
