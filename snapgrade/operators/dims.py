"""Splitting flat snapshot rows into system, star, planet and link tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from snapgrade.operators.dedupe import anti_existing, clean_keys, first_per_key
from snapgrade.session import materialise


REPORT_PLANETS = 10_000  # bound of a report, whose planets are broadcast


def surrogate_id(kind: str, *parts: str) -> Column:
    """64-bit id from the natural key: the same on every run and without a sequence."""
    return F.xxhash64(F.lit(kind), *[F.col(p) for p in parts])


def get_or_create(
    candidates: DataFrame, stored: DataFrame, keys: Sequence[str], order: Sequence[Column | str]
) -> DataFrame:
    """Rows to append to a dimension. The first writer wins: stored rows are never changed."""
    return anti_existing(candidates, stored, keys, order)


@dataclass(frozen=True)
class SnapshotLayout:
    """Which flat columns make up which table."""

    planet_key: str
    host_key: str
    order: Sequence[str]
    planet_fields: Sequence[str]
    system_fields: Mapping[str, str]
    star_fields: Mapping[str, str]


@dataclass(frozen=True)
class NewRows:
    systems: DataFrame
    stars: DataFrame
    planets: DataFrame
    links: DataFrame


def clean_snapshot(flat: DataFrame, layout: SnapshotLayout) -> DataFrame:
    cleaned = clean_keys(flat, [layout.planet_key, layout.host_key])
    return first_per_key(cleaned, [layout.planet_key], list(layout.order))


def normalise_snapshot(
    snapshot: DataFrame,
    layout: SnapshotLayout,
    stored_stars: DataFrame,
    stored_planets: DataFrame,
    stored_links: DataFrame,
) -> NewRows:
    """Rows to append to the four tables for a cleaned snapshot.

    ``stored_stars(name, id, solar_system_id)``, ``stored_planets(planet_name, …)``,
    ``stored_links(planet_id, star_id)``. A system is found through its star's name. Links are
    made for new planets only. Star rows are one per host, so a host with very many planets
    is reduced before the join with the stored stars; the planets' own join with the host's
    ids has one row per host on the right side. The hosts' ids and the new planets feed several
    of the four tables and are written once.
    """
    host, planet = layout.host_key, layout.planet_key
    hosts = first_per_key(
        snapshot.select(
            F.col(host).alias("name"), *layout.order, *layout.system_fields, *layout.star_fields
        ),
        ["name"],
        list(layout.order),
    )
    known = stored_stars.select(
        "name", F.col("id").alias("_star_id"), F.col("solar_system_id").alias("_system_id")
    )
    ids = materialise(
        hosts.join(known, "name", "left").select(
            hosts["*"],
            F.col("_star_id").isNull().alias("is_new"),
            F.coalesce("_star_id", surrogate_id("star", "name")).alias("star_id"),
            F.coalesce("_system_id", surrogate_id("system", "name")).alias("system_id"),
        ),
        "hosts",
    )
    new_hosts = ids.filter("is_new")
    systems = new_hosts.select(
        F.col("system_id").alias("id"), *[F.col(c).alias(n) for c, n in layout.system_fields.items()]
    )
    stars = new_hosts.select(
        F.col("star_id").alias("id"),
        F.col("system_id").alias("solar_system_id"),
        "name",
        *[F.col(c).alias(n) for c, n in layout.star_fields.items()],
    )
    new_planets = materialise(
        snapshot.join(stored_planets.select(F.col("planet_name").alias(planet)), planet, "left_anti")
        .join(ids.select(F.col("name").alias(host), "star_id", "system_id"), host)
        .select(
            surrogate_id("planet", planet).alias("id"),
            F.col("system_id").alias("solar_system_id"),
            F.col(planet).alias("planet_name"),
            *layout.planet_fields,
            "star_id",
        ),
        "new-planets",
    )
    links = link_once(new_planets.select(F.col("id").alias("planet_id"), "star_id"), stored_links)
    return NewRows(systems, stars, new_planets.drop("star_id"), links)


def link_once(pairs: DataFrame, stored_links: DataFrame) -> DataFrame:
    """Pairs that are not linked yet."""
    return anti_existing(pairs.distinct(), stored_links, ["planet_id", "star_id"])


def link_once_by_group(pairs: DataFrame, planets: DataFrame, stars: DataFrame, group: str) -> DataFrame:
    """Pairs that are not linked yet, where every planet is linked with every star of its group.

    ``planets(planet_id, group)``, ``stars(star_id, group)``; a null group links nothing. The links of a group
    grow with the product of its sides, so they are not listed: each pair is looked up, in work that grows with
    the pairs and the two sides.
    """
    asked = materialise(pairs.distinct(), "pairs")
    grouped = asked.join(planets.select("planet_id", group).distinct(), "planet_id")
    linked = grouped.join(stars.select("star_id", group).distinct(), ["star_id", group], "left_semi")
    return link_once(asked, linked.select("planet_id", "star_id"))


def star_with_system(stars: DataFrame, systems: DataFrame) -> DataFrame:
    """Every star with its system's columns."""
    renamed = systems.select(
        F.col("id").alias("solar_system_id"), *[c for c in systems.columns if c != "id"]
    )
    return stars.join(renamed, "solar_system_id")


def labelled_change_report(
    planets: DataFrame,
    links: DataFrame,
    stars: DataFrame,
    changes: DataFrame,
    *,
    limit: int = 30,
    order: Sequence[str] = ("planet_name", "detected_at"),
) -> DataFrame:
    """Labelled planets with host and change rows, the first ``limit`` by name, then time.

    Every planet with a host and a change gives at least one row and names come first in the
    order, so the ``limit`` lowest such planets hold the whole result. They are found with semi
    joins over key columns; the wide rows then meet only these (``limit`` rows, at most
    ``REPORT_PLANETS``) as a broadcast, all in one plan. A planet may have very many hosts, so how these
    meet the change rows is left to Spark.
    """
    if order[0] != "planet_name":
        raise ValueError("the report is ordered by planet_name first")
    if not 0 < limit <= REPORT_PLANETS:
        raise ValueError(f"limit must be between 1 and {REPORT_PLANETS}")
    hosts = stars.select(F.col("id").alias("star_id"), F.col("name").alias("host_star"))
    hosted = links.join(hosts.select("star_id"), "star_id", "left_semi").select(F.col("planet_id").alias("id"))
    lowest = (
        planets.filter(F.col("classification").isNotNull())
        .join(hosted, "id", "left_semi")
        .join(changes.select("planet_name"), "planet_name", "left_semi")
        .orderBy("planet_name")
        .limit(limit)
    )
    wanted = lowest.select(F.col("id").alias("planet_id"), *[c for c in lowest.columns if c != "id"])
    placed = links.select("planet_id", "star_id").join(F.broadcast(wanted), "planet_id").join(hosts, "star_id")
    first = placed.withColumn("id", F.col("planet_id"))
    return (
        changes.join(first, "planet_name")
        .select(*changes.columns, *[c for c in planets.columns if c != "planet_name"], "planet_id", "star_id", "host_star")
        .orderBy(*order)
        .limit(limit)
    )
