"""Entities: identity of players, canonical venues, style backfill. Maps are inputs, not part of the code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def known_uuids(seen: DataFrame) -> DataFrame:
    """(name, known): the uuid of each name that was ever seen with one; the smallest of several."""
    return seen.where("uuid is not null and name is not null").groupBy("name").agg(F.min("uuid").alias("known"))


def resolve_keys(facts: DataFrame, seen: DataFrame, columns: list[str]) -> DataFrame:
    """facts whose keys are uuids wherever the player was ever seen with one, also in a later ingest than the fact.

    A document's ball has the name as key where its own registry has no uuid. Facts stay as they were written; what is
    known of the names is joined when they are read, so the order of ingests tells nothing. As in ``resolve_players``.
    """
    known = known_uuids(seen)
    for c in columns:
        facts = facts.join(known.select(F.col("name").alias(c), F.col("known").alias("_uuid")), c, "left").withColumn(c, F.coalesce("_uuid", c)).select(facts.columns)
    return facts


def resolve_players(seen: DataFrame, by_name: bool = False) -> DataFrame:
    """(uuid, name) sightings to one player each: the uuid where there is one, else the name.

    A name without uuid takes the uuid that the name has elsewhere. by_name joins all uuids of a name in one player.
    """
    known = known_uuids(seen)
    d = seen.select("uuid", "name").distinct().join(known, "name", "left")
    key = F.coalesce("known", "name") if by_name else F.coalesce("uuid", "known", "name")
    return d.select(key.alias("player_key"), "uuid", "name")


def apply_redirects(facts: DataFrame, key: str, redirects: DataFrame) -> DataFrame:
    """facts with key replaced by its canonical id; redirects (old_id, canonical_id) has a row per old id."""
    r = redirects.select(F.col("old_id").alias(key), F.col("canonical_id").alias("_to"))
    return facts.join(r, key, "left").withColumn(key, F.coalesce("_to", key)).drop("_to").select(facts.columns)


def dedup_venues(venues: DataFrame, redirects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(venues that stay, with canonical names; redirects that apply). Redirects from or to ids that do not exist, and
    to themselves, are ignored; a canonical_name that is null keeps the old name."""
    ids = venues.select("venue_id")
    valid = redirects.where("old_id <> canonical_id").join(ids.withColumnRenamed("venue_id", "old_id"), "old_id", "left_semi").join(ids.withColumnRenamed("venue_id", "canonical_id"), "canonical_id", "left_semi")
    names = redirects.where("canonical_name is not null").groupBy(F.col("canonical_id").alias("venue_id")).agg(F.max("canonical_name").alias("_name"))
    stay = venues.join(valid.select(F.col("old_id").alias("venue_id")), "venue_id", "left_anti").join(names, "venue_id", "left")
    return stay.withColumn("venue", F.coalesce("_name", "venue")).drop("_name"), valid.select("old_id", "canonical_id")


def backfill_styles(players: DataFrame, codes: DataFrame, labels: dict[str, str]) -> DataFrame:
    """players with bowling_style from (uuid, style_code); the last code of a uuid wins, unknown codes change nothing."""
    label = F.element_at(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)), F.col("style_code"))
    one = codes.groupBy("uuid").agg(F.max_by("style_code", "position").alias("style_code")).select("uuid", label.alias("_style"))
    return players.join(one, "uuid", "left").withColumn("bowling_style", F.coalesce("_style", "bowling_style")).drop("_style").select(players.columns)


def style_coverage(deliveries: DataFrame, styles: DataFrame) -> DataFrame:
    """Balls, balls of bowlers with a known style, and the share in whole percent."""
    d = deliveries.select("bowler_id").join(styles, "bowler_id", "left")
    d = d.agg(F.count("*").alias("balls"), F.count("style").alias("styled"))
    return d.withColumn("coverage_pct", F.floor(F.col("styled") * 100 / F.greatest(F.col("balls"), F.lit(1))).cast("long"))
