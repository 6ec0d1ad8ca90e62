"""Serving documents: nested rows of matches, venues and players."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_profiles(matches: DataFrame, teams: DataFrame, venues: DataFrame) -> DataFrame:
    """Matches with the names of both teams, toss winner, winner and venue; small dimensions are broadcast."""
    d = matches
    for role in ("team1", "team2", "toss_winner", "winner"):
        t = teams.select(F.col("team_id").alias(f"{role}_id"), F.col("team").alias(role))
        d = d.join(F.broadcast(t), f"{role}_id", "left")
    return d.join(F.broadcast(venues.select("venue_id", "venue")), "venue_id", "left").withColumn("played_at", F.col("match_date").cast("timestamp"))


def venue_profiles(venues: DataFrame, factors: DataFrame) -> DataFrame:
    f = factors.select(F.col("venue_id"), F.struct(*(c for c in factors.columns if c != "venue_id")).alias("difficulty"))
    return venues.join(f, "venue_id", "left")


def _nested(d: DataFrame, name: str, key: str = "player_id") -> DataFrame:
    """One row per player with an ordered list of the other columns; a player's rows are few (one per split key)."""
    fields = [c for c in d.columns if c != key]
    return d.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))


def player_profiles(career_bat: DataFrame, career_bowl: DataFrame, ratings: DataFrame, milestones: DataFrame, venue_bat: DataFrame, opponents: DataFrame, positions: DataFrame, least_at_venue: int = 3) -> DataFrame:
    """One document per player: careers, ratings, counts of milestones and splits; venues from three innings on."""
    counts = milestones.groupBy("player_id", "milestone").agg(F.count("*").alias("n")).groupBy("player_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("milestone", "n")))).alias("milestones"))
    rated = ratings.select("player_id", F.struct(*(c for c in ratings.columns if c != "player_id")).alias("ratings"))
    career = lambda d: d.select("player_id", "tournament", "innings", "runs", "average")
    parts = [
        _nested(career(career_bat), "batting"),
        _nested(career(career_bowl), "bowling"),
        rated,
        counts,
        _nested(venue_bat.where(F.col("innings") >= least_at_venue).select("player_id", "venue_id", "innings", "runs"), "venues"),
        _nested(opponents.select("player_id", "opponent_id", "bat_runs", "bowl_wickets"), "opponents"),
        _nested(positions.select("player_id", "batting_position", "innings", "runs"), "positions"),
    ]
    return reduce(lambda a, b: a.join(b, "player_id", "full"), parts)


def without_nulls(d: DataFrame) -> DataFrame:
    """Each row as JSON without its null fields."""
    return d.select(F.to_json(F.struct(*d.columns), {"ignoreNullFields": "true"}).alias("document"))
