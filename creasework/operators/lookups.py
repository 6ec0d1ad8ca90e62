"""Searches, leaderboards, set operations and audits over the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def search(players: DataFrame, text: str, n: int = 20) -> DataFrame:
    """Names that hold the text, in any case; the text is taken literally."""
    return players.where(F.contains(F.lower("name"), F.lit(text.lower()))).orderBy("name").limit(n)


def venue_like(venues: DataFrame, pattern: str) -> DataFrame:
    return venues.where(F.col("venue").like(pattern))


def leaderboard(ratings: DataFrame, by: str = "overall_rating", n: int = 20) -> DataFrame:
    top = ratings.orderBy(F.desc_nulls_last(by), "player_id").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last(by), "player_id")))


def explore(players: DataFrame, least_innings: int = 0, country: str | None = None, styles: DataFrame | None = None, style: str | None = None, strong: bool | None = None, by: str = "bat_rating", n: int = 200, name: str | None = None, role: str | None = None, ascending: bool = False) -> DataFrame:
    """Players by name (part of it, in any case), country, role, innings and strike rate against a style (130 or more if
    strong, 100 or less if not).

    Bowlers need no innings as batters and are ordered by bowl_rating, where another order is not asked for.
    """
    bowlers = role == "Bowler"
    d = players if bowlers else players.where(F.coalesce("innings", F.lit(0)) >= least_innings)
    d = d.where(F.contains(F.lower("name"), F.lit(name.lower()))) if name else d
    d = d.where(F.col("country") == country) if country else d
    d = d.where(F.col("role") == role) if role else d
    if styles is not None and strong is not None:
        met = styles.where((F.col("style") == style) & (F.col("strike_rate") >= 130 if strong else F.col("strike_rate") <= 100))
        d = d.join(met.select(F.col("batter_id").alias("player_id")), "player_id", "left_semi")
    by = "bowl_rating" if bowlers and by == "bat_rating" else by
    return d.orderBy(F.asc_nulls_last(by) if ascending else F.desc_nulls_last(by), "player_id").limit(n)


def venue_filter(venues: DataFrame, **wanted: str | None) -> DataFrame:
    """Venues with the wanted values (country=.., city=.., pitch_type=.., operational_status=..); None leaves a facet open."""
    for column, value in wanted.items():
        venues = venues.where(F.col(column) == value) if value is not None else venues
    return venues


def venue_facets(venues: DataFrame, facets: tuple[str, ...] = ("country", "city", "pitch_type", "operational_status")) -> DataFrame:
    """(facet, value, venues): the values that each facet can take, in one pass."""
    long = venues.select(F.explode(F.array(*(F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets))).alias("x")).select("x.*")
    return long.where("value is not null").groupBy("facet", "value").agg(F.count("*").alias("venues")).orderBy("facet", "value")


def venue_extremes(factors: DataFrame, by: str = "bat_factor", n: int = 8) -> DataFrame:
    known = factors.where(F.col(by).isNotNull())
    high = known.orderBy(F.desc(by), "venue_id").limit(n).withColumn("list", F.lit("highest"))
    return high.union(known.orderBy(F.asc(by), "venue_id").limit(n).withColumn("list", F.lit("lowest")))


def venue_top_batters(split: DataFrame, venue: int, least: int = 3, n: int = 15) -> DataFrame:
    return split.where((F.col("venue_id") == venue) & (F.col("innings") >= least)).orderBy(F.desc_nulls_last("average"), "player_id").limit(n)


def venue_top_bowlers(split: DataFrame, venue: int, least: int = 3, n: int = 15) -> DataFrame:
    return split.where((F.col("venue_id") == venue) & (F.col("innings") >= least)).orderBy(F.asc_nulls_last("economy"), "player_id").limit(n)


def team_ids(matches: DataFrame, tournament: str | None = None) -> DataFrame:
    m = matches.where(F.col("tournament") == tournament) if tournament else matches
    return m.select(F.col("team1_id").alias("team_id")).union(m.select("team2_id")).where("team_id is not null").distinct()


def opponents_of_kind(split: DataFrame, countries: DataFrame, inside: bool = True) -> DataFrame:
    """Rows whose opponent is (or is not) among the teams; a null opponent is in neither."""
    keys = countries.select(F.col("team_id").alias("opponent_id"))
    return split.where("opponent_id is not null").join(keys, "opponent_id", "left_semi" if inside else "left_anti")


def shared_venues(split: DataFrame, a: int, b: int) -> DataFrame:
    side = lambda p, s: split.where(F.col("player_id") == p).select("venue_id", F.col("innings").alias(f"innings_{s}"), F.col("average").alias(f"average_{s}"), F.col("strike_rate").alias(f"strike_rate_{s}"))
    return side(a, "a").join(side(b, "b"), "venue_id")


def missing_ids(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Ids of wanted that present does not have, without repeats (both have the column id)."""
    return wanted.select("id").distinct().join(present.select("id"), "id", "left_anti")


def coverage(matches: DataFrame) -> DataFrame:
    d = matches.groupBy("tournament").agg(F.count("*").alias("matches"), F.min("match_date").alias("first_date"), F.max("match_date").alias("last_date"), F.countDistinct("venue_id").alias("venues"), F.countDistinct("team1_id").alias("teams"))
    total = matches.agg(F.count("*").alias("total"))
    return d.crossJoin(F.broadcast(total)).withColumn("share_pct", F.round(F.col("matches") * 100.0 / F.col("total"), 2)).drop("total")


def matches_per_year(matches: DataFrame) -> DataFrame:
    return matches.groupBy(F.year("match_date").alias("year")).agg(F.count("*").alias("matches"))


def audit(tables: dict[str, DataFrame], low: int = 50) -> DataFrame:
    """Row count and status of each table."""
    one = [t.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, t in tables.items()]
    status = F.when(F.col("n_rows") == 0, "Empty").when(F.col("n_rows") < low, "Low").otherwise("OK")
    return reduce(DataFrame.union, one).withColumn("status", status)


def value_counts(d: DataFrame, column: str) -> DataFrame:
    return d.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def sample_and_count(tables: dict[str, DataFrame], n: int = 5) -> dict[str, tuple[DataFrame, int]]:
    """The first rows and the row count of each table, for a look at a store."""
    return {name: (t.limit(n), t.count()) for name, t in tables.items()}
