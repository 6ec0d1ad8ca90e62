"""Careers and splits: one aggregation each over the innings facts, total rows by grouping sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from creasework import config as C
from creasework.functions import exprs as X
from creasework.operators import balls

ALL = "ALL"
_MATCH = ["match_id", "tournament", "season", "venue_id", "match_date", "team1_id", "team2_id", "winner_id"]


def batting_facts(batter_innings: DataFrame, matches: DataFrame, innings: DataFrame) -> DataFrame:
    """Batter innings with their match, team, opponent and chase situation."""
    chase = innings.select("match_id", "innings_id", F.struct("required_rr_start", "chase_successful").alias("_chase"))
    b = balls.beside_match(batter_innings.join(matches.select(*_MATCH), "match_id"), chase, ["innings_id"], "_chase").where("_chase is not null")
    b = b.withColumns({"required_rr_start": F.col("_chase.required_rr_start"), "chase_successful": F.col("_chase.chase_successful")}).drop("_chase")
    first = F.col("innings_number") == 1
    return b.withColumns(
        {
            "team_id": F.when(first, F.col("team1_id")).otherwise(F.col("team2_id")),
            "opponent_id": F.when(first, F.col("team2_id")).otherwise(F.col("team1_id")),
            "is_chase": F.col("innings_number") == 2,
            "chase_won": F.coalesce("chase_successful", F.lit(False)),
            "player_id": F.col("batter_id"),
        }
    ).drop("chase_successful", "batter_id")


def bowling_facts(bowler_innings: DataFrame, matches: DataFrame) -> DataFrame:
    b = bowler_innings.join(matches.select(*_MATCH), "match_id")
    first = F.col("innings_number") == 1
    return b.withColumns({"team_id": F.when(first, F.col("team2_id")).otherwise(F.col("team1_id")), "opponent_id": F.when(first, F.col("team1_id")).otherwise(F.col("team2_id")), "player_id": F.col("bowler_id")}).drop("bowler_id")


def with_factor(facts: DataFrame, venue_factors: DataFrame) -> DataFrame:
    """The venue's batting factor, 1 where it has none."""
    return facts.join(F.broadcast(venue_factors.select("venue_id", F.col("bat_factor").alias("factor"))), "venue_id", "left").withColumn("factor", F.coalesce("factor", F.lit(1.0)))


def with_total(facts: DataFrame, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Rows per player and tournament, and per player over all (tournament ALL); null tournaments count in ALL only."""
    known = F.coalesce("tournament", F.lit("\0"))
    g = facts.withColumn("tournament", known).groupingSets([[*keys], [*keys, "tournament"]], *keys, "tournament").agg(*aggregates, F.grouping("tournament").alias("_all"))
    return g.withColumn("tournament", F.when(F.col("_all") == 1, F.lit(ALL)).otherwise(F.col("tournament"))).where("tournament <> '\\0'").drop("_all")


def batting_sums() -> list[Column]:
    return [
        F.count("*").alias("innings"),
        X.count_if(F.col("not_out")).alias("not_outs"),
        F.sum("runs").alias("runs"),
        F.sum("balls_faced").alias("balls"),
        F.max("runs").alias("highest"),
        X.count_if(F.col("runs").between(50, 99)).alias("fifties"),
        X.count_if(F.col("runs") >= 100).alias("hundreds"),
        X.count_if((F.col("runs") == 0) & ~F.col("not_out")).alias("ducks"),
    ]


def bowling_sums() -> list[Column]:
    return [F.count("*").alias("innings"), F.sum("balls_bowled").alias("balls"), F.sum("runs_conceded").alias("runs"), F.sum("wickets").alias("wickets")]


def _averages(d: DataFrame) -> DataFrame:
    return d.withColumn("average", X.ratio("runs", F.col("innings") - F.col("not_outs"))).withColumn("strike_rate", X.ratio("runs", "balls", 100))


def career_batting(batting: DataFrame, venue_factors: DataFrame) -> DataFrame:
    phases = [F.sum(f"{p}_{w}").alias(f"{p}_{w}") for p in ("pp", "mid", "death") for w in ("runs", "balls")]
    more = [F.median("runs").alias("median_runs"), X.count_if(F.col("runs").between(30, 49)).alias("thirties"), X.count_if(F.col("batting_position") <= 2).alias("times_opened"), F.sum(X.round_even(F.col("runs") / F.col("factor"), 6).cast("decimal(20,6)")).alias("adj_runs")]
    d = _averages(with_total(with_factor(batting, venue_factors), ["player_id"], [*batting_sums(), F.sum("fours").alias("fours"), F.sum("sixes").alias("sixes"), *phases, *more]))
    d = d.withColumn("adj_average", X.ratio(F.col("adj_runs").cast("double"), F.col("innings") - F.col("not_outs"))).withColumn("adj_strike_rate", F.col("strike_rate"))
    return d.withColumns({f"{p}_sr": X.ratio(f"{p}_runs", f"{p}_balls", 100) for p in ("pp", "mid", "death")}).drop("adj_runs")


def career_bowling(bowling: DataFrame, venue_factors: DataFrame) -> DataFrame:
    phases = [F.sum(f"{p}_{w}").alias(f"{p}_{w}") for p in ("pp", "mid", "death") for w in ("balls", "runs", "wickets")]
    more = [F.sum("dot_balls").alias("dots"), F.sum(X.round_even(F.col("runs_conceded") / F.col("factor"), 6).cast("decimal(20,6)")).alias("adj_runs")]
    d = with_total(with_factor(bowling, venue_factors), ["player_id"], [*bowling_sums(), *phases, *more])
    d = d.withColumns(
        {
            "economy": X.ratio("runs", "balls", 6),
            "average": X.ratio("runs", "wickets"),
            "strike_rate": X.ratio("balls", "wickets"),
            "dot_pct": X.ratio("dots", "balls", 100),
            "adj_economy": X.ratio(F.col("adj_runs").cast("double"), "balls", 6),
        }
    )
    return d.withColumns({f"{p}_economy": X.ratio(f"{p}_runs", f"{p}_balls", 6) for p in ("pp", "mid", "death")}).drop("adj_runs")


def chase_split(batting: DataFrame) -> DataFrame:
    hard = F.col("is_chase") & (F.col("required_rr_start") > C.HIGH_PRESSURE_RATE)
    d = batting.groupBy("player_id", "is_chase").agg(
        *batting_sums()[:4],
        X.count_if(hard).alias("hp_innings"),
        X.sum_if(hard, "runs").alias("hp_runs"),
        X.sum_if(hard, "balls_faced").alias("hp_balls"),
        X.count_if(F.col("is_chase") & F.col("not_out") & F.col("chase_won")).alias("finishes"),
    )
    d = _averages(d).withColumn("innings_type", F.when(F.col("is_chase"), "chase").otherwise("first")).withColumn("hp_sr", X.ratio("hp_runs", "hp_balls", 100))
    only = {c: F.when(F.col("is_chase"), F.col(c)) for c in ("hp_innings", "hp_sr", "finishes")}
    return d.withColumns(only).drop("is_chase", "hp_runs", "hp_balls")


def position_split(batting: DataFrame) -> DataFrame:
    phases = [F.sum(f"{p}_{w}").alias(f"{p}_{w}") for p in ("pp", "mid", "death") for w in ("runs", "balls")]
    d = _averages(batting.where(F.col("batting_position").between(1, 11)).groupBy("player_id", "batting_position").agg(*batting_sums()[:4], *phases))
    d = d.withColumns({f"{p}_sr": X.ratio(f"{p}_runs", f"{p}_balls", 100) for p in ("pp", "mid", "death")})
    return d.drop(*(f"{p}_{w}" for p in ("pp", "mid", "death") for w in ("runs", "balls")))


def venue_batting(batting: DataFrame) -> DataFrame:
    return _averages(batting.groupBy("player_id", "venue_id").agg(*batting_sums()[:5]))


def venue_bowling(bowling: DataFrame) -> DataFrame:
    d = bowling.groupBy("player_id", "venue_id").agg(*bowling_sums())
    return d.withColumn("economy", X.ratio("runs", "balls", 6)).withColumn("average", X.ratio("runs", "wickets"))


def with_result(facts: DataFrame) -> DataFrame:
    won = F.when(F.col("winner_id").isNull() | F.col("team_id").isNull(), "no_result").when(F.col("winner_id") == F.col("team_id"), "won").otherwise("lost")
    return facts.withColumn("result", won)


def both_sides(batting: DataFrame, bowling: DataFrame, keys: list[str], how: str = "full") -> DataFrame:
    """Batting and bowling bundles per player and keys; the side that is missing counts as zero."""
    bat = _averages(batting.dropna(subset=keys).groupBy("player_id", *keys).agg(*batting_sums()))
    bat = bat.select("player_id", *keys, *(F.col(c).alias(f"bat_{c}") for c in ("innings", "not_outs", "runs", "balls", "highest", "average", "strike_rate", "fifties", "hundreds", "ducks")))
    bowl = bowling.dropna(subset=keys).groupBy("player_id", *keys).agg(*bowling_sums()).withColumn("economy", X.ratio("runs", "balls", 6)).withColumn("average", X.ratio("runs", "wickets"))
    bowl = bowl.select("player_id", *keys, *(F.col(c).alias(f"bowl_{c}") for c in ("innings", "balls", "runs", "wickets", "economy", "average")))
    counts = ["bat_innings", "bat_not_outs", "bat_runs", "bat_balls", "bat_highest", "bat_fifties", "bat_hundreds", "bat_ducks", "bowl_innings", "bowl_balls", "bowl_runs", "bowl_wickets"]
    return bat.join(bowl, ["player_id", *keys], how).fillna(0, subset=counts)


def by_opponent(batting: DataFrame, bowling: DataFrame) -> DataFrame:
    return both_sides(batting, bowling, ["opponent_id"])


def by_team(batting: DataFrame, bowling: DataFrame) -> DataFrame:
    return both_sides(batting, bowling, ["team_id"])


def by_result(batting: DataFrame, bowling: DataFrame) -> DataFrame:
    return both_sides(with_result(batting), with_result(bowling), ["result"])


def by_season(batting: DataFrame, bowling: DataFrame) -> DataFrame:
    """Seasons in which the player batted, for each tournament and over all of them."""
    twice = lambda d: d.withColumn("tournament", F.explode(F.array(F.col("tournament"), F.lit(ALL))))
    return both_sides(twice(batting), twice(bowling), ["season", "tournament"], "left")


def _shares(counts: DataFrame) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy("player_id"))
    return counts.withColumn("pct", X.round_even(F.col("n") * 100.0 / total, 1))


def dismissals_batting(batting: DataFrame) -> DataFrame:
    out = batting.where(~F.col("not_out") & F.col("dismissal_kind").isNotNull())
    return _shares(out.groupBy("player_id", F.col("dismissal_kind").alias("kind")).agg(F.count("*").alias("n")))


def dismissals_bowling(deliveries: DataFrame) -> DataFrame:
    out = deliveries.where(F.col("bowler_wicket") & F.col("wicket_kind").isNotNull())
    return _shares(out.groupBy(F.col("bowler_id").alias("player_id"), F.col("wicket_kind").alias("kind")).agg(F.count("*").alias("n")))


def caught_and_bowled(deliveries: DataFrame, matches: DataFrame) -> DataFrame:
    """Catches off one's own bowling: total and most in an innings, per tournament and over all."""
    own = deliveries.where(F.col("wicket_kind") == "caught and bowled").groupBy("match_id", "innings_id", F.col("bowler_id").alias("player_id")).agg(F.count("*").alias("n"))
    return with_total(own.join(matches.select("match_id", "tournament"), "match_id"), ["player_id"], [F.sum("n").alias("catches"), F.max("n").alias("most_in_innings")])
