"""Squads: XI ratings and score predictions. A squad is (side, slot from 1, player_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creasework import config as C
from creasework.functions import exprs as X


def xi_rating(squads: DataFrame, ratings: DataFrame, venue: DataFrame | None = None, depth_above: float = 45.0) -> DataFrame:
    """Batting, bowling, depth, venue fit and overall of each side; unknown players count for the weights only.

    venue: one row of pace_index and bat_factor.
    """
    top = F.col("slot") <= 6
    d = squads.join(ratings.withColumn("known", F.lit(True)), "player_id", "left")
    known = F.coalesce("known", F.lit(False))
    bat, bowl, death = (F.when(known, F.coalesce(c, F.lit(50.0))) for c in ("bat_rating", "bowl_rating", "s_death_sr"))
    w_bat, w_bowl = F.when(top, 2).otherwise(1), F.when(top, 1).otherwise(2)
    d = d.groupBy("side").agg(
        X.round_even(F.sum(bat * w_bat) / F.sum(w_bat), 1).alias("batting"),
        X.round_even(F.sum(bowl * w_bowl) / F.sum(w_bowl), 1).alias("bowling"),
        X.round_even(X.count_if(known & (F.coalesce("bat_rating", F.lit(0.0)) > depth_above)) * 100.0 / F.count("*"), 1).alias("depth"),
        F.coalesce(F.avg(F.when(~top & known, X.default("bowl_rating", 50.0))), F.lit(50.0)).alias("low_bowl"),
        F.coalesce(F.avg(death), F.lit(50.0)).alias("death"),
    )
    if venue is None:
        d = d.withColumn("venue_fit", F.lit(50.0))
    else:
        v = venue.select(X.default("pace_index", 0.5).alias("pace"), X.default("bat_factor", 1.0).alias("factor"))
        pace = F.col("low_bowl") * F.col("pace") + (100 - F.col("low_bowl")) * (1 - F.col("pace"))
        hitting = X.clamp(F.col("death") * (F.col("factor") - 0.7) / 0.6, 0, 100)
        d = d.crossJoin(F.broadcast(v)).withColumn("venue_fit", X.round_even(pace * 0.5 + hitting * 0.3 + 10.0, 1))
    overall = X.round_even(F.col("batting") * 0.35 + F.col("bowling") * 0.35 + F.col("depth") * 0.15 + F.col("venue_fit") * 0.15, 1)
    return d.withColumn("overall", overall).withColumn("grade", X.grade("overall")).select("side", "batting", "bowling", "depth", "venue_fit", "overall", "grade")


def edges(rated: DataFrame, a: str, b: str, least: float = 5.0) -> DataFrame:
    """Dimensions in which two sides differ by more than least."""
    long = rated.select("side", F.explode(F.array(*(F.struct(F.lit(m).alias("dimension"), F.col(m).alias("v")) for m in ("batting", "bowling", "depth", "venue_fit", "overall")))).alias("x")).select("side", "x.*")
    d = long.groupBy("dimension").agg(F.max(F.when(F.col("side") == a, F.col("v"))).alias("a"), F.max(F.when(F.col("side") == b, F.col("v"))).alias("b"))
    return d.withColumn("edge", F.when(F.col("a") - F.col("b") > least, a).when(F.col("b") - F.col("a") > least, b).otherwise("even"))


def match_prediction(squads: DataFrame, ratings: DataFrame, venue: DataFrame, bats_first: str) -> DataFrame:
    """Predicted total and win probability of two sides: the venue's average (130 to 185, 158 where unknown), moved by
    the batting side's edge over the other's bowling and by dew, within 110 to 210, plus 12 extras."""
    first_six = F.col("slot") <= 6
    d = squads.join(ratings.select("player_id", "bat_rating", "bowl_rating", F.lit(True).alias("known")), "player_id", "left")
    value = lambda c: F.when(F.coalesce("known", F.lit(False)), X.default(c, 50.0)).otherwise(0.0)
    w_bat, w_bowl = F.when(first_six, 2).otherwise(1), F.when(first_six, 1).otherwise(2)
    q = d.groupBy("side").agg((F.sum(value("bat_rating") * w_bat) / F.sum(w_bat)).alias("bat"), (F.sum(value("bowl_rating") * w_bowl) / F.sum(w_bowl)).alias("bowl"))
    one = F.broadcast(q.groupBy().agg(*(F.max(F.when(cond, F.col(c))).alias(f"{name}_{c}") for name, cond in (("first", F.col("side") == bats_first), ("second", F.col("side") != bats_first)) for c in ("bat", "bowl"))))
    v = venue.select(X.clamp(X.default("avg_first_inn_runs", 158.0), 130, 185).alias("base"), X.default("bat_factor", 1.0).alias("factor"))
    p = v.crossJoin(one)
    dew = F.when(F.col("factor") > 1.05, 5.0).otherwise(0.0)
    first = F.round(X.clamp(F.col("base") + (F.col("first_bat") - F.col("second_bowl")) * 0.3 - dew, 110, 210) + 12, 1)
    second = F.round(X.clamp(F.col("base") + (F.col("second_bat") - F.col("first_bowl")) * 0.3 + dew, 110, 210) + 12, 1)
    p = p.select(first.alias("first_total"), second.alias("second_total"))
    chance = F.round(100 / (1 + F.exp(-(F.col("first_total") - F.col("second_total")) / 20)), 1)
    return p.withColumn("first_win_pct", chance).withColumn("second_win_pct", F.round(100 - chance, 1)).withColumn("margin", F.round(F.abs(F.col("first_total") - F.col("second_total")), 1))


def run_shares(squads: DataFrame, expected: DataFrame, team_runs: float) -> DataFrame:
    """A side's runs dealt by expected runs times the probability that the slot gets to bat; 5 runs where unknown."""
    from pyspark.sql import Window

    chance = F.element_at(F.create_map(*(F.lit(x) for kv in C.BAT_PROBABILITY.items() for x in kv)), F.col("slot"))
    d = squads.join(expected, "player_id", "left").withColumn("weight", F.coalesce(F.greatest("expected_runs", F.lit(0.0)), F.lit(5.0)) * chance)
    total = F.sum("weight").over(Window.partitionBy("side"))
    return d.withColumn("predicted_runs", F.round(F.col("weight") / F.nullif(total, F.lit(0.0)) * team_runs, 1))
