"""Venue factors: means shrunk to the global mean, delivery shares, resampled intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creasework import config as C
from creasework.functions import exprs as X


#: What draws are apart, and the steps (shift, then factor) that mix a number of 31 bits.
DRAW_STEP = 2654435761
MIXING = ((15, 739982445), (12, 695872825), (15, 1))


def _mixed(x: Column) -> Column:
    """An evenly spread number of 31 bits."""
    low = F.lit((1 << 31) - 1)
    x = x.bitwiseAND(low)
    for shift, factor in MIXING:
        x = (x.bitwiseXOR(F.shiftright(x, shift)) * F.lit(factor)).bitwiseAND(low)
    return x


def delivery_stats(deliveries: DataFrame, matches: DataFrame) -> DataFrame:
    d = deliveries.join(matches.select("match_id", "venue_id"), "match_id").groupBy("venue_id").agg(
        F.count("*").alias("balls"),
        X.count_if(F.col("is_four") | F.col("is_six")).alias("boundaries"),
        X.count_if(F.col("is_wicket")).alias("wickets"),
        X.count_if(F.col("is_wicket") & F.col("wicket_kind").isin(*C.PACE_LIKE)).alias("pace_like"),
    )
    return d.select("venue_id", X.over_one("boundaries", "balls", digits=None).alias("boundary_rate"), X.over_one("pace_like", "wickets", digits=None).alias("pace_index")).withColumn("spin_index", 1 - F.col("pace_index"))


def factors(innings: DataFrame, deliveries: DataFrame, matches: DataFrame, least: int = C.MIN_VENUE_INNINGS, prior: int = C.VENUE_PRIOR_WEIGHT) -> DataFrame:
    """Batting and bowling factor of each venue with enough first innings.

    The global mean is one row, aggregated from the venues' sums, so the only broadcast has a fixed size.
    """
    at = innings.join(matches.select("match_id", "venue_id"), "match_id").where(F.col("venue_id").isNotNull())
    per = at.groupBy("venue_id").agg(
        X.count_if(F.col("innings_number") == 1).alias("n"),
        X.sum_if(F.col("innings_number") == 1, "total_runs").alias("runs"),
        F.avg(F.when(F.col("innings_number") == 1, F.col("total_wickets"))).alias("avg_first_inn_wickets"),
        F.avg(F.when(F.col("innings_number") == 2, F.col("total_runs"))).alias("avg_second_inn_runs"),
    ).where(F.col("n") >= least)
    mean = per.agg((F.sum("runs") / F.sum("n")).alias("mean"))
    shrunk = (F.col("runs") + prior * F.col("mean")) / (F.col("n") + prior)
    d = per.crossJoin(F.broadcast(mean)).withColumn("shrunk", shrunk).join(delivery_stats(deliveries, matches), "venue_id", "left")
    return d.select(
        "venue_id",
        F.col("n").alias("first_innings"),
        (F.col("runs") / F.col("n")).alias("avg_first_inn_runs"),
        "avg_first_inn_wickets",
        "avg_second_inn_runs",
        X.round_even(F.col("shrunk") / F.col("mean"), 6).alias("bat_factor"),
        X.round_even(F.col("mean") / F.col("shrunk"), 6).alias("bowl_factor"),
        "boundary_rate",
        "pace_index",
        "spin_index",
    )


def factor_intervals(innings: DataFrame, matches: DataFrame, draws: int = C.BOOTSTRAP_DRAWS, bounds: tuple[float, float] = C.BOOTSTRAP_BOUNDS) -> DataFrame:
    """Interval of each venue's mean first innings over the global mean, by a seeded Poisson bootstrap.

    Each innings counts Poisson(1) times in each draw, the count being drawn from a hash of innings and draw, so the
    resampling is one aggregation without collecting a venue's innings anywhere. The id is hashed once; integer mixing
    gives the numbers of its draws.
    """
    seed = F.conv(F.substring(F.md5(F.col("innings_id").cast("string").cast("binary")), 1, 7), 16, 10).cast("long")
    first = innings.where("innings_number = 1").join(matches.select("match_id", "venue_id"), "match_id").select("venue_id", seed.alias("seed"), "total_runs")
    enough = first.groupBy("venue_id").agg(F.count("*").alias("n"), F.sum("total_runs").alias("runs")).where(F.col("n") >= C.MIN_VENUE_INNINGS)
    mean = enough.agg((F.sum("runs") / F.sum("n")).alias("mean"))
    x = _mixed(F.col("seed") + F.col("draw") * F.lit(DRAW_STEP))
    cumulative, total, term = [], 0.0, math.exp(-1)
    for k in range(8):
        total += term
        cumulative.append(math.ceil(total * (1 << 31)))
        term /= k + 1
    times = sum((F.when(F.col("x") >= c, 1).otherwise(0) for c in cumulative), F.lit(0))
    drawn = first.join(enough.select("venue_id"), "venue_id", "left_semi").select("venue_id", "seed", "total_runs", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).withColumn("x", x).withColumn("times", times)
    means = drawn.groupBy("venue_id", "draw").agg((F.sum(F.col("times") * F.col("total_runs")) / F.nullif(F.sum("times"), F.lit(0))).alias("m"))
    out = means.groupBy("venue_id").agg(F.percentile("m", F.lit(bounds[0])).alias("lo"), F.percentile("m", F.lit(bounds[1])).alias("hi"))
    return out.crossJoin(F.broadcast(mean)).select("venue_id", *(X.round_even(F.col(c) / F.col("mean"), 6).alias(f"bat_factor_{c}") for c in ("lo", "hi")))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """new's rows, and old's rows whose key new does not have."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)
