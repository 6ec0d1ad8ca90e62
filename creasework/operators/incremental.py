"""Careers from states that merge: what a batch of innings adds, kept by batch and added up when read.

A state has a row for each player, tournament, venue and score: how many innings ended on it, and their sums. Scores by
their counts give the exact median and marks such as fifties, and venues with scores the runs adjusted by factors that
change with every batch; so careers from merged states are those of all innings at once, to the last digit. States of
different batches are simply added. A batch that is written again takes its own place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creasework.functions import exprs as X
from creasework.operators import careers

_PHASES = ("pp", "mid", "death")
_BAT = ["not_outs", "balls", "fours", "sixes", "ducks", "opened", *(f"{p}_{w}" for p in _PHASES for w in ("runs", "balls"))]
_BOWL = ["balls", "wickets", "dots", *(f"{p}_{w}" for p in _PHASES for w in ("balls", "runs", "wickets"))]
KEYS = ["player_id", "tournament", "venue_id", "score"]


def batting_state(batting: DataFrame) -> DataFrame:
    n = lambda c: X.count_if(c)
    sums = {"not_outs": n(F.col("not_out")), "balls": F.sum("balls_faced"), "fours": F.sum("fours"), "sixes": F.sum("sixes"), "ducks": n((F.col("runs") == 0) & ~F.col("not_out")), "opened": n(F.col("batting_position") <= 2)}
    sums |= {f"{p}_{w}": F.sum(f"{p}_{w}") for p in _PHASES for w in ("runs", "balls")}
    return batting.groupBy("player_id", "tournament", "venue_id", F.col("runs").alias("score")).agg(F.count("*").alias("innings"), *(c.alias(k) for k, c in sums.items()))


def bowling_state(bowling: DataFrame) -> DataFrame:
    sums = {"balls": "balls_bowled", "wickets": "wickets", "dots": "dot_balls"} | {f"{p}_{w}": f"{p}_{w}" for p in _PHASES for w in ("balls", "runs", "wickets")}
    return bowling.groupBy("player_id", "tournament", "venue_id", F.col("runs_conceded").alias("score")).agg(F.count("*").alias("innings"), *(F.sum(c).alias(k) for k, c in sums.items()))


def merged(states: DataFrame) -> DataFrame:
    """One state of many."""
    sums = [c for c in states.columns if c not in (*KEYS, "batch")]
    return states.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in sums))


def _adjusted(states: DataFrame, factors: DataFrame) -> DataFrame:
    one = X.round_even(F.col("score") / F.col("factor"), 6).cast("decimal(20,6)")
    return careers.with_factor(states, factors).withColumn("adj_runs", one * F.col("innings"))


def career_batting(states: DataFrame, factors: DataFrame) -> DataFrame:
    """``careers.career_batting`` of all innings that the states hold."""
    marks = lambda low, high: X.sum_if(F.col("score").between(low, high), "innings")
    sums = [
        F.sum("innings").alias("innings"), F.sum("not_outs").alias("not_outs"), F.sum(F.col("score") * F.col("innings")).alias("runs"), F.sum("balls").alias("balls"), F.max("score").alias("highest"),
        marks(50, 99).alias("fifties"), marks(100, 10**9).alias("hundreds"), F.sum("ducks").alias("ducks"), F.sum("fours").alias("fours"), F.sum("sixes").alias("sixes"),
        *(F.sum(f"{p}_{w}").alias(f"{p}_{w}") for p in _PHASES for w in ("runs", "balls")),
        F.percentile("score", F.lit(0.5), F.col("innings")).alias("median_runs"), marks(30, 49).alias("thirties"), F.sum("opened").alias("times_opened"), F.sum("adj_runs").cast("double").alias("adj_runs"),
    ]
    d = careers.with_total(_adjusted(states, factors), ["player_id"], sums)
    out = F.col("innings") - F.col("not_outs")
    d = d.withColumns({"average": X.ratio("runs", out), "strike_rate": X.ratio("runs", "balls", 100), "adj_average": X.ratio("adj_runs", out)}).withColumn("adj_strike_rate", F.col("strike_rate"))
    return d.withColumns({f"{p}_sr": X.ratio(f"{p}_runs", f"{p}_balls", 100) for p in _PHASES}).drop("adj_runs")


def career_bowling(states: DataFrame, factors: DataFrame) -> DataFrame:
    """``careers.career_bowling`` of all innings that the states hold."""
    sums = [F.sum("innings").alias("innings"), F.sum("balls").alias("balls"), F.sum(F.col("score") * F.col("innings")).alias("runs"), F.sum("wickets").alias("wickets"), *(F.sum(f"{p}_{w}").alias(f"{p}_{w}") for p in _PHASES for w in ("balls", "runs", "wickets")), F.sum("dots").alias("dots"), F.sum("adj_runs").cast("double").alias("adj_runs")]
    d = careers.with_total(_adjusted(states, factors), ["player_id"], sums)
    d = d.withColumns({"economy": X.ratio("runs", "balls", 6), "average": X.ratio("runs", "wickets"), "strike_rate": X.ratio("balls", "wickets"), "dot_pct": X.ratio("dots", "balls", 100), "adj_economy": X.ratio("adj_runs", "balls", 6)})
    return d.withColumns({f"{p}_economy": X.ratio(f"{p}_runs", f"{p}_balls", 6) for p in _PHASES}).drop("adj_runs")


def add_batch(state: DataFrame, path: str, batch: int) -> None:
    """Put a batch's state in its own partition of the table; the same batch again replaces it."""
    state.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def compact(spark: SparkSession, path: str, to: str) -> None:
    """All states as one, written to another folder as batch -1; batches that come later are added to it there."""
    merged(states(spark, path)).withColumn("batch", F.lit(-1)).write.mode("overwrite").partitionBy("batch").parquet(to)
