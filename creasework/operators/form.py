"""Form: last innings, rolling means, breakouts. A series has (player_id, order columns, runs, balls)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creasework.functions import exprs as X


def last_n(series: DataFrame, order: list[str], windows: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Means and strike rates of each player's last innings; all innings where there are fewer, null below three."""
    latest = F.row_number().over(Window.partitionBy("player_id").orderBy(*(F.desc(c) for c in order)))
    d = series.withColumn("back", latest)
    recent = lambda w: F.col("back") <= w
    out = d.groupBy("player_id").agg(
        F.count("*").alias("innings_total"),
        F.avg("runs").alias("career_avg"),
        (F.sum("runs") / F.nullif(F.sum("balls"), F.lit(0)) * 100).alias("career_sr"),
        F.stddev_pop("runs").alias("sd"),
        *(F.avg(F.when(recent(w), F.col("runs"))).alias(f"avg_{w}") for w in windows),
        *((X.sum_if(recent(w), "runs") / F.nullif(X.sum_if(recent(w), "balls"), F.lit(0)) * 100).alias(f"sr_{w}") for w in windows),
    )
    enough = F.col("innings_total") >= 3
    out = out.withColumns({c: F.when(enough, F.col(c)) for w in windows for c in (f"avg_{w}", f"sr_{w}")})
    cv = F.when(F.col("career_avg") > 0, F.col("sd") / F.col("career_avg") * 100)
    rises = (F.col("innings_total") >= 10) & (F.col("avg_10") > F.col("career_avg") * 1.2)
    return out.withColumns({"cv": cv, "breakout_flag": F.coalesce(rises, F.lit(False)), "breakout_delta": F.col("avg_10") - F.col("career_avg")}).drop("sd")


def consistency(cv: str = "cv"):
    c = F.col(cv)
    return F.when(c < 60, "consistent").when(c < 90, "moderate").otherwise("volatile")


def breakouts(form: DataFrame, n: int = 30) -> DataFrame:
    return form.where(F.col("breakout_flag") & (F.col("innings_total") >= 10)).orderBy(F.desc("breakout_delta"), "player_id").limit(n)


def rolling(series: DataFrame, order: list[str], width: int = 10, least: int = 3) -> DataFrame:
    """Innings number, and rolling means of runs and of strike rates, null until least values are there."""
    by = Window.partitionBy("player_id").orderBy(*order)
    near = by.rowsBetween(-(width - 1), 0)
    d = series.withColumn("inning_number", F.row_number().over(by)).withColumn("sr", F.when(F.col("balls") > 0, F.col("runs") * 100.0 / F.col("balls")))
    mean = lambda c: F.when(F.count(c).over(near) >= least, F.avg(c).over(near))
    return d.withColumn("rolling_avg", mean("runs")).withColumn("rolling_sr", mean("sr"))
