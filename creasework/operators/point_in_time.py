"""Figures as they stood before a day: running totals, as-of joins and model features that know nothing of their target.

A day's facts of a key are added up first, so a key's rows in a window are its days, however many facts it has. Facts of
the same day never count for each other. Facts without a day count for none and have no earlier figures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creasework.functions import exprs as X
from creasework.operators import careers, models

_PHASES = ("pp", "mid", "death")
#: Days of a slice of an as-of join: a key's rows of a slice meet in a task.
SLICE_DAYS = 64


def daily_totals(facts: DataFrame, keys: list[str], day: str, sums: dict[str, Column]) -> DataFrame:
    """(keys, day, own sums, sums before): of each day of a key, what it adds and what the days before it have added."""
    days = facts.where(F.col(day).isNotNull()).groupBy(*keys, day).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    before = Window.partitionBy(*keys).orderBy(F.unix_date(day)).rangeBetween(Window.unboundedPreceding, -1)
    return days.withColumns({f"{n}_before": F.sum(n).over(before) for n in sums})


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, columns: list[str], strict: bool = True) -> DataFrame:
    """Each row of left with the columns of the last row of right, of equal keys, that is earlier (or not later, if not
    strict); null where there is none. Rows of right of equal keys and time must be one.

    Both sides go through one window in slices of time; what a slice begins with comes from the slices before it, of which
    only the last row of each is kept. So a key with many rows is spread over its slices.
    """
    value = F.struct(*(F.col(c) for c in columns))
    later = F.lit(0) if strict else F.lit(1)  # rows of left stand before or after those of right at the same time
    a = left.select(*keys, F.col(time).alias("_t"), later.alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(value).schema[0].dataType).alias("_value"))
    b = right.where(F.col(time).isNotNull()).select(*keys, F.col(time).alias("_t"), (F.lit(1) - later).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), value.alias("_value"))
    both = a.unionByName(b).withColumn("_slice", F.floor(F.unix_date(F.to_date("_t")) / SLICE_DAYS))
    inside = Window.partitionBy(*keys, "_slice").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = both.withColumn("_near", F.last("_value", ignorenulls=True).over(inside))
    ends = both.where(F.col("_slice").isNotNull()).groupBy(*keys, "_slice").agg(F.max(F.when(F.col("_value").isNotNull(), F.struct("_t", "_value"))).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_slice", F.last("_end._value", ignorenulls=True).over(earlier).alias("_carried"))
    rows = here.where(F.col("_row").isNotNull())
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    out = rows.alias("r").join(carried.alias("c"), [*same, F.col("r._slice") == F.col("c._slice")], "left")
    found = F.when(F.col("_t").isNotNull(), F.coalesce("_near", "_carried"))
    return out.select("r._row", found.alias("_found")).select("_row.*", *(F.col(f"_found.{c}").alias(c) for c in columns))


def _adjusted(facts: DataFrame, factors: DataFrame, runs: str) -> DataFrame:
    return careers.with_factor(facts, factors).withColumn("adj_runs", X.round_even(F.col(runs) / F.col("factor"), 6).cast("decimal(20,6)"))


def bowling_before(bowling: DataFrame, factors: DataFrame) -> DataFrame:
    """(player_id, match_date, figures): bowlers' careers up to the day before each of their days."""
    c = F.col
    sums = {"innings": F.lit(1), "balls": c("balls_bowled"), "runs": c("runs_conceded"), "dots": c("dot_balls"), "adj_runs": c("adj_runs"), **{f"{p}_{w}": c(f"{p}_{w}") for p in _PHASES for w in ("balls", "runs")}}
    d = daily_totals(_adjusted(bowling, factors, "runs_conceded"), ["player_id"], "match_date", sums)
    return d.select(
        "player_id", "match_date", F.lit(careers.ALL).alias("tournament"),
        F.col("innings_before").alias("innings"),
        X.ratio(F.col("adj_runs_before").cast("double"), "balls_before", 6).alias("adj_economy"),
        X.ratio("dots_before", "balls_before", 100).alias("dot_pct"),
        *(X.ratio(f"{p}_runs_before", f"{p}_balls_before", 6).alias(f"{p}_economy") for p in _PHASES),
    )


def batting_before(batting: DataFrame, factors: DataFrame) -> DataFrame:
    """(player_id, match_date, figures): batters' totals up to the day before, over all and by innings type."""
    n, c, out = F.lit(1), F.col, (~F.col("not_out")).cast("int")
    sums = {"innings": n, "outs": out, "runs": c("runs"), "balls": c("balls_faced"), "adj_runs": c("adj_runs")}
    for name, kind in (("chase", F.col("is_chase")), ("first", ~F.col("is_chase"))):
        sums |= {f"{name}_{k}": F.when(kind, v).otherwise(0) for k, v in (("n", n), ("outs", out), ("runs", c("runs")), ("balls", c("balls_faced")))}
    sums |= {f"{p}_{w}": c(f"{p}_{w}") for p in _PHASES for w in ("runs", "balls")}
    return daily_totals(_adjusted(batting, factors, "runs"), ["player_id"], "match_date", sums)


def bowling_features(bowling: DataFrame, factors: DataFrame, least_balls: int = 6) -> DataFrame:
    """The features of bowling models with careers up to the day before."""
    return models.bowling_features(bowling, factors, bowling_before(bowling, factors), least_balls, on=("player_id", "match_date"))


def batting_features(batting: DataFrame, factors: DataFrame, least_balls: int = 4) -> DataFrame:
    """The features of batting models with careers, innings types and phase strike rates up to the day before."""
    d = batting_before(batting, factors)
    day = ["player_id", "match_date"]
    career = d.select(*day, F.lit(careers.ALL).alias("tournament"), F.col("innings_before").alias("innings"), X.ratio(F.col("adj_runs_before").cast("double"), "outs_before").alias("adj_average"), X.ratio("runs_before", "balls_before", 100).alias("adj_strike_rate"))
    split = F.explode(F.array(*(F.struct(F.lit(k).alias("innings_type"), X.ratio(f"{k}_runs_before", f"{k}_outs_before").alias("average"), X.ratio(f"{k}_runs_before", f"{k}_balls_before", 100).alias("strike_rate")) for k in ("chase", "first"))))
    phases = d.select(*day, *(F.coalesce(f"{p}_{w}_before", F.lit(0)).alias(f"{p}_{w}") for p in _PHASES for w in ("runs", "balls")))
    facts = batting.drop(*(f"{p}_{w}" for p in _PHASES for w in ("runs", "balls"))).join(phases, day, "left")
    return models.batting_features(facts, factors, career, d.select(*day, split.alias("x")).select(*day, "x.*"), least_balls, on=tuple(day))


def figures_at(requests: DataFrame, facts: DataFrame, keys: list[str], day: str, sums: dict[str, Column]) -> DataFrame:
    """Each request (keys, day) with the totals of all facts of its keys on earlier days; zeros where there are none."""
    d = daily_totals(facts, keys, day, sums)
    upto = d.select(*keys, day, *((F.coalesce(f"{n}_before", F.lit(0)) + F.coalesce(n, F.lit(0))).alias(n) for n in sums))
    return asof_join(requests, upto, keys, day, list(sums)).fillna(0, subset=list(sums))
