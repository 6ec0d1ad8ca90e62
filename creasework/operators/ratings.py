"""Ratings: population z-scores turned to 0-100 and blended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creasework import config as C
from creasework.functions import exprs as X
from creasework.sources.shared import settle


def scored(d: DataFrame, metrics: dict[str, tuple[Column, bool]], digits: int = 6) -> DataFrame:
    """Add a 0-100 score of each metric over all rows: (value, whether higher is better).

    Nulls take the median; a constant metric scores 50. One aggregation to a single row gives all statistics: mean and
    deviation with the nulls filled follow from those without and the median. The rows, one a player, are settled, as the
    facts behind them would be read for the statistics and for the scores.
    """
    d = settle(d.withColumns({f"_v_{n}": v.cast("double") for n, (v, _) in metrics.items()}), "scored")
    parts = {"k": F.count, "a": F.avg, "q": F.var_pop, "m": F.median}
    stats = d.agg(F.count("*").alias("_n"), *(F.coalesce(f(f"_v_{n}"), F.lit(0)).cast("double").alias(f"_{p}_{n}") for n in metrics for p, f in parts.items()))
    derived = {}
    for n in metrics:
        k, a, q, m = (F.col(f"_{p}_{n}") for p in parts)
        mean = (a * k + m * (F.col("_n") - k)) / F.greatest(F.col("_n"), F.lit(1))
        spread = q * k + k * (a - mean) * (a - mean) + (F.col("_n") - k) * (m - mean) * (m - mean)
        derived |= {f"_a_{n}": mean, f"_s_{n}": F.when(F.col("_n") > 1, F.sqrt(spread / (F.col("_n") - 1))), f"_m_{n}": m}
    d = d.crossJoin(F.broadcast(stats.select(*(c.alias(x) for x, c in derived.items()))))
    d = d.withColumns({f"_v_{n}": F.coalesce(f"_v_{n}", f"_m_{n}") for n in metrics})
    out = {}
    for n, (_, higher) in metrics.items():
        z = (F.col(f"_v_{n}") - F.col(f"_a_{n}")) / F.col(f"_s_{n}")
        flat = F.col(f"_s_{n}").isNull() | (F.col(f"_s_{n}") < 1e-6)
        out[n] = F.round(F.when(flat, 50.0).otherwise(X.sigmoid_score(z if higher else -z)), digits)
    return d.withColumns(out).drop(*(c for c in d.columns if c[:3] in ("_v_", "_m_", "_a_", "_s_")))


def blend(weights: dict[str, float]) -> Column:
    return sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))


def batting(career: DataFrame, chase: DataFrame, tournament: str = "ALL", least: int = C.MIN_RATED_INNINGS) -> DataFrame:
    """Sub-scores and rating of batters; the chase split is over all tournaments, whichever is rated."""
    split = chase.groupBy("player_id").agg(
        *(F.max(F.when(F.col("innings_type") == "chase", F.col(a))).alias(b) for a, b in (("average", "chase_avg"), ("strike_rate", "chase_sr"), ("hp_sr", "hp_sr"), ("finishes", "finishes"))),
        *(F.max(F.when(F.col("innings_type") == "first", F.col(a))).alias(b) for a, b in (("average", "first_avg"), ("strike_rate", "first_sr"))),
    )
    d = career.where((F.col("tournament") == tournament) & (F.col("innings") >= least)).join(split, "player_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    d = scored(
        d,
        {
            "s_avg": (F.col("adj_average"), True),
            "s_sr": (F.col("adj_strike_rate"), True),
            "s_pp_sr": (F.col("pp_sr"), True),
            "s_mid_sr": (F.col("mid_sr"), True),
            "s_death_sr": (F.col("death_sr"), True),
            "s_chase": (zero("chase_avg") * 0.5 + zero("chase_sr") * 0.3 + zero("hp_sr") * 0.2, True),
            "s_first": (zero("first_avg") * 0.6 + zero("first_sr") * 0.4, True),
            "s_finishes": (zero("finishes"), True),
        },
    )
    d = d.withColumns(
        {
            "s_opener": F.round(blend({"s_first": 0.4, "s_pp_sr": 0.4, "s_avg": 0.2}), 4),
            "s_finisher": F.round(blend({"s_death_sr": 0.5, "s_chase": 0.3, "s_finishes": 0.2}), 4),
            "s_anchor": F.round(blend({"s_avg": 0.5, "s_chase": 0.3, "s_mid_sr": 0.2}), 4),
            "bat_rating": F.round(blend({"s_avg": 0.30, "s_sr": 0.20, "s_pp_sr": 0.10, "s_mid_sr": 0.10, "s_death_sr": 0.10, "s_chase": 0.20}), 1),
        }
    )
    scores = ["s_avg", "s_sr", "s_pp_sr", "s_mid_sr", "s_death_sr", "s_chase", "s_first", "s_opener", "s_finisher", "s_anchor"]
    return d.select("player_id", *scores, "bat_rating", "adj_average", "adj_strike_rate")


def bowling(career: DataFrame, tournament: str = "ALL", least: int = C.MIN_RATED_INNINGS) -> DataFrame:
    d = career.where((F.col("tournament") == tournament) & (F.col("innings") >= least))
    metrics = {"s_economy": "adj_economy", "s_bowl_avg": "average", "s_bowl_sr": "strike_rate", "s_dot": "dot_pct", "s_pp_bowl": "pp_economy", "s_mid_bowl": "mid_economy", "s_death_bowl": "death_economy"}
    d = scored(d, {n: (F.col(c), n == "s_dot") for n, c in metrics.items()})
    weights = {"s_economy": 0.25, "s_bowl_avg": 0.20, "s_bowl_sr": 0.15, "s_dot": 0.15, "s_pp_bowl": 0.08, "s_mid_bowl": 0.08, "s_death_bowl": 0.09}
    return d.withColumn("bowl_rating", F.round(blend(weights), 1)).select("player_id", *metrics, "bowl_rating", "adj_economy")


def overall(bat: DataFrame, bowl: DataFrame) -> DataFrame:
    """Both ratings of every rated player; a missing side counts as zero."""
    d = bat.select("player_id", "bat_rating", "s_opener", "s_finisher", "s_anchor", "s_pp_sr", "s_death_sr", "s_chase", "adj_average", "adj_strike_rate")
    d = d.join(bowl.select("player_id", "bowl_rating", "s_pp_bowl", "s_mid_bowl", "s_death_bowl", "adj_economy"), "player_id", "full")
    d = d.fillna(0.0, subset=["bat_rating", "bowl_rating"])
    return d.withColumn("overall_rating", F.round(F.col("bat_rating") * 0.6 + F.col("bowl_rating") * 0.4, 1))


def compare(rated: DataFrame, a: int, b: int) -> DataFrame:
    """Metric by metric, the values of two players and who is ahead."""
    metrics = ["bat_rating", "bowl_rating", "overall_rating", "s_opener", "s_finisher", "s_anchor"]
    side = lambda p, name: rated.where(F.col("player_id") == p).select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics))).alias("x")).select("x.*")
    d = side(a, "value_a").join(side(b, "value_b"), "metric", "full")
    return d.withColumn("winner", F.when(F.col("value_a") > F.col("value_b"), "a").when(F.col("value_b") > F.col("value_a"), "b").otherwise("tie"))
