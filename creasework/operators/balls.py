"""Ball level: flags, phases, running totals and chase context.

Input: raw deliveries (match_id, innings_id, innings_number, over_number, ball_number, batter_id, non_striker_id,
bowler_id, bat_runs, wide, no_ball, bye, leg_bye, penalty, extras, total_runs, is_wicket, wicket_kind, player_out_id,
target).
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creasework import config as C
from creasework.functions import exprs as X


def with_flags(d: DataFrame) -> DataFrame:
    legal = X.is_legal()
    return d.withColumns(
        {
            "phase": X.phase_of("over_number"),
            "is_legal": legal,
            "is_four": F.col("bat_runs") == 4,
            "is_six": F.col("bat_runs") == 6,
            "is_dot": legal & (F.col("bat_runs") == 0) & (F.col("extras") == 0),
            "bowler_wicket": X.bowler_wicket(),
        }
    )


def innings_of(d: DataFrame) -> list[str]:
    """What tells innings apart: their id, and before it the match, by which tables lie, where d has it."""
    return [c for c in ("match_id", "innings_id") if c in d.columns]


def with_context(d: DataFrame) -> DataFrame:
    """Running runs and legal balls, the legal ball's number in its over, and the rates of a chase.

    The two running windows share the innings as partition, so the rows move once; not at all if they lie by match.
    """
    innings = innings_of(d)
    so_far = Window.partitionBy(*innings).orderBy("ball_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_over = Window.partitionBy(*innings, "over_number").orderBy("ball_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    legal = F.col("is_legal").cast("int")
    d = d.withColumn("cum_runs", F.sum("total_runs").over(so_far)).withColumn("cum_legal", F.sum(legal).over(so_far))
    d = d.withColumn("ball_in_over", F.when(F.col("is_legal"), F.sum(legal).over(in_over)).otherwise(0))
    return with_rates(d)


def with_rates(d: DataFrame) -> DataFrame:
    """The run rate so far and the one that is needed, of a chase's balls with their running score."""
    chase = (F.col("innings_number") == 2) & F.col("target").isNotNull()
    need = F.greatest(F.lit(0), F.col("target") - F.col("cum_runs"))
    left = F.greatest(F.lit(1), F.lit(C.INNINGS_BALLS) - F.col("cum_legal"))
    return d.withColumns(
        {
            "crr_at_ball": F.when(chase, X.round_even(F.col("cum_runs") / F.greatest(F.lit(1), F.col("cum_legal")) * 6, 2)),
            "req_rate_at_ball": F.when(chase, X.round_even(need / left * 6, 2)),
        }
    )


def innings_totals(d: DataFrame) -> DataFrame:
    out = d.groupBy("innings_id", "match_id", "innings_number").agg(
        F.sum("total_runs").alias("total_runs"),
        X.count_if(F.col("is_wicket")).alias("total_wickets"),
        X.count_if(F.col("is_legal")).alias("total_balls"),
        F.sum("extras").alias("extras"),
        F.max("target").alias("target"),
    )
    chase = (F.col("innings_number") == 2) & F.col("target").isNotNull()
    return out.withColumn("chase_successful", F.when(chase, (F.col("total_wickets") < 10) & (F.col("total_runs") >= F.col("target")))).withColumn("required_rr_start", F.when(chase, F.col("target") / 20))


def _phases(prefix_balls: dict[str, object]) -> list:
    out = []
    for code, name in enumerate(("pp", "mid", "death")):
        out += [X.sum_if((F.col("phase") == code) & F.col("is_legal"), value).alias(f"{name}_{what}") for what, value in prefix_balls.items()]
    return out


def beside_match(d: DataFrame, few: DataFrame, keys: list[str], value: str) -> DataFrame:
    """d with the value that few has for the row's match and keys, null where there is none. few has a row at most for each
    match and keys; a match's rows go as one map, so that the join is by match and tables that lie by match stay where
    they are."""
    known = few.where(reduce(and_, (F.col(c).isNotNull() for c in keys)))
    maps = known.groupBy("match_id").agg(F.map_from_entries(F.collect_list(F.struct(F.struct(*keys), value))).alias("_map"))
    asked = F.when(reduce(and_, (F.col(c).isNotNull() for c in keys)), F.try_element_at("_map", F.struct(*keys)))
    return d.join(maps, "match_id", "left").withColumn(value, asked).drop("_map")


def batter_innings(d: DataFrame) -> DataFrame:
    """One row per innings and batter that was on strike: totals, order of arrival and how the innings ended.

    Runs off no-balls count in the total but not in the phases. Who is out without having been on strike has no row.
    """
    faced = d.groupBy("match_id", "innings_id", "innings_number", "batter_id").agg(
        F.sum("bat_runs").alias("runs"),
        X.count_if(F.col("is_legal")).alias("balls_faced"),
        X.count_if(F.col("is_four")).alias("fours"),
        X.count_if(F.col("is_six")).alias("sixes"),
        F.min("ball_number").alias("first_ball"),
        *_phases({"runs": "bat_runs", "balls": F.lit(1)}),
    )
    out = d.where(F.col("is_wicket") & F.col("player_out_id").isNotNull()).groupBy("match_id", "innings_id", F.col("player_out_id").alias("batter_id")).agg(F.min_by(F.coalesce("wicket_kind", F.lit("unknown")), "ball_number").alias("dismissal_kind"))
    arrival = Window.partitionBy("match_id", "innings_id").orderBy("first_ball", "batter_id")
    return (
        beside_match(faced, out, ["innings_id", "batter_id"], "dismissal_kind")
        .withColumn("batting_position", F.row_number().over(arrival))
        .withColumn("not_out", F.col("dismissal_kind").isNull())
        .drop("first_ball")
    )


def bowler_innings(d: DataFrame, charge_illegal: bool = False) -> DataFrame:
    """One row per innings and bowler. Runs are charged on legal balls only, unless charge_illegal; never byes."""
    charged = F.col("total_runs") - F.col("bye") - F.col("leg_bye")
    counts = F.lit(True) if charge_illegal else F.col("is_legal")
    out = []
    for code, name in enumerate(("pp", "mid", "death")):
        here = F.col("phase") == code
        out += [X.count_if(here & F.col("is_legal")).alias(f"{name}_balls"), X.sum_if(here & counts, charged).alias(f"{name}_runs"), X.count_if(here & F.col("bowler_wicket")).alias(f"{name}_wickets")]
    spell = d.groupBy("match_id", "innings_id", "innings_number", "bowler_id").agg(
        X.count_if(F.col("is_legal")).alias("balls_bowled"),
        X.sum_if(counts, charged).alias("runs_conceded"),
        X.count_if(F.col("bowler_wicket")).alias("wickets"),
        X.count_if(F.col("is_dot")).alias("dot_balls"),
        F.sum("wide").alias("wides"),
        F.sum("no_ball").alias("no_balls"),
        X.count_if(F.col("is_four") | F.col("is_six")).alias("boundaries_con"),
        *out,
    )
    return spell.withColumn("overs_bowled", X.round_even(F.col("balls_bowled") / 6, 1))


def milestones(batting: DataFrame, bowling: DataFrame, runs: dict[str, int] | None = None, wickets: dict[str, int] | None = None) -> DataFrame:
    """The highest run mark of each innings (or a duck) and wicket hauls. Marks are parameters, highest first."""
    marks = F.coalesce(*(F.when(F.col("runs") >= at, F.lit(name)) for name, at in (runs or C.MILESTONES).items()), F.when((F.col("runs") == 0) & ~F.col("not_out"), F.lit("duck")))
    most, least = (wickets or C.WICKET_HAULS).items()
    hauls = F.when(F.col("wickets") >= most[1], most[0]).when(F.col("wickets") == least[1], least[0])
    bat = batting.select("match_id", "innings_id", F.col("batter_id").alias("player_id"), marks.alias("milestone"), F.col("runs").alias("value"))
    bowl = bowling.select("match_id", "innings_id", F.col("bowler_id").alias("player_id"), hauls.alias("milestone"), F.col("wickets").alias("value"))
    return bat.unionByName(bowl).where(F.col("milestone").isNotNull())


def partnerships(d: DataFrame) -> DataFrame:
    """Runs and legal balls between two wickets of an innings; a wicket's ball belongs to the stand it ends."""
    before = Window.partitionBy("innings_id").orderBy("ball_number").rowsBetween(Window.unboundedPreceding, -1)
    stand = 1 + F.coalesce(F.sum(F.col("is_wicket").cast("int")).over(before), F.lit(0))
    return d.withColumn("wicket_number", stand).groupBy("innings_id", "wicket_number").agg(F.sum("total_runs").alias("runs"), X.count_if(F.col("is_legal")).alias("balls"), F.max(F.col("is_wicket").cast("int")).alias("ended"))
