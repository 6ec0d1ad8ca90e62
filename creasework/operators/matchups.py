"""Batter against bowler, style and opponent; predicted matchups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creasework.functions import exprs as X


#: Bowlers whose predicted matchups are asked for at once; their few columns are broadcast.
BOWLERS = 100_000


def faced() -> Column:
    """Balls that count for matchups: no wides, but no-balls do."""
    return F.col("wide") == 0


def pair_sums(d: DataFrame, *keys: str) -> DataFrame:
    """Per keys: balls, runs, own dismissals, wickets on the ball, dots, boundaries."""
    return d.groupBy(*keys).agg(
        X.count_if(faced()).alias("balls"),
        F.sum("bat_runs").alias("runs"),
        X.count_if(F.col("is_wicket") & (F.col("player_out_id") == F.col("batter_id"))).alias("dismissals"),
        X.count_if(F.col("is_wicket")).alias("wickets"),
        X.count_if(F.col("is_dot")).alias("dots"),
        X.count_if(F.col("is_four") | F.col("is_six")).alias("boundaries"),
    )


def with_rates(d: DataFrame) -> DataFrame:
    return d.withColumns({"strike_rate": X.ratio("runs", "balls", 100, 1), "average": X.ratio("runs", "dismissals", 1, 1), "dot_pct": X.ratio("dots", "balls", 100, 1), "boundary_pct": X.ratio("boundaries", "balls", 100, 1)})


def batter_vs_bowlers(d: DataFrame, batter: int, least: int = 6, n: int = 50) -> DataFrame:
    got = with_rates(pair_sums(d.where(F.col("batter_id") == batter), "batter_id", "bowler_id")).where(F.col("balls") >= least)
    return got.orderBy(F.desc("balls"), "bowler_id").limit(n)


def bowler_vs_batters(d: DataFrame, bowler: int, least: int = 6) -> DataFrame:
    return with_rates(pair_sums(d.where(F.col("bowler_id") == bowler), "bowler_id", "batter_id")).where(F.col("balls") >= least)


def pair_phases(d: DataFrame, batter: int, bowler: int) -> DataFrame:
    got = pair_sums(d.where((F.col("batter_id") == batter) & (F.col("bowler_id") == bowler)), "phase")
    return with_rates(got).withColumn("phase_name", X.phase_name("phase"))


def pair_contexts(d: DataFrame, matches: DataFrame, batter: int, bowler: int) -> DataFrame:
    own = d.where((F.col("batter_id") == batter) & (F.col("bowler_id") == bowler))
    return with_rates(pair_sums(own.join(matches.select("match_id", "tournament", "season", "venue_id"), "match_id"), "tournament", "season", "venue_id"))


def extremes(pairs: DataFrame, least: int = 12, n: int = 10) -> DataFrame:
    """The best and worst strike rates, and the most dismissals, of pairs with enough balls."""
    enough = pairs.where(F.col("balls") >= least)
    top = lambda name, *order: enough.orderBy(*order, "batter_id", "bowler_id").limit(n).withColumn("list", F.lit(name))
    return top("best", F.desc("strike_rate")).union(top("worst", F.asc("strike_rate"))).union(top("most_dismissed", F.desc("dismissals")))


def style_matchups(d: DataFrame, styles: DataFrame, least: int = 24) -> DataFrame:
    """Batters against bowling styles; styles (bowler_id, style) is a dimension of players."""
    return with_rates(pair_sums(d.join(styles, "bowler_id"), "batter_id", "style")).where(F.col("balls") >= least)


def dismissal_phases(d: DataFrame) -> DataFrame:
    """Dismissals by kind and phase, one column a phase; run outs count."""
    out = d.where(F.col("is_wicket") & (F.col("player_out_id") == F.col("batter_id")) & F.col("wicket_kind").isNotNull())
    wide = out.groupBy("batter_id", "wicket_kind").pivot("phase", [0, 1, 2]).agg(F.count(F.lit(1))).fillna(0, subset=["0", "1", "2"])
    return wide.select("batter_id", "wicket_kind", F.col("0").alias("powerplay"), F.col("1").alias("middle"), F.col("2").alias("death"))


#: Cells of a matrix of matchups at most.
CELLS = 10_000


def matrix(d: DataFrame, batters: DataFrame, bowlers: DataFrame) -> DataFrame:
    """Each of a few batters against each of a few bowlers (a side's top six and the other's last five).

    The two lists have a fixed size, so their product has too; balls are aggregated once for all cells.
    """
    if batters.count() * bowlers.count() > CELLS:
        raise ValueError(f"a matrix has {CELLS} cells at most; matchups of all pairs come from pair_sums")
    cells = batters.crossJoin(F.broadcast(bowlers))
    own = d.join(F.broadcast(batters), "batter_id", "left_semi").join(F.broadcast(bowlers), "bowler_id", "left_semi")
    return cells.join(with_rates(pair_sums(own, "batter_id", "bowler_id")), ["batter_id", "bowler_id"], "left").fillna(0, subset=["balls", "runs", "dismissals", "wickets", "dots", "boundaries"])


def _listed(ids: DataFrame) -> DataFrame:
    """The ids of a side, broadcast if they are no more than CELLS."""
    return F.broadcast(ids) if ids.count() <= CELLS else ids


def threats(d: DataFrame, batters: DataFrame, bowlers: DataFrame, least: int = 6) -> DataFrame:
    """Bowlers against each batter of the other side with enough balls between them (wides count here): balls, whole
    strike rate, wickets; most wickets first."""
    own = d.join(_listed(batters), "batter_id", "left_semi").join(_listed(bowlers), "bowler_id", "left_semi")
    met = own.groupBy("bowler_id", "batter_id").agg(F.count("*").alias("balls"), F.sum("bat_runs").alias("runs"), X.count_if(F.col("is_wicket")).alias("wickets")).where(F.col("balls") >= least)
    return met.select("bowler_id", "batter_id", "balls", X.round_even(F.col("runs") * 100.0 / F.col("balls"), 0).cast("long").alias("strike_rate"), "wickets").orderBy(F.desc("wickets"), "bowler_id", "batter_id")


def predicted(bat: DataFrame, bowl: DataFrame, bat_factor: Column | None = None, dot_as_percent: bool = False) -> DataFrame:
    """Predicted edge of batters (average, strike_rate, pp_sr, mid_sr, death_sr) over bowlers (economy, strike_rate,
    dot_pct, pp_economy, mid_economy, death_economy), joined already as columns b_* and w_*.

    dot_as_percent keeps the behaviour of taking the dot percentage as if it were a fraction.
    """
    if bowl.count() > BOWLERS:
        raise ValueError(f"more than {BOWLERS} bowlers: predict them in several calls")
    d = bat.crossJoin(F.broadcast(bowl))
    sr, avg = X.default("b_strike_rate", 120.0), X.default("b_average", 25.0)
    pp, mid, death = (F.coalesce(F.nullif(F.col(f"b_{p}_sr"), F.lit(0.0)), sr) for p in ("pp", "mid", "death"))
    eco, bpw = X.default("w_economy", 8.0), X.default("w_strike_rate", 20.0)
    dot = X.default("w_dot_pct", 0.35) if dot_as_percent else F.coalesce(F.nullif(F.col("w_dot_pct"), F.lit(0.0)) / 100, F.lit(0.35))
    w_pp, w_mid, w_death = (F.coalesce(F.nullif(F.col(f"w_{p}_economy"), F.lit(0.0)), eco) for p in ("pp", "mid", "death"))
    equal = eco * 100 / 6
    best = F.when((w_pp <= w_mid) & (w_pp <= w_death), pp).when(w_mid <= w_death, mid).otherwise(death)
    one = F.lit(1.0)
    d1 = X.clamp((sr - equal) / F.greatest(equal, one) * 2, -1, 1)
    d2 = X.clamp((best - sr) / F.greatest(sr, one) * 3, -1, 1)
    d3 = X.clamp(avg * 100 / F.greatest(sr, one) / F.greatest(bpw, one) - 1, -1, 1)
    d4 = X.clamp(sr / F.greatest(avg, one) / 5 - dot * 2, -1, 1)
    ground = X.clamp((F.coalesce(bat_factor, one) - 1) * 0.25, -0.25, 0.25) if bat_factor is not None else F.lit(0.0)
    total = X.clamp(d1 * 0.30 + d2 * 0.25 + d3 * 0.25 + d4 * 0.20 + ground, -1, 1)
    verdict = F.when(F.col("edge") > 0.4, "batter dominates").when(F.col("edge") > 0.15, "batter has the edge").when(F.col("edge") > 0, "slight batter advantage").when(F.col("edge") > -0.15, "slight bowler advantage").when(F.col("edge") > -0.4, "bowler has the edge").otherwise("bowler dominates")
    rounded = {n: X.round_half_up(c, 6) for n, c in (("rate_clash", d1), ("phase_threat", d2), ("wicket_vulnerability", d3), ("pressure", d4), ("edge", total))}
    return d.withColumns(rounded).withColumn("verdict", verdict)
