"""The queries by name: each applies operators to the canonical frames of one data folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creasework import config as C
from creasework.operators import balls, careers, entities, form, incremental, lookups, matchups, models, name_search, neighbours, point_in_time, profiles, ratings, similarity, squads, venues
from creasework.sources.driver_tables import League
from creasework.sources.shared import checkpoint_dir, settle

#: Marks for the driver's short innings; the library's defaults are 100, 50, 30 and 5, 4.
SMALL_RUNS = {"hundred": 30, "fifty": 20, "thirty": 10}
SMALL_HAULS = {"five_wicket_haul": 3, "four_wicket_haul": 2}
_FORM = ("career_avg", "career_sr", "cv", "avg_5", "avg_10", "avg_20", "sr_5", "sr_10", "sr_20", "breakout_delta")


def styles(g: League) -> DataFrame:
    """A static dimension: the style of each bowler by id."""
    labels = F.array(*(F.lit(s) for s in C.STYLES.values()))
    return g.bowler_innings.select("bowler_id").distinct().withColumn("style", F.element_at(labels, (F.col("bowler_id") % 8 + 1).cast("int")))


def series(g: League) -> DataFrame:
    return g.table("events").select(F.col("user_id").alias("player_id"), "ts", "event_id", F.col("value").alias("runs"), (1 + F.col("event_id") % 30).alias("balls"))


def _form(g: League) -> DataFrame:
    return form.last_n(series(g), ["ts", "event_id"])


def _rounded_form(d: DataFrame) -> DataFrame:
    return d.select("player_id", "innings_total", "breakout_flag", *(F.round(c, 6).alias(c) for c in _FORM))


def _countries(g: League) -> DataFrame:
    """National sides: the teams of one region, over all matches."""
    home = g.table("nation").join(F.broadcast(g.table("region").where("r_name = 'ASIA'")), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    return home.select(F.col("n_nationkey").cast("long").alias("team_id")).join(lookups.team_ids(g.matches), "team_id", "left_semi")


def _busiest_pair(g: League) -> tuple[int, int]:
    r = matchups.pair_sums(g.deliveries, "batter_id", "bowler_id").orderBy(F.desc("balls"), "batter_id", "bowler_id").first()
    return r["batter_id"], r["bowler_id"]


def _squads(g: League) -> DataFrame:
    """Two sides: the eleven of teams 4 and 9."""
    return g.spark.range(11).select(F.explode(F.array(F.struct(F.lit("home").alias("side"), (F.lit(44) + F.col("id")).alias("player_id")), F.struct(F.lit("away").alias("side"), (F.lit(99) + F.col("id")).alias("player_id")))).alias("x"), (F.col("id") + 1).cast("int").alias("slot")).select("x.*", "slot")


def _predicted(g: League) -> DataFrame:
    bat = g.career_batting.where("tournament = 'ALL'").select(F.col("player_id").alias("batter_id"), *(F.col(c).alias(f"b_{c}") for c in ("average", "strike_rate", "pp_sr", "mid_sr", "death_sr")))
    bowl = g.career_bowling.where("tournament = 'ALL'").select(F.col("player_id").alias("bowler_id"), *(F.col(c).alias(f"w_{c}") for c in ("economy", "strike_rate", "dot_pct", "pp_economy", "mid_economy", "death_economy")))
    return matchups.predicted(bat, bowl).select("batter_id", "bowler_id", "rate_clash", "phase_threat", "wicket_vulnerability", "pressure", "edge", "verdict")


def _explorer(g: League) -> DataFrame:
    names = g.teams.select(F.col("team_id"), F.col("team").alias("country"))
    players = g.career_batting.where("tournament = 'ALL'").select("player_id", "innings").join(g.overall_ratings.select("player_id", "bat_rating", "bowl_rating"), "player_id", "left")
    players = players.withColumn("team_id", F.floor(F.col("player_id") / 11)).join(F.broadcast(names), "team_id", "left").drop("team_id")
    met = matchups.style_matchups(g.deliveries, styles(g))
    return lookups.explore(players, 10, styles=met, style=C.STYLES["RAF"], strong=True).select("player_id", "country", "innings", "bat_rating", "bowl_rating")


def _venue_top(g: League) -> DataFrame:
    bat = lookups.venue_top_batters(careers.venue_batting(g.batting), 7).select("player_id", F.lit("bat").alias("side"), "innings", F.col("average").alias("value"))
    return bat.union(lookups.venue_top_bowlers(careers.venue_bowling(g.bowling), 7).select("player_id", F.lit("bowl"), "innings", "economy"))


def _matrix(g: League) -> DataFrame:
    n = g.spark.range
    return matchups.matrix(g.deliveries, n(44, 50).withColumnRenamed("id", "batter_id"), n(160, 165).withColumnRenamed("id", "bowler_id"))


def _opponents(g: League, inside: bool) -> DataFrame:
    return lookups.opponents_of_kind(careers.by_opponent(g.batting, g.bowling), _countries(g), inside).select("player_id", "opponent_id", "bat_runs", "bowl_wickets")


def _dedup(g: League) -> DataFrame:
    redirects = g.spark.range(20, 25).select(F.col("id").alias("old_id"), (F.col("id") - 20).alias("canonical_id"), F.lit(None).cast("string").alias("canonical_name"))
    _, valid = entities.dedup_venues(g.venues, redirects)
    return entities.apply_redirects(g.sides.select("match_id", "venue_id"), "venue_id", valid)


def _audit(g: League) -> DataFrame:
    return lookups.audit({"batter_innings": g.batter_innings, "bowler_innings": g.bowler_innings, "innings": g.innings, "matches": g.matches, "nation": g.table("nation"), "region": g.table("region")})


def _profiles(g: League) -> DataFrame:
    marks = balls.milestones(g.batter_innings, g.bowler_innings, SMALL_RUNS, SMALL_HAULS)
    docs = profiles.player_profiles(g.career_batting, g.career_bowling, g.overall_ratings, marks, careers.venue_batting(g.batting), careers.by_opponent(g.batting, g.bowling), careers.position_split(g.batting))
    return profiles.without_nulls(docs)


def _bat_features(g: League) -> DataFrame:
    return models.batting_features(g.batting, g.venue_factors, g.career_batting, g.chase_split)


def _venue(g: League) -> DataFrame:
    return g.venue_factors.where("venue_id = 7")


def _test_season(g: League) -> str:
    """The season with the most matches of those that have one before them."""
    seasons = g.matches.groupBy("season").agg(F.count("*").alias("n"))
    first = seasons.agg(F.min("season").alias("s"))
    r = seasons.join(F.broadcast(first), F.col("season") > F.col("s"), "left_semi").orderBy(F.desc("n"), "season").first()
    return r["season"] if r else ""


#: What features, careers and chases are made of.
_BAT_FACTS = ("innings_id", "player_id", "venue_id", "season", "tournament", "is_chase", "required_rr_start", "chase_won", "not_out", "runs", "balls_faced", "fours", "sixes", "batting_position", *(f"{p}_{w}" for p in ("pp", "mid", "death") for w in ("runs", "balls")))
_BOWL_FACTS = ("innings_id", "player_id", "venue_id", "season", "tournament", "balls_bowled", "runs_conceded", "wickets", "dot_balls", *(f"{p}_{w}" for p in ("pp", "mid", "death") for w in ("balls", "runs", "wickets")))
#: What features and predictions take from a career.
_BAT_CAREER = ("player_id", "tournament", "innings", "adj_average", "adj_strike_rate", "pp_sr", "mid_sr", "death_sr")
_BOWL_CAREER = ("player_id", "tournament", "innings", "adj_economy", "dot_pct", "pp_economy", "mid_economy", "death_economy")


def _bat_settled(g: League, past: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Batting features of all innings, and the careers in them: those of the seasons before past, where it is given. The
    facts are made once, for careers, chases and rows; training and prediction read the features."""
    facts, factors = settle(g.batting.select(*_BAT_FACTS), "batting"), settle(g.venue_factors, "factors")
    known = models.split_by_season(facts, past) if past is not None else facts
    career = settle(careers.career_batting(known, factors).where("tournament = 'ALL'").select(*_BAT_CAREER), "career")
    return settle(models.batting_features(facts, factors, career, careers.chase_split(known)), "features"), career


def _bowl_settled(g: League, past: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The same of bowlers."""
    facts, factors = settle(g.bowling.select(*_BOWL_FACTS), "bowling"), settle(g.venue_factors, "factors")
    known = models.split_by_season(facts, past) if past is not None else facts
    career = settle(careers.career_bowling(known, factors).where("tournament = 'ALL'").select(*_BOWL_CAREER), "career")
    return settle(models.bowling_features(facts, factors, career, least_balls=3), "features"), career


def _holdout(g: League) -> DataFrame:
    season = _test_season(g)
    return models.holdout(_bat_settled(g, season)[0], models.BAT_FEATURES, "runs", season, strict=True)


def _holdout_by_position(g: League) -> DataFrame:
    """Errors by tournament in the held-out season, each innings by the model of its position group."""
    season = _test_season(g)
    d = _bat_settled(g, season)[0]
    own = models.train_by_position(d.where(F.col("season") < season), trees=20)
    return models.errors_by(models.predict_by_position(own, d.where(F.col("season") == season)), "runs")


def _bowling_holdout(g: League) -> DataFrame:
    season = _test_season(g)
    return models.holdout(_bowl_settled(g, season)[0], models.BOWL_FEATURES, "economy_target", season, strict=True, **(models.BOWL_TREES | {"trees": 100}))


def _intervals(g: League) -> DataFrame:
    d = _bat_settled(g)[0]
    model = models.train(d, models.BAT_FEATURES, "runs")
    players = models.two_situations(d.groupBy("player_id").agg(*(F.avg(f).alias(f) for f in models.BAT_FEATURES)))
    keyed = players.withColumn("key", F.struct("player_id", "situation"))
    return models.intervals(model, keyed, models.BAT_FEATURES, "key").select("key.*", "lo", "hi")


def _at_venue(g: League) -> DataFrame:
    """Eight players at one venue."""
    g.venue_factors = settle(g.venue_factors, "factors")
    (bat, bat_career), (bowl, bowl_career) = _bat_settled(g), _bowl_settled(g)
    own = bat_career.where("player_id between 44 and 51").select("player_id", F.col("adj_average").alias("career_adj_avg"), F.col("adj_strike_rate").alias("career_adj_sr"), F.col("innings").alias("career_innings"), "pp_sr", "mid_sr", "death_sr")
    other = bowl_career.select("player_id", F.col("adj_economy").alias("career_adj_econ"), F.col("dot_pct").alias("career_dot_pct"), F.col("innings").alias("career_bowl_inn"), "pp_economy", "mid_economy", "death_economy")
    players = own.join(other, "player_id", "left")
    return models.players_at_venue(models.train(bat, models.BAT_FEATURES, "runs", trees=20), models.train_bowling(bowl, trees=20), players, _venue(g))


def _facets(g: League) -> DataFrame:
    v = g.venues.join(g.venue_factors, "venue_id", "left").withColumn("pitch_type", _pitch_label()).withColumn("status", F.when(F.col("first_innings") >= 20, "busy").otherwise("quiet"))
    return lookups.venue_facets(lookups.venue_filter(v, country="ASIA", status=None), ("country", "venue", "pitch_type", "status"))


def _threats(g: League) -> DataFrame:
    n = g.spark.range
    return matchups.threats(g.deliveries, n(44, 55).withColumnRenamed("id", "batter_id"), n(0, 275).withColumnRenamed("id", "bowler_id"), least=3)


def _captains(g: League) -> DataFrame:
    """What each side's first player had scored before each match, and in how many innings."""
    sides = F.explode(F.array("team1_id", "team2_id"))
    asked = g.matches.select("match_id", "match_date", sides.alias("team_id")).withColumn("player_id", F.col("team_id") * 11)
    sums = {"innings": F.lit(1), "runs": F.col("runs"), "balls": F.col("balls_faced")}
    return point_in_time.figures_at(asked, g.batting, ["player_id"], "match_date", sums)


def _merged(facts: DataFrame, state: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The facts' states of ten batches of matches, merged."""
    return incremental.merged(state(facts.withColumn("tournament", F.concat_ws("#", F.col("match_id") % 10, "tournament"))).withColumns({"batch": F.substring_index("tournament", "#", 1).cast("int"), "tournament": F.substring_index("tournament", "#", -1)}))


def _vectors(g: League) -> DataFrame:
    return g.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))


#: What a ball's score and the result are made of; state and JSON carry no more.
_SCORED = ("innings_id", "innings_number", "ball_number", "over_number", "phase", "is_legal", "is_dot", "total_runs", "target")
_CONTEXT = ("innings_id", "ball_number", "phase", "is_legal", "is_dot", "ball_in_over", "cum_runs", "cum_legal", "crr_at_ball", "req_rate_at_ball")


def _context(g: League) -> DataFrame:
    return balls.with_context(g.deliveries).select(*_CONTEXT)


def _context_streamed(g: League) -> DataFrame:
    """The same from a stream of all balls, a second apart; one of another innings, far later, closes the stream."""
    from creasework.streaming import innings_stream

    folder = f"{checkpoint_dir(g.spark)}/ball_stream-{uuid.uuid4().hex}"
    timed = g.deliveries.select(*_SCORED).withColumn("bowled_at", F.timestamp_seconds("ball_number"))
    timed.write.parquet(f"{folder}/balls")
    last = timed.limit(1).withColumns({"innings_id": F.lit(-1).cast("long"), "bowled_at": F.timestamp_seconds(F.lit(10**9))})
    last.write.mode("append").parquet(f"{folder}/balls")
    innings_stream.score_table(g.spark, f"{folder}/balls", f"{folder}/scores", f"{folder}/state", "bowled_at", late="5000 days").awaitTermination()
    return g.spark.read.parquet(f"{folder}/scores").where("innings_id >= 0").select(*_CONTEXT)


def _name_search(g: League) -> DataFrame:
    """Parts by patterns of their names, through an index of trigrams that is made of all names first."""
    index = f"{checkpoint_dir(g.spark)}/name_index-{uuid.uuid4().hex}"
    name_search.add(g.table("part").select("p_partkey", "p_name"), "p_name", index)
    found = [name_search.find(g.spark, index, "p_name", p).withColumn("pattern", F.lit(p)) for p in ("%BLUE%", "%d gi_m%", "hot%ge%", "%no such%", "%o_t")]
    return reduce(DataFrame.unionByName, found)


PLANS: dict[str, Callable[[League], DataFrame]] = {
    "ball_context": _context,
    "ball_context_streamed": _context_streamed,
    "innings_totals": lambda g: g.innings.withColumn("chase_successful", F.col("chase_successful").cast("int")),
    "batter_innings": lambda g: g.batter_innings,
    "bowler_innings": lambda g: g.bowler_innings,
    "milestones": lambda g: balls.milestones(g.batter_innings, g.bowler_innings, SMALL_RUNS, SMALL_HAULS),
    "partnerships": lambda g: balls.partnerships(g.deliveries),
    "career_batting": lambda g: g.career_batting,
    "career_bowling": lambda g: g.career_bowling,
    "chase_split": lambda g: g.chase_split,
    "position_split": lambda g: careers.position_split(g.batting),
    "venue_batting": lambda g: careers.venue_batting(g.batting),
    "venue_bowling": lambda g: careers.venue_bowling(g.bowling),
    "by_opponent": lambda g: careers.by_opponent(g.batting, g.bowling),
    "by_team": lambda g: careers.by_team(g.batting, g.bowling),
    "by_result": lambda g: careers.by_result(g.batting, g.bowling),
    "by_season": lambda g: careers.by_season(g.batting, g.bowling),
    "dismissal_batting": lambda g: careers.dismissals_batting(g.batting),
    "dismissal_bowling": lambda g: careers.dismissals_bowling(g.deliveries),
    "caught_and_bowled": lambda g: careers.caught_and_bowled(g.deliveries, g.matches),
    "style_matchups": lambda g: matchups.style_matchups(g.deliveries, styles(g)),
    "venue_factors": lambda g: g.venue_factors,
    "venue_factor_ci": lambda g: venues.factor_intervals(g.innings, g.matches),
    "pitch_labels": lambda g: g.venue_factors.select("venue_id", _pitch_label()),
    "batting_ratings": lambda g: g.batting_ratings,
    "bowling_ratings": lambda g: g.bowling_ratings,
    "overall_ratings": lambda g: g.overall_ratings,
    "compare_players": lambda g: ratings.compare(g.overall_ratings, 50, 51),
    "leaderboard": lambda g: lookups.leaderboard(g.overall_ratings),
    "explorer_filter": _explorer,
    "breakouts": lambda g: _rounded_form(form.breakouts(_form(g))),
    "venue_extremes": lambda g: lookups.venue_extremes(g.venue_factors.select("venue_id", "bat_factor")),
    "venue_top_players": _venue_top,
    "form_last_n": lambda g: _rounded_form(_form(g)),
    "rolling_form": lambda g: form.rolling(series(g), ["ts", "event_id"]).select("player_id", "inning_number", F.round("rolling_avg", 6).alias("rolling_avg"), F.round("rolling_sr", 6).alias("rolling_sr")),
    "role_similarity": lambda g: similarity.top_similar(_vectors(g)),
    "nearest_vectors": lambda g: neighbours.top_similar(g.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))),
    "batter_vs_bowler": lambda g: matchups.batter_vs_bowlers(g.deliveries, 100),
    "pair_phase": lambda g: matchups.pair_phases(g.deliveries, *_busiest_pair(g)),
    "all_opponents_of_bowler": lambda g: matchups.bowler_vs_batters(g.deliveries, 100),
    "matchup_matrix": _matrix,
    "matchup_extremes": lambda g: matchups.extremes(matchups.with_rates(matchups.pair_sums(g.deliveries, "batter_id", "bowler_id")), least=3).select("batter_id", "bowler_id", "balls", "strike_rate", "dismissals", "list"),
    "dismissal_phase_pivot": lambda g: matchups.dismissal_phases(g.deliveries),
    "predicted_matchup": _predicted,
    "country_opponents_semi": lambda g: _opponents(g, True),
    "club_opponents_anti": lambda g: _opponents(g, False),
    "all_team_ids": lambda g: lookups.team_ids(g.matches),
    "shared_venues": lambda g: lookups.shared_venues(careers.venue_batting(g.batting), 50, 51),
    "missing_ids": lambda g: lookups.missing_ids(g.table("customer").select(F.col("c_custkey").alias("id")), g.table("orders").select(F.col("o_custkey").alias("id"))),
    "match_profiles": lambda g: profiles.match_profiles(g.matches, g.teams, g.venues).select("match_id", "tournament", "season", "match_date", "team1", "team2", "toss_winner", "winner", "venue"),
    "player_profiles": _profiles,
    "venue_dedup": _dedup,
    "style_coverage": lambda g: entities.style_coverage(g.deliveries, styles(g).where("bowler_id % 8 < 5")),
    "coverage_by_tournament": lambda g: lookups.coverage(g.matches),
    "matches_per_year": lambda g: lookups.matches_per_year(g.matches),
    "table_audit": _audit,
    "name_search": _name_search,
    "xi_rating": lambda g: squads.xi_rating(_squads(g), g.overall_ratings, _venue(g)),
    "match_prediction": lambda g: squads.match_prediction(_squads(g), g.overall_ratings, _venue(g), "home"),
    "batting_features": lambda g: _bat_features(g).drop("season", "tournament"),
    "bowling_features": lambda g: models.bowling_features(g.bowling, g.venue_factors, g.career_bowling, least_balls=3).drop("season"),
    "bowling_features_before": lambda g: point_in_time.bowling_features(g.bowling, g.venue_factors, least_balls=3).drop("season"),
    "batting_features_before": lambda g: point_in_time.batting_features(g.batting, g.venue_factors).drop("season", "tournament"),
    "captains_before_match": _captains,
    "career_batting_merged": lambda g: incremental.career_batting(_merged(g.batting, incremental.batting_state), g.venue_factors),
    "career_bowling_merged": lambda g: incremental.career_bowling(_merged(g.bowling, incremental.bowling_state), g.venue_factors),
    "venue_facets": _facets,
    "matchup_threats": _threats,
    "gbm_holdout_eval": _holdout,
    "gbm_holdout_by_position": _holdout_by_position,
    "gbm_bowling_holdout": _bowling_holdout,
    "players_at_venue": _at_venue,
    "prediction_interval": _intervals,
}


def _pitch_label():
    from creasework.functions.exprs import pitch_label

    return pitch_label().alias("label")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, plan=plan: plan(League(spark, sf_dir))) for name, plan in PLANS.items()}
