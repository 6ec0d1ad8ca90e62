"""Derived operators on small frames."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from creasework.operators import careers, entities, form, lookups, matchups, ratings, similarity, squads, venues
from creasework.sources import tables


def test_scores_of_constant_and_single_metrics(spark):
    d = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 5.0), (3, None, 5.0)], "player_id long, a double, b double")
    got = {r["player_id"]: r for r in ratings.scored(d, {"x": (F.col("a"), True), "y": (F.col("b"), True), "z": (F.col("a"), False)}).collect()}
    assert all(r["y"] == 50 for r in got.values()) and got[3]["x"] == 50  # a null takes the median
    assert got[1]["x"] < 50 < got[2]["x"] and got[1]["x"] == pytest.approx(100 - got[1]["z"], abs=1e-5)
    assert ratings.scored(d.where("player_id = 1"), {"x": (F.col("a"), True)}).first()["x"] == 50


def test_overall_counts_a_missing_side_as_zero(spark):
    cols = "player_id long, bat_rating double, s_opener double, s_finisher double, s_anchor double, s_pp_sr double, s_death_sr double, s_chase double, adj_average double, adj_strike_rate double"
    bat = spark.createDataFrame([(1, 50.0, *[1.0] * 8)], cols)
    bowl = spark.createDataFrame([(2, 40.0, 1.0, 1.0, 1.0, 6.0)], "player_id long, bowl_rating double, s_pp_bowl double, s_mid_bowl double, s_death_bowl double, adj_economy double")
    got = {r["player_id"]: r["overall_rating"] for r in ratings.overall(bat, bowl).collect()}
    assert got == {1: 30.0, 2: 16.0}


def test_total_rows_skip_null_tournaments_in_the_fine_set(spark):
    d = spark.createDataFrame([(1, "x", 2), (1, None, 3)], "player_id long, tournament string, n int")
    got = {r["tournament"]: r["s"] for r in careers.with_total(d, ["player_id"], [F.sum("n").alias("s")]).collect()}
    assert got == {"ALL": 5, "x": 2}


def test_venue_shrinkage(spark):
    inn = spark.createDataFrame([(f"a{i}", 1, 1, 100, 5, "a") for i in range(5)] + [(f"b{i}", 1, 1, 200, 5, "b") for i in range(5)] + [(f"c{i}", 1, 1, 999, 5, "c") for i in range(4)], "match_id string, n int, innings_number int, total_runs int, total_wickets int, venue_id string").withColumn("innings_id", F.col("match_id"))
    m = inn.select("match_id", "venue_id")
    d = inn.select("match_id", F.lit(True).alias("is_four"), F.lit(False).alias("is_six"), F.lit(True).alias("is_wicket"), F.lit("bowled").alias("wicket_kind"))
    got = {r["venue_id"]: r for r in venues.factors(inn.drop("venue_id"), d, m).collect()}
    assert set(got) == {"a", "b"}  # four first innings are too few
    assert got["a"]["bat_factor"] == pytest.approx((500 + 20 * 150) / 25 / 150, abs=1e-6)
    assert 100 / 150 < got["a"]["bat_factor"] < 1 < got["b"]["bat_factor"] < 200 / 150
    ci = {r["venue_id"]: r for r in venues.factor_intervals(inn.drop("venue_id"), m).collect()}
    assert ci["a"]["bat_factor_lo"] == pytest.approx(100 / 150) and ci["a"]["bat_factor_hi"] == pytest.approx(100 / 150)


def test_form_thresholds(spark):
    rows = [(p, i, float(i), 10) for p, n in ((1, 2), (2, 3), (3, 10)) for i in range(n)]
    s = spark.createDataFrame(rows, "player_id long, at int, runs double, balls int")
    got = {r["player_id"]: r for r in form.last_n(s, ["at"]).collect()}
    assert got[1]["avg_5"] is None and got[2]["avg_5"] == 1.0 and got[3]["avg_5"] == 7.0 and not got[3]["breakout_flag"]
    rolled = {(r["player_id"], r["inning_number"]): r["rolling_avg"] for r in form.rolling(s, ["at"], 5).collect()}
    assert rolled[3, 2] is None and rolled[3, 3] == 1.0 and rolled[3, 10] == 7.0


def test_similarity_against_brute_force(spark):
    import numpy as np

    v = np.random.default_rng(1).normal(size=(60, 5))
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    got = similarity.top_similar(d, 4, block_rows=17).toPandas()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 4)
    np.fill_diagonal(s, -9)
    for i, g in got.sort_values("rank").groupby("id_a"):
        assert g["id_b"].tolist() == np.argsort(-s[i], kind="stable")[:4].tolist()


def test_not_in_ignores_null_opponents(spark):
    split = spark.createDataFrame([(1, 10), (1, 11), (1, None)], "player_id long, opponent_id long")
    teams = spark.createDataFrame([(10,)], "team_id long")
    assert [r["opponent_id"] for r in lookups.opponents_of_kind(split, teams).collect()] == [10]
    assert [r["opponent_id"] for r in lookups.opponents_of_kind(split, teams, False).collect()] == [11]


def test_entities(spark):
    seen = spark.createDataFrame([("u1", "A"), (None, "A"), (None, "B"), ("u2", "A")], "uuid string, name string")
    assert {r["player_key"] for r in entities.resolve_players(seen).collect()} == {"u1", "u2", "B"}
    assert {r["player_key"] for r in entities.resolve_players(seen, by_name=True).collect()} == {"u1", "B"}
    v = spark.createDataFrame([(1, "Old"), (2, "Dup")], "venue_id long, venue string")
    r = spark.createDataFrame([(2, 1, "New"), (9, 1, None), (2, 8, None)], "old_id long, canonical_id long, canonical_name string")
    stay, valid = entities.dedup_venues(v, r)
    assert [tuple(x) for x in stay.collect()] == [(1, "New")] and [tuple(x) for x in valid.collect()] == [(2, 1)]
    players = spark.createDataFrame([("u1", None), ("u2", "x")], "uuid string, bowling_style string")
    codes = spark.createDataFrame([("u1", "OB", 1), ("u1", "SLA", 2), ("u2", "??", 3)], "uuid string, style_code string, position int")
    got = dict(tuple(x) for x in entities.backfill_styles(players, codes, {"OB": "off", "SLA": "slow"}).collect())
    assert got == {"u1": "slow", "u2": "x"}


def test_xi_rating_and_prediction(spark):
    squad = spark.createDataFrame([(s, i, f"{s}{i}") for s in "ab" for i in range(1, 12)], "side string, slot int, player_id string")
    rated = spark.createDataFrame([(f"{s}{i}", 60.0 if s == "a" else 40.0, 50.0, 50.0) for s in "ab" for i in range(1, 12)], "player_id string, bat_rating double, bowl_rating double, s_death_sr double")
    got = {r["side"]: r for r in squads.xi_rating(squad, rated).collect()}
    assert (got["a"]["batting"], got["a"]["depth"], got["b"]["depth"], got["a"]["venue_fit"]) == (60.0, 100.0, 0.0, 50.0)
    venue = spark.createDataFrame([(200.0, 1.0)], "avg_first_inn_runs double, bat_factor double")
    p = squads.match_prediction(squad, rated, venue, "a").first()
    assert (p["first_total"], p["second_total"]) == (185 + 3 + 12, 185 - 3 + 12) and p["first_win_pct"] > 50
    shares = squads.run_shares(squad.where("side = 'a'"), spark.createDataFrame([("a1", 30.0)], "player_id string, expected_runs double"), 160.0)
    assert shares.agg(F.sum("predicted_runs")).first()[0] == pytest.approx(160, abs=1)


def test_predicted_matchup_is_bounded(spark):
    bat = spark.createDataFrame([(1, 0.0, None, 500.0, 10.0, 10.0)], "batter_id long, b_average double, b_strike_rate double, b_pp_sr double, b_mid_sr double, b_death_sr double")
    bowl = spark.createDataFrame([(2, 6.0, 18.0, 40.0, 5.0, 7.0, 9.0)], "bowler_id long, w_economy double, w_strike_rate double, w_dot_pct double, w_pp_economy double, w_mid_economy double, w_death_economy double")
    r = matchups.predicted(bat, bowl).first()
    assert r["phase_threat"] == 1.0 and -1 <= r["edge"] <= 1 and r["rate_clash"] == pytest.approx((120 - 100) / 100 * 2)


def test_tables(spark, tmp_path):
    p = str(tmp_path)
    d = spark.createDataFrame([("x", 1), ("y", 2)], "tournament string, v int")
    tables.overwrite_partitions(d, f"{p}/t", ["tournament"])
    tables.overwrite_partitions(spark.createDataFrame([("x", 9)], "tournament string, v int"), f"{p}/t", ["tournament"])
    assert {(r["tournament"], r["v"]) for r in spark.read.parquet(f"{p}/t").collect()} == {("x", 9), ("y", 2)}
    tables.overwrite(d, f"{p}/u")
    tables.upsert_table(spark, spark.createDataFrame([("y", 7), ("z", 8)], "tournament string, v int"), f"{p}/u", ["tournament"], f"{p}/w")
    assert {(r["tournament"], r["v"]) for r in spark.read.parquet(f"{p}/w").collect()} == {("x", 1), ("y", 7), ("z", 8)}
    spark.createDataFrame([('{"team": "a", "squad": ["p"]}',), ('{"team": "b", "squad": {"playing_xi": ["q"], "bench": ["r"]}}',)], "value string").write.text(f"{p}/presets")
    got = {r["team"]: (r["playing_xi"], r["bench"], r["substitutes"]) for r in tables.read_presets(spark, f"{p}/presets").collect()}
    assert got == {"a": (["p"], [], []), "b": (["q"], ["r"], [])}


def test_models_are_saved_with_their_meta(spark, tmp_path):
    from creasework.operators import models

    rows = [(i, i % 7, float(i % 11), float(i % 5), "s1" if i % 3 else "s2", "abc"[i % 3]) for i in range(300)]
    d = spark.createDataFrame(rows, "innings_id long, player_id long, x double, y double, season string, tournament string").withColumn("label", F.col("x") * 2 + F.col("y"))
    model = models.train(d, ["x", "y"], "label", trees=3, depth=3, least=1, subset="all")
    models.save_model(model, str(tmp_path / "m"), {"features": ["x", "y"], "mae": 0.5})
    back, meta = models.load_model(spark, str(tmp_path / "m"))
    assert meta == {"features": ["x", "y"], "mae": 0.5}
    assert back.transform(d).agg(F.sum("prediction")).first() == model.transform(d).agg(F.sum("prediction")).first()
    assert [tuple(r) for r in models.metrics_table(spark, [str(tmp_path / "m")]).collect()] == [("m", "mae", 0.5)]
    errors = models.fold_errors(d, ["x", "y"], "label", 2, trees=2, depth=2, least=1)
    assert {r["fold"] for r in errors.collect()} == {0, 1} and errors.agg(F.sum("n")).first()[0] == 300
    by = models.errors_by(back.transform(d), "label").collect()
    assert sum(r["innings"] for r in by) == 300 and [r["mae"] for r in by] == sorted(r["mae"] for r in by)
    assert models.split_by_season(d, "s2").where("season <> 's1'").isEmpty()


def test_explorer_and_facets(spark):
    players = spark.createDataFrame([(1, "Ann Lee", "x", "Bowler", 0, None, 70.0), (2, "Bo", "x", "Batter", 9, 60.0, 1.0), (3, "Annika", "y", "Batter", 2, 50.0, 2.0)], "player_id long, name string, country string, role string, innings int, bat_rating double, bowl_rating double")
    ids = lambda **kind: [r["player_id"] for r in lookups.explore(players, **kind).collect()]
    assert ids(least_innings=5) == [2] and ids(least_innings=5, role="Bowler") == [1] and ids(name="ANN") == [3, 1]
    assert ids(ascending=True) == [3, 2, 1] and ids(country="x", by="bowl_rating") == [1, 2]
    v = spark.createDataFrame([("a", "p", None), ("a", "q", "open")], "country string, city string, status string")
    assert {tuple(r) for r in lookups.venue_facets(v, ("country", "city", "status")).collect()} == {("country", "a", 2), ("city", "p", 1), ("city", "q", 1), ("status", "open", 1)}
    assert lookups.venue_filter(v, country="a", city="q", status=None).count() == 1


def test_snapshot_and_restore(spark, tmp_path):
    tables.snapshot(spark.range(3), str(tmp_path / "s"))
    assert tables.restore(spark, str(tmp_path / "s"), str(tmp_path / "t")) and spark.read.parquet(str(tmp_path / "t")).count() == 3
    assert not tables.restore(spark, str(tmp_path / "s"), str(tmp_path / "t"))


@settings(max_examples=25, deadline=None)
@given(st.floats(-8, 8), st.floats(-8, 8))
def test_sigmoid_is_monotonic(a, b):
    import math

    f = lambda z: 100 / (1 + math.exp(-0.8 * z))
    assert (f(a) < f(b)) == (a < b) or abs(a - b) < 1e-9
