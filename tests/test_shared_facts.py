"""Facts that many queries share: whole, and moved as little as they need to be."""

import duckdb
import pytest

import __spark_entry__ as entry
from creasework.operators import balls, ratings
from creasework.sources.driver_tables import League

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()


@pytest.fixture(scope="module")
def unplayed(spark, tmp_path_factory):
    """sf0.001 without the orders of every fifth customer."""
    folder = tmp_path_factory.mktemp("unplayed")
    for t in TABLES:
        d = spark.read.parquet(f"{SF}/{t}.parquet")
        (d.where("o_custkey % 5 <> 0") if t == "orders" else d).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


def test_venues_of_matches_that_were_not_played_are_merged_too(spark, unplayed):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{unplayed}/{t}.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["venue_dedup"]).fetchall()
    got = entry.queries()["venue_dedup"](spark, unplayed).select("match_id", "venue_id").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def moves(d):
    return d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_settled_balls_stay_by_match(spark):
    """Windows, groups and joins within matches move no rows; before, each moved all of them."""
    g = League(spark, SF)
    assert moves(balls.with_context(g.deliveries)) == 0
    assert moves(g.batting) == moves(g.bowling) == 0


def test_lines_move_twice(spark):
    """By order and by match; windows over the innings and the match share the second and one sort."""
    plan = balls.with_flags(League(spark, SF).raw_deliveries)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") == 2 and plan.count("Sort [") == 1 and plan.count("SortMergeJoin") == 0


def test_dismissals_of_players_that_were_not_on_strike(spark):
    """Player 3 is out without having been on strike, 2 at the other end; 1 faces the ball."""
    shape = "match_id long, innings_id long, innings_number int, ball_number int, over_number int, batter_id long, bat_runs int, is_legal boolean, is_four boolean, is_six boolean, phase int, is_wicket boolean, player_out_id long, wicket_kind string"
    row = lambda n, who, out, kind, innings=10: (1, innings, 1, n, 1, who, 1, True, False, False, 0, out is not None, out, kind)
    d = spark.createDataFrame([row(1, 1, 2, "run out"), row(2, 2, None, None), row(3, 1, 3, None), row(4, 1, 2, "bowled"), row(1, 2, None, None, 11), row(2, 4, 4, None, 11)], shape)
    got = {(r["innings_id"], r["batter_id"]): (r["runs"], r["batting_position"], r["dismissal_kind"], r["not_out"]) for r in balls.batter_innings(d).collect()}
    assert got == {(10, 1): (3, 1, None, True), (10, 2): (1, 2, "run out", False), (11, 2): (1, 1, None, True), (11, 4): (1, 2, "unknown", False)}


def test_what_is_rated_is_computed_once(spark):
    """The statistics and the scores read the players' rows, not the facts twice."""
    files = ratings.bowling(League(spark, SF).career_bowling).inputFiles()
    assert files and not any("deliveries" in f for f in files)
