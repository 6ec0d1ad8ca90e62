"""Point-in-time figures, neighbours by hyperplanes, search for settings, states that merge, bucketed tables."""

import datetime
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from creasework.operators import careers, incremental, models, neighbours, point_in_time, search, similarity
from creasework.sources import tables
from creasework.sources.driver_tables import League

SF = "/root/testdata/sf0.001"
DAY = datetime.date(2020, 1, 1)


# --- figures before a day ----------------------------------------------------------------------------------------


def test_asof_join_against_brute_force(spark, monkeypatch):
    draw = random.Random(3)
    day = lambda: None if draw.random() < 0.05 else DAY + datetime.timedelta(draw.randint(0, 400))
    key = lambda: draw.choice(["a", "b", "c", None])
    left = [(i, key(), day()) for i in range(300)]
    right = list({(k, t): (k, t, draw.choice([None, draw.randint(0, 99)]), f"s{i}") for i, (k, t) in enumerate((key(), day()) for _ in range(120))}.values())
    a, b = spark.createDataFrame(left, "id int, k string, t date"), spark.createDataFrame(right, "k string, t date, v int, w string")
    for width in (1, 7, 64, 10_000):
        monkeypatch.setattr(point_in_time, "SLICE_DAYS", width)
        for strict in (True, False):
            got = {r["id"]: (r["v"], r["w"]) for r in point_in_time.asof_join(a, b, ["k"], "t", ["v", "w"], strict).collect()}
            assert len(got) == len(left)
            for i, k, t in left:
                before = [r for r in right if r[0] == k and r[1] and t and (r[1] < t or (not strict and r[1] == t))]
                assert got[i] == (max(before, key=lambda r: r[1])[2:] if before else (None, None)), (i, k, t, width, strict)


def test_a_later_innings_changes_no_earlier_feature(spark):
    """An innings that is moved to a later day, or scores more, shows in features of later days only."""
    g = League(spark, SF)
    facts = g.bowling.cache()
    someone = facts.groupBy("player_id").count().orderBy(F.desc("count"), "player_id").first()["player_id"]
    days = [r["match_date"] for r in facts.where(F.col("player_id") == someone).select("match_date").distinct().orderBy("match_date").collect()]
    middle = days[len(days) // 2]
    here = (F.col("player_id") == someone) & (F.col("match_date") == middle)
    changed = facts.withColumn("runs_conceded", F.when(here, F.col("runs_conceded") + 50).otherwise(F.col("runs_conceded")))
    columns = ["adj_economy", "innings", "pp_economy"]
    old, new = ({r["match_date"]: [r[c] for c in columns] for r in point_in_time.bowling_before(f, g.venue_factors).where(F.col("player_id") == someone).collect()} for f in (facts, changed))
    assert all(old[d] == new[d] for d in days if d <= middle) and all(old[d] != new[d] for d in days if d > middle)
    first = point_in_time.bowling_before(facts, g.venue_factors).where(F.col("player_id") == someone).orderBy("match_date").first()
    assert first["innings"] is None and first["adj_economy"] is None
    facts.unpersist()


def test_facts_of_one_day_do_not_count_for_each_other(spark):
    rows = [("p", DAY, 10), ("p", DAY, 20), ("p", DAY + datetime.timedelta(1), 5), ("p", None, 99), ("q", DAY, 1)]
    facts = spark.createDataFrame(rows, "k string, day date, n int")
    got = {(r["k"], r["day"]): (r["s"], r["s_before"]) for r in point_in_time.daily_totals(facts, ["k"], "day", {"s": F.col("n")}).collect()}
    assert got == {("p", DAY): (30, None), ("p", rows[2][1]): (5, 30), ("q", DAY): (1, None)}
    asked = spark.createDataFrame([("p", rows[2][1] + datetime.timedelta(9)), ("p", DAY), ("z", DAY), ("p", None)], "k string, day date")
    found = sorted((r["k"], str(r["day"]), r["s"]) for r in point_in_time.figures_at(asked, facts, ["k"], "day", {"s": F.col("n")}).collect())
    assert found == [("p", "2020-01-01", 0), ("p", "2020-01-11", 35), ("p", "None", 0), ("z", "2020-01-01", 0)]


# --- neighbours --------------------------------------------------------------------------------------------------


def vectors(spark, x, ids=None):
    return spark.createDataFrame(pd.DataFrame({"id": range(len(x)) if ids is None else ids, "vector": [list(map(float, v)) for v in x]}), "id long, vector array<double>")


def test_hyperplanes_find_most_neighbours(spark):
    """Clustered vectors, buckets much smaller than all: recall of the 20 nearest against the exact query."""
    r = np.random.default_rng(5)
    x = np.repeat(r.standard_normal((40, 24)), 40, axis=0) + 0.5 * r.standard_normal((1600, 24))
    v = vectors(spark, x).cache()
    found = neighbours.top_similar(v, 20, tables=12, probes=6, crowd=128).cache()
    exact = similarity.top_similar(v, 20, block_rows=800)
    assert found.count() == 1600 * 20 and neighbours.recall(found, exact) >= 0.9
    best = {(a["id_a"], a["id_b"]): a["similarity"] for a in found.limit(200).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert all(abs(s - unit[a] @ unit[b]) <= 6e-5 for (a, b), s in best.items())


def test_recall_on_the_given_embeddings(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id as id", "cast(embedding as array<double>) as vector")
    found = neighbours.top_similar(v, 20, crowd=64)
    assert neighbours.recall(found, similarity.top_similar(v, 20)) >= 0.9


def test_equal_vectors_come_first_and_crowds_are_cut_in_blocks(spark):
    """A third of all rows are one vector, another third lies so close together that no code parts it."""
    r = np.random.default_rng(6)
    same, near, rest = np.tile(r.standard_normal(8), (100, 1)), r.standard_normal(8) + 1e-9 * r.standard_normal((100, 8)), r.standard_normal((100, 8))
    x = np.concatenate((same, near, rest, np.zeros((2, 8))))
    v = vectors(spark, x)
    got = neighbours.top_similar(v, 5, tables=6, probes=3, crowd=16).toPandas()
    assert got.groupby("id_a").size().loc[:299].min() == 5
    of_same = got[got.id_a < 100]
    assert (of_same.similarity == 1.0).all() and of_same[of_same.id_a == 0].id_b.tolist() == [1, 2, 3, 4, 5] and of_same[of_same.id_a == 3].id_b.tolist() == [0, 1, 2, 4, 5]
    exact = similarity.top_similar(v, 5).toPandas()
    both = [d[(d.id_a >= 100) & (d.id_a < 200)].sort_values(["id_a", "rank"]).id_b.tolist() for d in (got, exact)]
    assert both[0] == both[1]
    assert neighbours.top_similar(vectors(spark, np.zeros((0, 8))), 5).count() == 0


# --- search ------------------------------------------------------------------------------------------------------

SPACE = {"x": search.Number(-5, 5), "y": search.Number(1e-3, 1e3, log=True), "n": search.Number(1, 20, whole=True), "kind": search.Choice(("a", "b", "c"))}


def loss(s, step=0):
    return (s["x"] - 2) ** 2 + math.log10(s["y"] / 10) ** 2 + 0.05 * abs(s["n"] - 7) + {"a": 1.0, "b": 0.0, "c": 2.0}[s["kind"]] + 0.01 * step


def test_search_beats_as_many_random_settings():
    wins = 0
    for seed in range(10):
        found = search.minimise(loss, SPACE, trials=60, side_by_side=4, seed=seed)
        r = np.random.default_rng(1000 + seed)
        wins += found[0].loss < min(loss(search.drawn(SPACE, r)) for _ in range(60))
        assert len(found) == 60 and all(-5 <= t.setting["x"] <= 5 and isinstance(t.setting["n"], int) and 1 <= t.setting["n"] <= 20 for t in found)
    assert wins >= 8


def test_poor_settings_are_stopped_early_and_threads_decide_nothing():
    seen = []

    def judge(s, step):
        seen.append(step)
        return loss(s, step)

    found = search.minimise(judge, SPACE, trials=40, steps=9, side_by_side=4, seed=3)
    assert len(seen) < 40 * 9 / 2 and len(found[0].losses) == 9 and found[0].loss == min(t.loss for t in found if len(t.losses) == 9)
    again = search.minimise(judge, SPACE, trials=40, steps=9, side_by_side=4, seed=3)
    assert [t.setting for t in again] == [t.setting for t in found]


def test_settings_are_found_without_the_held_out_season(spark):
    r = random.Random(1)
    rows = [(i, i % 20, float(a), float(b), 3.0 * a + b, "2024" if i % 4 == 0 else "2023") for i in range(400) for a, b in [(r.random(), r.random())]]
    d = spark.createDataFrame(rows, "innings_id long, player_id long, a double, b double, y double, season string")
    wild = d.withColumn("y", F.when(F.col("season") == "2024", F.col("y") + 1e6).otherwise(F.col("y")))
    space = {"trees": search.Number(2, 6, whole=True), "depth": search.Number(1, 3, whole=True), "share": search.Choice((1.0,)), "subset": search.Choice(("all",))}
    how = {"trials": 3, "side_by_side": 3, "at_random": 2, "seed": 1, "folds": 2}
    one, two = (models.find_settings(x.withColumn("least", F.lit(1)), ["a", "b"], "y", space, "2024", **how) for x in (d, wild))
    assert [t.setting for t in one] == [t.setting for t in two] and one[0].loss < 10
    assert np.allclose([t.loss for t in one], [t.loss for t in two])  # the wild season is not seen
    report = models.settings_report(d, ["a", "b"], "y", "2024", {"found": one[0].setting | {"least": 1}, "stump": {"trees": 1, "depth": 1, "least": 1}}).collect()
    assert {r["model"] for r in report} == {"found", "stump"} and report[0]["n"] == 100


# --- states ------------------------------------------------------------------------------------------------------


def same(a, b):
    a, b = (x.toPandas().sort_values(["player_id", "tournament"]).reset_index(drop=True) for x in (a, b))
    assert sorted(a.columns) == sorted(b.columns)
    pd.testing.assert_frame_equal(a[sorted(a.columns)], b[sorted(a.columns)], check_dtype=False)


def test_ten_batches_equal_one_rebuild_and_replays_change_nothing(spark, tmp_path):
    g = League(spark, SF)
    bat, bowl = g.batting.cache(), g.bowling.cache()
    factors = g.venue_factors.cache()
    paths = {"bat": str(tmp_path / "bat"), "bowl": str(tmp_path / "bowl")}
    for k in [*range(10), 3, 9, 3]:  # three come again
        mine = F.pmod("match_id", F.lit(10)) == k
        incremental.add_batch(incremental.batting_state(bat.where(mine)), paths["bat"], k)
        incremental.add_batch(incremental.bowling_state(bowl.where(mine)), paths["bowl"], k)
    same(incremental.career_batting(incremental.states(spark, paths["bat"]), factors), careers.career_batting(bat, factors))
    same(incremental.career_bowling(incremental.states(spark, paths["bowl"]), factors), careers.career_bowling(bowl, factors))
    incremental.compact(spark, paths["bat"], str(tmp_path / "one"))
    whole = incremental.states(spark, str(tmp_path / "one"))
    assert whole.select("batch").distinct().count() == 1
    same(incremental.career_batting(whole, factors), careers.career_batting(bat, factors))
    for d in (bat, bowl, factors):
        d.unpersist()


# --- buckets -----------------------------------------------------------------------------------------------------


def plan_of(d):
    return d._jdf.queryExecution().executedPlan().toString()


def rows_of_scan(d):
    """Rows that the scans of an executed frame gave."""
    d.collect()
    out, todo = [], [d._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if "AdaptiveSparkPlan" in p.nodeName():
            p = p.executedPlan()
        if p.nodeName().startswith("Scan"):
            out.append(p.metrics().get("numOutputRows").get().value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return sum(out)


def test_bucketed_tables_join_without_a_shuffle_and_lookups_skip_row_groups(spark, tmp_path):
    g = League(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        paths = {n: f"file:{tmp_path}/{n}" for n in ("balls_b", "matches_b")}
        tables.write_bucketed(g.deliveries, paths["balls_b"], "balls_b", "match_id", 4, ["innings_id", "ball_number"])
        tables.write_bucketed(g.matches, paths["matches_b"], "matches_b", "match_id", 4, [])
        for opened in (spark.table, lambda n: tables.open_bucketed(spark, paths[n], n)):
            star = opened("balls_b").join(opened("matches_b"), "match_id")
            assert "Exchange" not in plan_of(star) and "SortMergeJoin" in plan_of(star)
            assert star.count() == g.deliveries.join(g.matches, "match_id").count()
            runs = opened("balls_b").groupBy("match_id").agg(F.sum("total_runs"))
            assert "Exchange" not in plan_of(runs)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    wide = spark.range(60_000).selectExpr("id % 4 as part", "uuid() as noise", "concat('p', cast(xxhash64(id) as string)) as player", "id")
    d = tables.write_bucketed(wide.repartition(4), f"file:{tmp_path}/people_b", "people_b", "part", 4, ["id"], look_up=["player"], row_group_bytes=100_000)
    one = d.where("id = 31415").first()["player"]
    found = d.where(F.col("player") == one)
    assert rows_of_scan(found) < 60_000 / 3 and found.count() == 1
    assert rows_of_scan(d.where(F.col("player") == "p-nobody")) == 0
    for n in ("balls_b", "matches_b", "people_b"):
        spark.sql(f"drop table if exists {n}")


@pytest.fixture(autouse=True)
def in_tmp(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
