"""Ingest of hand-made documents with hand-computed results."""

import json

import pytest
from pyspark.sql import functions as F

from creasework.operators import balls, matchups
from creasework.plans.api import Store
from creasework.sources import match_json
from creasework.streaming.match_stream import ingest_stream, streamed_careers

PEOPLE = {n: f"u{i}" for i, n in enumerate(["A1", "A2", "A3", "B1", "B2", "B3"])}


def ball(batter, bowler, runs=0, extras=None, out=None, kind="bowled", partner="A2", more=None):
    d = {"batter": batter, "non_striker": partner, "bowler": bowler, "runs": {"batter": runs, "extras": sum((extras or {}).values()), "total": runs + sum((extras or {}).values())}}
    if extras:
        d["extras"] = extras
    if out:
        d["wickets"] = [{"player_out": out, "kind": kind}, *(more or [])]
    return d


def document(**info):
    first = [
        ball("A1", "B1", 4),
        ball("A1", "B1", 0, {"wides": 1}),
        ball("A1", "B1", 1, {"noballs": 1}),
        ball("A2", "B1", 0, {"legbyes": 2}),
        ball("A1", "B1", 0, None, "A1", "run out", more=[{"player_out": "A2", "kind": "bowled"}]),
        ball("A2", "B1", 6),
        ball("A2", "B1", 0, None, "A3", "run out"),
    ]
    second = [ball("B1", "A1", 6, partner="B2"), ball("B2", "A1", 6, partner="B1"), ball("B2", "A1", 3, partner="B1")]
    base = {"match_type": "T20", "dates": ["2023-05-01"], "registry": {"people": PEOPLE}, "venue": "Ground", "city": "Town", "teams": ["Reds", "Blues"], "toss": {"winner": "Reds", "decision": "bat"}, "outcome": {"winner": "Blues", "by": {"wickets": 10}}, "season": 2023, "player_of_match": ["B1"]}
    return {"info": base | info, "innings": [{"team": "Reds", "overs": [{"over": 0, "deliveries": first}]}, {"team": "Blues", "target": {"runs": 16}, "overs": [{"over": 6, "deliveries": second}]}]}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("docs")
    docs = {"m1": document(), "odi": document(match_type="ODI"), "old": document(dates=["1999-01-01"]), "none": document(dates=[]), "slash": document(season="2023/24", outcome={"result": "no result"})}
    for name, doc in docs.items():
        (d / f"{name}.json").write_text(json.dumps(doc))
    (d / "broken.json").write_text('{"info": {')
    return d


def test_gates(spark, folder):
    got = match_json.ingest(spark, str(folder), "cup")
    assert {r["source_id"] for r in got.matches.collect()} == {"m1", "slash"}
    assert {r["source_id"]: r["reason"] for r in got.skipped.collect()}["broken"] == "malformed"
    again = match_json.ingest(spark, str(folder), "cup", got.matches.select("source_id"))
    assert again.matches.count() == 0


def test_match_row(spark, folder):
    rows = {r["source_id"]: r for r in match_json.ingest(spark, str(folder), "cup").matches.collect()}
    m = rows["m1"]
    assert (m["season"], m["batting_first"], m["chasing_team_won"], m["win_by_wickets"], m["no_result"]) == ("2023", "Reds", True, 10, False)
    assert rows["slash"]["season"] == "2023/24" and rows["slash"]["no_result"] and rows["slash"]["chasing_team_won"] is None


def test_innings(spark, folder):
    d = match_json.ingest(spark, str(folder), "cup").deliveries.where("match_id = 'm1'")
    bat = {(r["innings_number"], r["batter_id"]): r for r in balls.batter_innings(d).collect()}
    a1 = bat[1, "u0"]
    assert (a1["runs"], a1["balls_faced"], a1["pp_runs"], a1["batting_position"], a1["dismissal_kind"], a1["not_out"]) == (5, 2, 4, 1, "run out", False)
    assert bat[1, "u1"]["not_out"] and (1, "u2") not in bat  # only the first wicket of a ball; out without having faced
    bowl = {(r["innings_number"], r["bowler_id"]): r for r in balls.bowler_innings(d).collect()}
    b1 = bowl[1, "u3"]
    assert (b1["balls_bowled"], b1["runs_conceded"], b1["wickets"], b1["wides"], b1["no_balls"], b1["dot_balls"]) == (5, 10, 0, 1, 1, 2)
    assert balls.bowler_innings(d, charge_illegal=True).where("bowler_id = 'u3'").first()["runs_conceded"] == 13
    inn = {r["innings_number"]: r for r in balls.innings_totals(d).collect()}
    assert (inn[1]["total_runs"], inn[1]["total_wickets"], inn[1]["total_balls"], inn[1]["extras"]) == (15, 2, 5, 4)
    assert inn[2]["total_runs"] == 15 and inn[2]["chase_successful"] is False and inn[2]["required_rr_start"] == 0.8


def test_context(spark, folder):
    d = match_json.ingest(spark, str(folder), "cup").deliveries.where("match_id = 'm1'")
    rows = balls.with_context(d).orderBy("innings_number", "ball_number").collect()
    assert [r["ball_in_over"] for r in rows[:7]] == [1, 0, 0, 2, 3, 4, 5]
    assert rows[0]["crr_at_ball"] is None and rows[7]["crr_at_ball"] == 36.0 and rows[7]["req_rate_at_ball"] == round(10 / 119 * 6, 2)
    assert [r["phase"] for r in rows] == [0] * 7 + [1] * 3


def test_partnerships_keep_all_runs(spark, folder):
    d = match_json.ingest(spark, str(folder), "cup").deliveries.where("match_id = 'm1'")
    p = balls.partnerships(d)
    assert p.agg(F.sum("runs")).first()[0] == 30 and p.where("innings_id = 'm1:1'").count() == 2


def without(*names):
    return {"people": {n: u for n, u in PEOPLE.items() if n not in names}}


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1), (1, 2, 0)])
def test_a_player_has_one_key_whatever_the_order_of_ingests(spark, tmp_path, order):
    """Players whose uuid only some registries have; their balls have the name as key where it is missing."""
    docs = [document(dates=["2023-05-01"], registry=without("A1", "B3")), document(dates=["2023-05-02"]), document(dates=["2023-05-03"], registry=without("A1", "A2", "B1"))]
    store = Store(spark, str(tmp_path / "store"))
    for i in order:
        (tmp_path / f"in{i}").mkdir()
        (tmp_path / f"in{i}" / f"m{i}.json").write_text(json.dumps(docs[i]))
        store.ingest(str(tmp_path / f"in{i}"), "cup")
    d = store.read("deliveries").cache()
    keys = {k for c in ("batter_id", "bowler_id", "non_striker_id", "player_out_id") for (k,) in d.select(c).distinct().collect()}
    assert keys == {"u0", "u1", "u2", "u3", "u4", None}
    runs = {r["batter_id"]: (r["n"], r["runs"]) for r in balls.batter_innings(d).groupBy("batter_id").agg(F.count("*").alias("n"), F.sum("runs").alias("runs")).collect()}
    assert runs == {"u0": (3, 15), "u1": (3, 18), "u3": (3, 18), "u4": (3, 27)}
    assert d.count() == 30 and d.columns == spark.read.parquet(str(tmp_path / "store" / "deliveries")).drop("batch").columns
    d.unpersist()


def test_store_end_to_end(spark, folder, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.all(str(folder), "cup") == {"inserted": 2, "skipped": 4}
    assert store.ingest(str(folder), "cup")["inserted"] == 0
    career = {(r["player_id"], r["tournament"]): r for r in store.read("career_bat").collect()}
    assert career["u0", "ALL"]["runs"] == 10 and career["u0", "cup"]["innings"] == 2
    assert store.profile("u3").first()["bowl_runs"] == 20
    assert store.search("a1").count() == 1


def test_stream_takes_each_document_once(spark, folder, tmp_path):
    for _ in range(2):
        ingest_stream(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state"), "cup").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "matches")).count() == 2
    assert spark.read.parquet(str(tmp_path / "out" / "deliveries")).count() == 20


def test_streamed_careers_equal_those_of_all_matches(spark, folder, tmp_path):
    """Documents that come one by one give the careers, and the people, of one ingest of them all."""
    out, inbox = str(tmp_path / "out"), tmp_path / "inbox"
    inbox.mkdir()
    for f in sorted(folder.glob("*.json")):
        (inbox / f.name).write_bytes(f.read_bytes())
        ingest_stream(spark, str(inbox), out, str(tmp_path / "state"), "cup").awaitTermination()
    store = Store(spark, str(tmp_path / "store"))
    store.ingest(str(folder), "cup")
    store.venue()
    store.metrics()
    order = lambda d: sorted(map(str, (r.asDict() for r in d.select(*sorted(d.columns)).collect())))
    for got, name in zip(streamed_careers(spark, out, store.read("venue_difficulty")), ("career_bat", "career_bowl"), strict=True):
        want = store.read(name)
        assert order(got.select([F.col(c).cast("string") for c in sorted(want.columns)])) == order(want.select([F.col(c).cast("string") for c in sorted(want.columns)]))
    people = spark.read.parquet(f"{out}/people").select("uuid", "name").distinct()
    assert order(people) == order(store.read("people").select("uuid", "name").distinct())
    assert spark.read.parquet(f"{out}/batting_states").select("batch").distinct().count() >= 2


def test_pair_by_tournament_season_and_venue(spark, folder):
    got = match_json.ingest(spark, str(folder), "cup")
    d, m = got.deliveries, match_json.canonical(got.matches)
    pair = d.groupBy("batter_id", "bowler_id").count().orderBy(F.desc("count"), "batter_id", "bowler_id").first()
    rows = matchups.pair_contexts(d, m, pair["batter_id"], pair["bowler_id"]).collect()
    whole = matchups.pair_sums(d.where((F.col("batter_id") == pair["batter_id"]) & (F.col("bowler_id") == pair["bowler_id"])), "batter_id", "bowler_id").first()
    assert {r["tournament"] for r in rows} == {"cup"} and sum(r["runs"] for r in rows) == whole["runs"] and sum(r["balls"] for r in rows) == whole["balls"]
    assert len(rows) == len({(r["season"], r["venue_id"]) for r in rows})
