"""Parts that no query reaches, by hand-computed cases."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from creasework.operators import lookups, matchups, models, squads
from creasework.plans import api
from creasework.sources import tables
from creasework.sources.driver_tables import League, forget
from creasework.streaming.match_stream import event_rates


def test_value_counts_and_samples(spark):
    d = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "v string")
    assert [tuple(r) for r in lookups.value_counts(d, "v").collect()] == [("a", 2), (None, 1), ("b", 1)]
    rows, n = lookups.sample_and_count({"t": d, "empty": d.limit(0)}, 2)["t"]
    assert rows.count() == 2 and n == 4 and lookups.sample_and_count({"e": d.limit(0)})["e"][1] == 0


def test_edges_between_sides(spark):
    sides = spark.createDataFrame([("x", 60.0, 50.0, 40.0, 50.0, 51.0), ("y", 50.0, 54.0, 50.0, 50.0, None)], "side string, batting double, bowling double, depth double, venue_fit double, overall double")
    got = {r["dimension"]: r["edge"] for r in squads.edges(sides, "x", "y").collect()}
    assert got == {"batting": "x", "bowling": "even", "depth": "y", "venue_fit": "even", "overall": "even"}


def test_documents_and_copies(spark, tmp_path):
    d = spark.createDataFrame([(1, None, datetime.date(2020, 1, 2)), (2, "b", None)], "id long, name string, day date")
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    d.write.parquet(f"{source}/t.parquet")
    assert tables.copy_tables(spark, source, target, ["t"]) == {"t": 2}
    got = {json.loads(r["value"])["id"]: json.loads(r["value"]) for r in spark.read.text(f"{target}/t").collect()}
    assert got[1]["day"].startswith("2020-01-02T00:00:00") and got[2]["name"] == "b"
    docs = d.select(F.to_json(F.struct("id", "name")).alias("value"))
    assert sorted(r["value"] for r in docs.collect()) == ['{"id":1}', '{"id":2,"name":"b"}']


def test_lagged_rates_and_importances(spark):
    day = lambda k: datetime.date(2020, 1, k)
    rows = [("p", day(1), 1, 10, 5), ("p", day(2), 2, 30, 10), ("p", day(3), 3, 0, 4), ("q", day(1), 1, 8, 0)]
    d = spark.createDataFrame(rows, "player_id string, match_date date, innings_id int, pp_runs int, pp_balls int")
    d = d.withColumns({f"{p}_{w}": F.lit(1) for p in ("mid", "death") for w in ("runs", "balls")})
    got = {(r["player_id"], r["innings_id"]): r["pp_sr_before"] for r in models.lagged_phase_rates(d).collect()}
    assert got == {("p", 1): None, ("p", 2): 200.0, ("p", 3): round(40 * 100 / 15, 2), ("q", 1): None}
    train = spark.createDataFrame([(float(i % 7), float(i % 3), 5.0 * (i % 7)) for i in range(200)], "a double, b double, y double")
    model = models.train(train, ["a", "b"], "y", trees=3, depth=3, least=1, share=1.0, subset="all")
    found = models.importances(model, ["a", "b"])
    assert found[0][0] == "a" and found[0][1] > 0.9 and abs(sum(x for _, x in found) - 1) < 1e-9
    scaled = models.scaled_features(model, train).agg(F.avg(F.col("scaled_features")[0]), F.stddev_samp(F.col("scaled_features")[0])).first()
    assert abs(scaled[0]) < 1e-9 and abs(scaled[1] - 1) < 1e-9


def test_rates_of_an_event_stream(spark, tmp_path):
    at = lambda m, s: datetime.datetime(2024, 1, 1, 10, m, s)
    spark.createDataFrame([(at(0, 5), "x", 1.0), (at(4, 59), "x", 2.0), (at(5, 0), "x", 4.0), (at(1, 0), "y", 8.0)], "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "e"))
    q = event_rates(stream).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["event_type"], r["m"]): (r["n"], r["total"]) for r in spark.sql("select event_type, minute(window.start) as m, n, total from rates").collect()}
    assert got == {("x", 0): (2, 3.0), ("x", 5): (1, 4.0), ("y", 0): (1, 8.0)}


def test_threats_take_any_number_of_ids(spark, monkeypatch):
    """More ids than may be broadcast give the same rows as few: none is left out."""
    d = spark.createDataFrame([(i % 40, 100 + i % 30, i % 5, i % 7 == 0) for i in range(3000)], "batter_id long, bowler_id long, bat_runs int, is_wicket boolean")
    bat, bowl = spark.range(40).withColumnRenamed("id", "batter_id"), spark.range(100, 130).withColumnRenamed("id", "bowler_id")
    want = matchups.threats(d, bat, bowl).collect()
    monkeypatch.setattr(matchups, "CELLS", 3)
    assert matchups.threats(d, bat, bowl).collect() == want and len(want) == 120


def test_facts_are_settled_once_and_results_are_not(spark, monkeypatch):
    from creasework.sources import driver_tables

    made = []
    monkeypatch.setattr(driver_tables, "settle", lambda df, name, settle=driver_tables.settle: made.append(name) or settle(df, name))
    forget()
    for _ in range(2):
        g = League(spark, "/root/testdata/sf0.001")
        assert g.career_batting.count() and g.venue_factors.count() and g.overall_ratings is not None
    assert sorted(made) == ["deliveries", "innings", "matches"]


def test_command_line(spark, tmp_path, capsys):
    spark.createDataFrame([("v1", 1.0), ("w1", 2.0)], "venue_id string, bat_factor double").write.parquet(str(tmp_path / "venue_difficulty"))
    api.main(["venue-info", str(tmp_path), "v%"])
    out = capsys.readouterr().out
    assert "v1" in out and "w1" not in out
    with pytest.raises(AttributeError):
        api.main(["no-such-thing", str(tmp_path)])
