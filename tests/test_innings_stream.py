"""Running scores over a stream against those of the batch."""

import pytest
from pyspark.sql import functions as F

from creasework.operators import balls
from creasework.sources.driver_tables import League
from creasework.streaming import innings_stream

SF = "/root/testdata/sf0.001"
FLUSH = "2000-01-03 00:00:00"


@pytest.fixture(scope="module")
def timed(spark):
    """Balls of 40 innings, one each ten seconds, innings one after another by a minute; with a date and a null column."""
    d = League(spark, SF).deliveries.where("match_id <= 40")
    at = F.timestamp_micros(946_684_800_000_000 + F.col("ball_number") * 10_000_000 + F.col("match_id") * 60_000_000 + 123_456)
    return d.withColumn("bowled_at", at).withColumn("day", F.to_date("bowled_at")).withColumn("note", F.lit(None).cast("string")).cache()


def flush(timed):
    """A ball of another innings, far later: it moves the watermark past all others."""
    return timed.limit(1).withColumns({"innings_id": F.lit(-1).cast("long"), "bowled_at": F.lit(FLUSH).cast("timestamp"), "day": F.lit(None).cast("date")})


def put(d, folder):
    d.coalesce(1).write.mode("append").parquet(str(folder))


def rows(d):
    names = sorted(d.columns)
    return sorted(map(repr, d.where("innings_id >= 0").select(names).collect()))


def run(spark, tmp_path, **options):
    innings_stream.score_table(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), "bowled_at", **options).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_any_order_and_a_restart_give_the_scores_of_the_batch(spark, timed, tmp_path):
    """Balls in random order over four files, a part of them twice; the query ends and starts again between files."""
    want = rows(balls.with_context(timed))
    dealt = timed.withColumn("_part", F.abs(F.hash("innings_id", "ball_number")) % 4)
    for part in range(4):
        put(dealt.where(F.col("_part") == part).drop("_part").orderBy(F.rand(part)), tmp_path / "in")
        put(dealt.where((F.col("_part") == part) & (F.col("ball_number") % 7 == 0)).drop("_part"), tmp_path / "in")
        got = run(spark, tmp_path, late="1 day", files_per_trigger=1)
    assert got.count() == 0
    put(flush(timed), tmp_path / "in")
    got = run(spark, tmp_path, late="1 day")
    assert dict(got.dtypes) == dict(balls.with_context(timed).dtypes)
    assert rows(got) == want and len(want) > 1000


def test_scores_go_out_as_the_watermark_moves(spark, timed, tmp_path):
    """Files in order of time: finished balls go out, later ones wait; balls that are repeated or too late change nothing."""
    want = rows(balls.with_context(timed))
    cut = F.lit("2000-01-01 00:25:00").cast("timestamp")
    put(timed.where(F.col("bowled_at") < cut), tmp_path / "in")
    first = run(spark, tmp_path, late="2 minutes")
    seen = rows(first)
    edge = timed.where(F.col("bowled_at") < cut).agg(F.max("bowled_at") - F.expr("interval 2 minutes")).first()[0]
    assert seen == rows(balls.with_context(timed).where(F.col("bowled_at") < F.lit(edge))) and 0 < len(seen) < len(want)
    put(timed, tmp_path / "in")  # all of them, the old ones again
    put(flush(timed), tmp_path / "in")
    assert rows(run(spark, tmp_path, late="2 minutes")) == want


def test_a_closed_innings_leaves_no_state(spark, timed, tmp_path):
    """After the pause an innings is gone from the state; its balls come too late then."""
    put(timed, tmp_path / "in")
    put(flush(timed), tmp_path / "in")
    run(spark, tmp_path, late="1 second", pause_seconds=600)
    put(timed.limit(20), tmp_path / "in")
    query = innings_stream.score_table(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), "bowled_at", late="1 second", pause_seconds=600)
    query.awaitTermination()
    store = innings_stream.stateful_session(spark)
    left = store.read.format("statestore").option("stateVarName", "score").load(str(tmp_path / "state"))
    assert {r["key"]["innings_id"] for r in left.select("key").collect()} <= {-1}
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(balls.with_context(timed))


def test_balls_without_key_or_time_and_null_runs(spark, tmp_path):
    day = "timestamp'2000-01-01 00:00:0"
    shape = "innings_id long, innings_number int, ball_number int, over_number int, total_runs int, is_legal boolean, target int"
    d = spark.createDataFrame([(1, 2, 1, 1, 4, True, 10), (1, 2, 2, 1, None, True, 10), (1, 2, 3, 1, 1, False, 10), (None, 2, 4, 1, 1, True, 10), (1, 2, None, 1, 1, True, 10)], shape)
    d = d.withColumn("bowled_at", F.expr(f"{day}0'") + F.make_dt_interval(secs=F.coalesce("ball_number", F.lit(1))))
    put(d, tmp_path / "in")
    put(d.limit(1).withColumn("bowled_at", F.lit(None).cast("timestamp")).withColumn("ball_number", F.lit(9)), tmp_path / "in")
    put(d.limit(1).withColumn("innings_id", F.lit(-1).cast("long")).withColumn("bowled_at", F.lit(FLUSH).cast("timestamp")), tmp_path / "in")
    got = run(spark, tmp_path, late="1 second").where("innings_id = 1").orderBy("ball_number")
    assert [(r["ball_number"], r["cum_runs"], r["cum_legal"], r["ball_in_over"], r["total_runs"]) for r in got.collect()] == [(1, 4, 1, 1, 4), (2, 4, 2, 2, None), (3, 5, 2, 0, 1)]


def test_a_store_without_timers_is_refused(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        innings_stream.scores(spark.range(1), "id")


def test_a_slot_holds_the_state_of_all_its_innings(spark, timed, tmp_path, monkeypatch):
    """State has an entry for each slot, not for each innings; scores go on from the overs before, over several batches."""
    monkeypatch.setattr(innings_stream, "SLOTS", 3, raising=False)
    want = rows(balls.with_context(timed))
    second = F.col("match_id") * 60 + F.col("ball_number") * 10
    for part in range(4):
        put(timed.where(F.least(F.lit(3), F.floor(second / 650)) == part), tmp_path / "in")
        run(spark, tmp_path, late="90 seconds")
        state = innings_stream.stateful_session(spark).read.format("statestore")
        keys = {name: state.option("stateVarName", name).load(str(tmp_path / "state")).select("key").distinct().count() for name in ("waiting", "score")}
        assert 1 <= keys["waiting"] <= 3 and 1 <= keys["score"] <= 3
    assert timed.select("innings_id").distinct().count() > 50
    put(flush(timed), tmp_path / "in")
    assert rows(run(spark, tmp_path, late="90 seconds")) == want


def test_odd_ids_overs_and_times(spark, tmp_path):
    """Ids of any text, a null over, numbers beyond int, nested columns; a zoned and a plain time; a ball that comes again with another time."""
    shape = "innings_id string, innings_number int, ball_number long, over_number int, total_runs int, is_legal boolean, target int, t int, more struct<a: array<int>, b: string>"
    d = spark.createDataFrame(
        [
            ("a\t\"\n", 2, 2**40, None, 1, True, 9, 1, ([1, None], "x\n")),
            ("a\t\"\n", 2, 2**40 + 1, None, 2, True, 9, 2, None),
            ("a\t\"\n", 2, 2**40 + 1, 4, 5, True, 9, 3, None),
            ("a\t\"\n", 2, 2**40 + 2, 4, None, None, 9, 3, ([], None)),
            ("", 1, 1, -1, 6, True, None, 1, None),
            ("", 1, 2, -1, 1, True, None, 1, None),
        ],
        shape,
    ).withColumn("bowled_at", F.timestamp_micros(F.col("t") * 1_000_001)).withColumn("plain", F.col("bowled_at").cast("timestamp_ntz")).drop("t")
    put(d, tmp_path / "in")
    put(d.limit(1).withColumns({"innings_id": F.lit("end"), "bowled_at": F.lit(FLUSH).cast("timestamp")}), tmp_path / "in")
    got = run(spark, tmp_path, late="1 second").where("innings_id <> 'end'")
    first = d.dropDuplicates(["innings_id", "ball_number"])
    assert sorted((r["innings_id"], r["ball_number"] % 2**20, r["cum_runs"], r["cum_legal"], r["ball_in_over"]) for r in got.collect()) == [("", 1, 6, 1, 1), ("", 2, 7, 2, 2), ("a\t\"\n", 0, 1, 1, 1), ("a\t\"\n", 1, 3, 2, 2), ("a\t\"\n", 2, 3, 2, 0)]
    assert got.select(*first.columns).exceptAll(d).count() == 0


@pytest.mark.parametrize("late", ["1 day", "3 months"])
def test_times_that_pandas_does_not_hold(spark, tmp_path, late):
    shape = "innings_id long, innings_number int, ball_number int, over_number int, total_runs int, is_legal boolean, target int, year int"
    d = spark.createDataFrame([(1, 1, 1, 1, 4, True, None, 3000), (1, 1, 2, 1, 1, True, None, 3000), (2, 1, 1, 1, 2, True, None, 2000), (1, 1, 3, 1, 1, True, None, 3000), (3, 1, 1, 1, 1, True, None, 1500)], shape)
    d = d.withColumn("bowled_at", F.make_timestamp("year", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.col("ball_number")))
    put(d.where("ball_number < 3"), tmp_path / "in")
    run(spark, tmp_path, late=late)
    put(d.where("ball_number = 3"), tmp_path / "in")
    got = run(spark, tmp_path, late=late)
    assert sorted((r["innings_id"], r["ball_number"], r["cum_runs"], r["bowled_at"].year) for r in got.collect()) == [(1, 1, 4, 3000), (1, 2, 5, 3000), (1, 3, 6, 3000), (2, 1, 2, 2000)]
