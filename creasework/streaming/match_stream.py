"""Incremental ingest: a file stream of match documents, each taken once, balls appended to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from creasework.operators import balls, careers, incremental
from creasework.sources import match_json


def document_stream(spark: SparkSession, path: str, files_per_trigger: int = 500) -> DataFrame:
    raw = spark.readStream.schema(match_json.SCHEMA).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.json").json(path)
    return raw.withColumn("source_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)).withColumn("modified", F.col("_metadata.file_modification_time"))


def ingest_stream(spark: SparkSession, path: str, target: str, checkpoint: str, tournament: str, repeats: str = "30 days") -> StreamingQuery:
    """Append deliveries, people and matches of new documents to tables below target, and what they add to the careers
    (``incremental``). The file source takes each file once; state keeps ids for as long as the same document may come
    again under another path (by time of modification).

    A batch that is run again after a failure overwrites its own partition, so every document lands exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        new = match_json.accepted(batch).persist()
        found, d = match_json.matches(new, tournament), match_json.deliveries(new).persist()
        played = match_json.canonical(found)
        bat = careers.batting_facts(balls.batter_innings(d), played, balls.innings_totals(d))
        bowl = careers.bowling_facts(balls.bowler_innings(d), played)
        for name, rows in (("deliveries", d), ("people", match_json.people(new)), ("batting_states", incremental.batting_state(bat)), ("bowling_states", incremental.bowling_state(bowl)), ("matches", found)):
            incremental.add_batch(rows, f"{target}/{name}", number)
        d.unpersist()
        new.unpersist()

    once = document_stream(spark, path).withWatermark("modified", repeats).dropDuplicatesWithinWatermark(["source_id"]).drop("modified")
    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed_careers(spark: SparkSession, target: str, factors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(batting, bowling) careers of all that a stream has written so far, from its states; no ball is read."""
    bat, bowl = (incremental.states(spark, f"{target}/{n}_states") for n in ("batting", "bowling"))
    return incremental.career_batting(bat, factors), incremental.career_bowling(bowl, factors)


def event_rates(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of an event stream (ts, event_type, value) in tumbling windows with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
