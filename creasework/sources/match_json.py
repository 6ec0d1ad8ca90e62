"""Ingest of nested match documents: one JSON object per file, flattened to ball level with declarative steps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from creasework import config as C
from creasework.operators import balls

_DELIVERY = "struct<batter:string,non_striker:string,bowler:string,runs:struct<batter:int,extras:int,total:int>,extras:struct<wides:int,noballs:int,byes:int,legbyes:int,penalty:int>,wickets:array<struct<player_out:string,kind:string>>>"
#: What is read of a document. The season may be a number or a string such as 2023/24; both arrive as text.
SCHEMA = (
    "info struct<match_type:string,dates:array<string>,registry:struct<people:map<string,string>>,venue:string,city:string,teams:array<string>,toss:struct<winner:string,decision:string>,"
    "outcome:struct<winner:string,by:struct<runs:int,wickets:int>,result:string,method:string,eliminator:string>,gender:string,season:string,player_of_match:array<string>>,"
    f"innings array<struct<team:string,target:struct<runs:int>,overs:array<struct<`over`:int,deliveries:array<{_DELIVERY}>>>>>,_corrupt string"
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """All documents below path; source_id is the file's stem. Files that are not JSON have _corrupt set."""
    raw = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return raw.withColumn("source_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1))


def accepted(documents: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """T20 documents with a date of the covered years, once each, that are not known yet (source_id)."""
    date = F.get("info.dates", F.lit(0)).try_cast("date")
    d = documents.withColumn("match_date", date)
    d = d.where((F.col("info.match_type") == C.MATCH_TYPE) & F.year("match_date").between(C.YEAR_FROM, C.YEAR_TO)).dropDuplicates(["source_id"])
    return d.join(known.select("source_id"), "source_id", "left_anti") if known is not None else d


def matches(documents: DataFrame, tournament: str) -> DataFrame:
    """A row per match. Who bats first follows from the toss; without a winner it's open whether the chase was won."""
    info = F.col("info")
    teams = info["teams"]
    other = F.get(F.filter(teams, lambda t: t != info["toss"]["winner"]), F.lit(0))
    first = F.when(info["toss"]["decision"] == "bat", info["toss"]["winner"]).otherwise(other)
    winner = info["outcome"]["winner"]
    return documents.select(
        "source_id",
        "match_date",
        F.lit(tournament).alias("tournament"),
        F.coalesce(info["season"], F.year("match_date").cast("string")).alias("season"),
        F.coalesce(info["venue"], F.lit("Unknown")).alias("venue"),
        info["city"].alias("city"),
        F.get(teams, F.lit(0)).alias("team1"),
        F.get(teams, F.lit(1)).alias("team2"),
        info["toss"]["winner"].alias("toss_winner"),
        F.coalesce(info["toss"]["decision"], F.lit("")).alias("toss_decision"),
        winner.alias("winner"),
        info["outcome"]["by"]["runs"].alias("win_by_runs"),
        info["outcome"]["by"]["wickets"].alias("win_by_wickets"),
        F.coalesce(F.contains(F.lower(F.to_json(info["outcome"])), F.lit("no result")), F.lit(False)).alias("no_result"),
        F.coalesce(info["gender"], F.lit("male")).alias("gender"),
        first.alias("batting_first"),
        F.when(winner.isNotNull() & first.isNotNull(), winner != first).alias("chasing_team_won"),
        F.coalesce(info["player_of_match"], F.array().cast("array<string>")).alias("player_of_match"),
        F.to_json("info").alias("raw_meta"),
    )


def canonical(found: DataFrame) -> DataFrame:
    """Matches as operators take them: one row each, with the side that batted first as the first team."""
    m = found.dropDuplicates(["source_id"])
    second = F.when(F.col("batting_first") == F.col("team1"), F.col("team2")).otherwise(F.col("team1"))
    return m.select(F.col("source_id").alias("match_id"), "tournament", "season", F.col("venue").alias("venue_id"), "match_date", F.col("batting_first").alias("team1_id"), second.alias("team2_id"), F.col("winner").alias("winner_id"))


def people(documents: DataFrame) -> DataFrame:
    """(uuid, name) as the documents' registries have them."""
    return documents.select(F.explode("info.registry.people").alias("name", "uuid")).select("uuid", "name").distinct()


def deliveries(documents: DataFrame) -> DataFrame:
    """A row per ball: ordinals, extras by kind with zeros, the first wicket only, and the flags of the ball."""
    inn = documents.select("source_id", F.col("info.teams").alias("teams"), F.col("info.registry.people").alias("people"), F.posexplode("innings").alias("i", "inn"))
    over = inn.select("source_id", "teams", "people", "i", F.col("inn.team").alias("batting_team"), F.col("inn.target.runs").alias("target"), F.posexplode("inn.overs").alias("o", "over"))
    ball = over.select("source_id", "teams", "people", "i", "batting_team", "target", "o", F.col("over.over").alias("over0"), F.posexplode("over.deliveries").alias("b", "d"))
    key = lambda name: F.coalesce(F.try_element_at(F.col("people"), name), name)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    wicket = F.get("d.wickets", F.lit(0))
    order = Window.partitionBy("source_id", "i").orderBy("o", "b")
    extras = zero("d.runs.extras")
    d = ball.select(
        F.col("source_id").alias("match_id"),
        F.concat_ws(":", "source_id", (F.col("i") + 1).cast("string")).alias("innings_id"),
        (F.col("i") + 1).alias("innings_number"),
        F.row_number().over(order).alias("ball_number"),
        (F.col("over0") + 1).alias("over_number"),
        F.col("batting_team").alias("bat_team"),
        F.get(F.filter("teams", lambda t: t != F.col("batting_team")), F.lit(0)).alias("bowl_team"),
        key(F.coalesce("d.batter", F.lit(""))).alias("batter_id"),
        key(F.coalesce("d.non_striker", F.lit(""))).alias("non_striker_id"),
        key(F.coalesce("d.bowler", F.lit(""))).alias("bowler_id"),
        zero("d.runs.batter").alias("bat_runs"),
        extras.alias("extras"),
        F.coalesce("d.runs.total", zero("d.runs.batter") + extras).alias("total_runs"),
        zero("d.extras.wides").alias("wide_runs"),
        zero("d.extras.noballs").alias("no_ball_runs"),
        (zero("d.extras.wides") > 0).cast("int").alias("wide"),
        (zero("d.extras.noballs") > 0).cast("int").alias("no_ball"),
        zero("d.extras.byes").alias("bye"),
        zero("d.extras.legbyes").alias("leg_bye"),
        zero("d.extras.penalty").alias("penalty"),
        wicket.isNotNull().alias("is_wicket"),
        wicket["kind"].alias("wicket_kind"),
        key(wicket["player_out"]).alias("player_out_id"),
        "target",
    )
    return balls.with_flags(d)


@dataclass
class Ingested:
    matches: DataFrame
    people: DataFrame
    deliveries: DataFrame
    skipped: DataFrame


def ingest(spark: SparkSession, path: str, tournament: str, known: DataFrame | None = None) -> Ingested:
    """Frames of all new documents below path, and the ids that were skipped with the reason."""
    documents = read_documents(spark, path)
    new = accepted(documents, known)
    reason = F.when(F.col("_corrupt").isNotNull(), "malformed").when(F.coalesce(F.col("info.match_type") != C.MATCH_TYPE, F.lit(True)), "not a T20").otherwise("no date of the covered years, or known")
    skipped = documents.join(new.select("source_id"), "source_id", "left_anti").select("source_id", reason.alias("reason"))
    return Ingested(matches(new, tournament), people(new), deliveries(new), skipped)
