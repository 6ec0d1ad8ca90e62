"""What users call: stages of the batch pipeline over a store of Parquet tables, and lookups over its results.

    python -m creasework.plans.api all STORE DOCUMENTS TOURNAMENT
    python -m creasework.plans.api leaderboard STORE
"""

from __future__ import annotations

import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creasework.operators import balls, careers, entities, form, lookups, name_search, neighbours, ratings, similarity, venues
from creasework.sources import match_json, tables
from creasework.sources.shared import settle

#: Tables that an ingest writes before its matches.
INGESTED = ("deliveries", "people")
#: Players of a ball.
PLAYERS = ["batter_id", "non_striker_id", "bowler_id", "player_out_id"]
#: Players whose role vectors are all compared with each other; more go by hyperplanes.
ALL_PAIRS = 100_000
SCORES = ["s_opener", "s_finisher", "s_anchor", "s_pp_sr", "s_death_sr", "s_chase", "s_pp_bowl", "s_mid_bowl", "s_death_bowl"]


class Store:
    """A folder of Parquet tables; each stage reads what the ones before it wrote."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, name: str) -> DataFrame:
        d = self.spark.read.parquet(f"{self.path}/{name}")
        if name in INGESTED:  # only what an ingest that came to its end has written
            done = self.spark.read.parquet(f"{self.path}/matches").select("batch").distinct()
            d = d.join(F.broadcast(done), "batch", "left_semi").drop("batch")  # a row for each ingest
        if name == "deliveries":
            d = entities.resolve_keys(d, self.read("people"), PLAYERS)
        return d

    def has(self, name: str) -> bool:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def write(self, name: str, d: DataFrame) -> None:
        tables.overwrite(d, f"{self.path}/{name}")

    def ingest(self, documents: str, tournament: str) -> dict[str, int]:
        """Add new documents. All rows of an ingest have one batch, and its matches are written last: balls of an ingest
        that failed are never read, and its documents count as new the next time."""
        known = self.spark.read.parquet(f"{self.path}/matches").select("source_id") if self.has("matches") else None
        got = match_json.ingest(self.spark, documents, tournament, known)
        batch = F.lit(uuid.uuid4().hex)
        new = settle(got.matches, "new_matches")
        counts = {"inserted": new.count(), "skipped": got.skipped.count()}
        if counts["inserted"]:
            tables.append(got.deliveries.withColumn("batch", batch), f"{self.path}/deliveries")
            tables.append(got.people.withColumn("batch", batch), f"{self.path}/people")
            tables.append(new.withColumn("batch", batch), f"{self.path}/matches")
        return counts

    def players(self, by_name: bool = False) -> DataFrame:
        """(player_key, uuid, name): one key for each player of all ingests, by uuid, then by name."""
        return entities.resolve_players(self.read("people"), by_name)

    def _canonical(self) -> DataFrame:
        return match_json.canonical(self.read("matches"))

    def venue(self) -> None:
        d = self.read("deliveries")
        self.write("innings", balls.innings_totals(d))
        self.write("venue_difficulty", venues.factors(self.read("innings"), d, self._canonical()))

    def metrics(self) -> None:
        d, m = self.read("deliveries"), self._canonical()
        self.write("batter_innings", balls.batter_innings(d))
        self.write("bowler_innings", balls.bowler_innings(d))
        bat = careers.batting_facts(self.read("batter_innings"), m, self.read("innings"))
        bowl = careers.bowling_facts(self.read("bowler_innings"), m)
        factors = self.read("venue_difficulty")
        made = {
            "career_bat": careers.career_batting(bat, factors),
            "career_bowl": careers.career_bowling(bowl, factors),
            "chase_bat": careers.chase_split(bat),
            "position_bat": careers.position_split(bat),
            "venue_bat": careers.venue_batting(bat),
            "venue_bowl": careers.venue_bowling(bowl),
            "by_opponent": careers.by_opponent(bat, bowl),
            "by_season": careers.by_season(bat, bowl),
            "by_team": careers.by_team(bat, bowl),
            "by_result": careers.by_result(bat, bowl),
            "dismissals_bat": careers.dismissals_batting(bat),
            "dismissals_bowl": careers.dismissals_bowling(d),
            "fielding": careers.caught_and_bowled(d, m),
            "milestones": balls.milestones(self.read("batter_innings"), self.read("bowler_innings")),
            "partnerships": balls.partnerships(d),
        }
        for name, frame in made.items():
            self.write(name, frame)

    def ratings(self, tournament: str = "ALL", least: int = 10) -> None:
        bat = ratings.batting(self.read("career_bat"), self.read("chase_bat"), tournament, least)
        bowl = ratings.bowling(self.read("career_bowl"), tournament, least)
        # one partition's folder is replaced, also where nobody has enough innings
        tables.overwrite(ratings.overall(bat, bowl), f"{self.path}/ratings/tournament={tournament}")

    def enrich(self, tournament: str = "ALL") -> None:
        rated = self.read("ratings").where(F.col("tournament") == tournament)
        numbered = rated.withColumn("id", F.xxhash64("player_id"))
        vectors = similarity.role_vectors(numbered.withColumn("player_id", F.col("id")), SCORES)
        near = similarity.top_similar(vectors) if vectors.count() <= ALL_PAIRS else neighbours.top_similar(vectors)
        ids = numbered.select("id", "player_id")
        near = near.join(ids.select(F.col("id").alias("id_a"), F.col("player_id").alias("player_a")), "id_a").join(ids.select(F.col("id").alias("id_b"), F.col("player_id").alias("player_b")), "id_b")
        self.write("similarity", near.select("player_a", "player_b", "similarity", "rank"))
        played = self.read("batter_innings").join(self._canonical().select("match_id", "match_date"), "match_id").where("balls_faced > 0")
        self.write("form", form.last_n(played.select(F.col("batter_id").alias("player_id"), "match_date", "innings_id", "runs", F.col("balls_faced").alias("balls")), ["match_date", "innings_id"]))

    def all(self, documents: str, tournament: str) -> dict[str, int]:
        counts = self.ingest(documents, tournament)
        self.venue()
        self.metrics()
        self.ratings()
        self.enrich()
        return counts

    def search(self, text: str) -> DataFrame:
        return lookups.search(self.read("people"), text)

    def index_names(self) -> None:
        """Add the names that came since the last call to the search index."""
        new = self.read("people").distinct()
        if self.has("name_index/names"):
            old = self.read("name_index/names")
            new = new.join(old, new["name"].eqNullSafe(old["name"]) & new["uuid"].eqNullSafe(old["uuid"]), "left_anti")
        name_search.add(settle(new, "new_names"), "name", f"{self.path}/name_index")

    def find(self, text: str) -> DataFrame:
        """(uuid, name) of all indexed names that hold the text, in any case, by the index."""
        return name_search.find(self.spark, f"{self.path}/name_index", "name", name_search.literal(text))

    def profile(self, player: str, tournament: str = "ALL") -> DataFrame:
        """Career of a player; bowlers who never batted are found too."""
        own = lambda name: self.read(name).where((F.col("player_id") == player) & (F.col("tournament") == tournament))
        bat, bowl = own("career_bat"), own("career_bowl").drop("tournament")
        return bat.join(bowl.select("player_id", *(F.col(c).alias(f"bowl_{c}") for c in bowl.columns if c != "player_id")), "player_id", "full")

    def compare(self, a: str, b: str, tournament: str = "ALL") -> DataFrame:
        return ratings.compare(self.read("ratings").where(F.col("tournament") == tournament), a, b)

    def leaderboard(self, by: str = "overall_rating", tournament: str = "ALL", n: int = 20) -> DataFrame:
        return lookups.leaderboard(self.read("ratings").where(F.col("tournament") == tournament), by, n)

    def venue_info(self, pattern: str) -> DataFrame:
        return self.read("venue_difficulty").where(F.col("venue_id").like(pattern))


def main(args: list[str]) -> None:
    command, path, *rest = args
    store = Store(SparkSession.builder.appName("creasework").getOrCreate(), path)
    result = getattr(store, command.replace("-", "_"))(*rest)
    if isinstance(result, DataFrame):
        result.show(50, truncate=False)
    elif result is not None:
        print(result)


if __name__ == "__main__":
    main(sys.argv[1:])
