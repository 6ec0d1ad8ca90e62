"""The driver's star schema seen as ball-by-ball data: a line is a ball, a customer a match, a nation a team.

The balls, innings and matches that many queries share are written once to the shared folder for a session and a state of
the tables, so the lines are read and joined once; they are facts, and what queries ask of them is planned anew each time.
They lie in buckets by match, more of them the larger the lines are, so that windows, groups and joins within matches move
no rows and sort what fits a task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from creasework.operators import balls, careers, ratings, venues
from creasework.sources.shared import settle_bucketed, size, stamp

#: By name and folder: the state of its tables, and the settled facts.
_SETTLED: dict[tuple[str, str], tuple[tuple, DataFrame]] = {}
#: Bytes of the lines' files for each bucket of matches: some 450000 balls.
BUCKET_BYTES = 8_000_000


def settle(facts: tuple[DataFrame, int], name: str) -> DataFrame:
    """Facts, written once in so many buckets by match."""
    return settle_bucketed(facts[0], name, "match_id", facts[1])


def forget() -> None:
    """Settle all facts anew from now on."""
    _SETTLED.clear()


@dataclass
class League:
    """The canonical frames over one data folder; each is a lazy plan that is built once."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def _stamp(self) -> tuple:
        return (self.spark.sparkContext.applicationId, id(self.spark), stamp(self.spark, [f"{self.sf_dir}/{t}.parquet" for t in ("lineitem", "orders", "customer")]))

    def _once(self, name: str, plan: Callable[[], DataFrame]) -> DataFrame:
        """The plan's rows as a settled table, made by the first query of this session that needs it while the tables stay
        as they are; of a folder whose tables have changed since, what was settled is forgotten."""
        key, made = (name, self.sf_dir), _SETTLED.get((name, self.sf_dir))
        if not made or made[0] != self._stamp:
            _SETTLED[key] = made = (self._stamp, settle((plan(), self.buckets), name))
        return made[1]

    @cached_property
    def buckets(self) -> int:
        """Buckets of matches: one a core at least."""
        return max(self.spark.sparkContext.defaultParallelism, -(-size(self.spark, f"{self.sf_dir}/lineitem.parquet") // BUCKET_BYTES))

    @cached_property
    def teams(self) -> DataFrame:
        return self.table("nation").select(F.col("n_nationkey").cast("long").alias("team_id"), F.col("n_name").alias("team"))

    @cached_property
    def venues(self) -> DataFrame:
        region = self.table("region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("country"))
        return self.table("nation").join(F.broadcast(region), "n_regionkey", "left").select(F.col("n_nationkey").cast("long").alias("venue_id"), F.col("n_name").alias("venue"), "country")

    @cached_property
    def sides(self) -> DataFrame:
        """Per match: tournament, home and away team, venue."""
        key = F.col("c_custkey")
        return self.table("customer").select(
            key.alias("match_id"),
            F.col("c_mktsegment").alias("tournament"),
            F.col("c_nationkey").cast("long").alias("team1_id"),
            ((F.col("c_nationkey") + 1 + key % 24) % 25).cast("long").alias("team2_id"),
            (key * 7 % 25).alias("venue_id"),
        )

    @cached_property
    def raw_deliveries(self) -> DataFrame:
        """Lines move twice, by order and by match, with no more than a ball needs; the second time serves the windows over
        the innings and the match, and the buckets. One order sorts both windows."""
        q, discount, tax = F.col("l_quantity").cast("int") % 9, F.round(F.col("l_discount") * 100).cast("int"), F.round(F.col("l_tax") * 100).cast("int")
        flags = F.concat("l_returnflag", "l_linestatus")
        kind = F.when(flags == "AF", "bowled").when(flags == "AO", "caught").when(flags == "NF", "lbw").when(flags == "NO", "run out").when(flags == "RF", "caught and bowled").otherwise("stumped")
        place = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
        line = self.table("lineitem").select(
            *place,
            F.when(q.isin(5, 7, 8), 0).otherwise(q).alias("runs"),
            (tax == 8).cast("int").alias("wide"),
            (tax == 7).cast("int").alias("no_ball"),
            (discount >= 9).alias("wicket"),
            F.when(discount >= 9, kind).alias("kind"),
        )
        order = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("match_id"))
        sides = self.sides.select("match_id", "team1_id", "team2_id")
        by_order = line.repartition(self.buckets, "l_orderkey").join(order.hint("shuffle_hash"), "l_orderkey")
        d = by_order.repartition(self.buckets, "match_id").join(sides.hint("shuffle_hash"), "match_id")
        first = F.col("l_orderkey") % 2 == 0
        d = d.withColumn("innings_number", F.when(first, 1).otherwise(2)).withColumn("bat_team", F.when(first, F.col("team1_id")).otherwise(F.col("team2_id"))).withColumn("bowl_team", F.when(first, F.col("team2_id")).otherwise(F.col("team1_id")))
        extras = F.col("wide") + F.col("no_ball")
        d = d.withColumn("ball_number", F.row_number().over(Window.partitionBy("match_id", "innings_number").orderBy(*place)))
        d = d.withColumn("first_total", F.sum(F.when(first, F.col("runs") + extras)).over(Window.partitionBy("match_id")))
        return d.select(
            "match_id",
            (F.col("match_id") * 10 + F.col("innings_number")).alias("innings_id"),
            "innings_number",
            "ball_number",
            (1 + (F.col("l_partkey") + F.col("l_linenumber")) % 20).cast("int").alias("over_number"),
            "bat_team",
            "bowl_team",
            (F.col("bat_team") * 11 + F.col("l_suppkey") % 11).alias("batter_id"),
            (F.col("bowl_team") * 11 + F.col("l_partkey") % 11).alias("bowler_id"),
            F.col("runs").alias("bat_runs"),
            "wide",
            "no_ball",
            F.lit(0).alias("bye"),
            F.lit(0).alias("leg_bye"),
            extras.alias("extras"),
            (F.col("runs") + extras).alias("total_runs"),
            F.col("wicket").alias("is_wicket"),
            F.col("kind").alias("wicket_kind"),
            F.when(F.col("wicket"), F.col("bat_team") * 11 + F.col("l_suppkey") % 11).alias("player_out_id"),
            F.when(~first, F.col("first_total") + 1).alias("target"),
        )

    @cached_property
    def deliveries(self) -> DataFrame:
        return self._once("deliveries", lambda: balls.with_flags(self.raw_deliveries))

    @cached_property
    def scores(self) -> DataFrame:
        """Per match: total of the first and second innings (null where there is none)."""
        total = lambda i: F.max(F.when(F.col("innings_number") == i, F.col("total_runs")))
        return self.innings.groupBy("match_id").agg(total(1).alias("first_total"), total(2).alias("second_total"))

    @cached_property
    def matches(self) -> DataFrame:
        """Winner null when tied or when an innings is missing; the toss goes to the home side of even matches."""
        return self._once("matches", self._played)

    def _played(self) -> DataFrame:
        when = self.table("orders").groupBy(F.col("o_custkey").alias("match_id")).agg(F.to_date(F.min("o_orderdate")).alias("match_date"))
        won = F.when(F.col("first_total") > F.col("second_total"), F.col("team1_id")).when(F.col("second_total") > F.col("first_total"), F.col("team2_id"))
        toss = F.when(F.col("match_id") % 2 == 0, F.col("team1_id")).otherwise(F.col("team2_id"))
        m = self.sides.join(when, "match_id").join(self.scores, "match_id").withColumn("winner_id", won).withColumn("toss_winner_id", toss)
        return m.withColumn("season", F.year("match_date").cast("string")).drop("first_total", "second_total").repartition(self.buckets, "match_id")

    @cached_property
    def innings(self) -> DataFrame:
        return self._once("innings", lambda: balls.innings_totals(self.deliveries))

    @cached_property
    def batter_innings(self) -> DataFrame:
        return balls.batter_innings(self.deliveries)

    @cached_property
    def bowler_innings(self) -> DataFrame:
        return balls.bowler_innings(self.deliveries)

    @cached_property
    def batting(self) -> DataFrame:
        return careers.batting_facts(self.batter_innings, self.matches, self.innings)

    @cached_property
    def bowling(self) -> DataFrame:
        return careers.bowling_facts(self.bowler_innings, self.matches)

    @cached_property
    def venue_factors(self) -> DataFrame:
        return venues.factors(self.innings, self.deliveries, self.matches)

    @cached_property
    def career_batting(self) -> DataFrame:
        return careers.career_batting(self.batting, self.venue_factors)

    @cached_property
    def career_bowling(self) -> DataFrame:
        return careers.career_bowling(self.bowling, self.venue_factors)

    @cached_property
    def chase_split(self) -> DataFrame:
        return careers.chase_split(self.batting)

    @cached_property
    def batting_ratings(self) -> DataFrame:
        return ratings.batting(self.career_batting, self.chase_split)

    @cached_property
    def bowling_ratings(self) -> DataFrame:
        return ratings.bowling(self.career_bowling)

    @cached_property
    def overall_ratings(self) -> DataFrame:
        return ratings.overall(self.batting_ratings, self.bowling_ratings)
