"""Performance models: feature frames, gradient-boosted trees by position group, holdout evaluation, intervals."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creasework import config as C
from creasework.functions import exprs as X
from creasework.operators import search
from creasework.sources.shared import settle

BAT_FEATURES = ["venue_bat_factor", "boundary_rate", "pace_index", "batting_position", "is_chase", "req_rr", "career_adj_avg", "career_adj_sr", "career_innings", "chase_avg", "first_avg", "chase_sr", "pp_sr", "mid_sr", "death_sr", "tournament_enc"]
BOWL_FEATURES = ["venue_bat_factor", "boundary_rate", "pace_index", "career_adj_econ", "career_dot_pct", "career_bowl_inn", "pp_economy", "mid_economy", "death_economy", "tournament_enc"]


def _clipped(c: str | Column, fill: float, low: float, high: float) -> Column:
    return X.clamp(F.coalesce(X.col(c).cast("double"), F.lit(float(fill))), low, high)


def _tournament() -> Column:
    codes = F.create_map(*(F.lit(x) for kv in C.TOURNAMENT_CODES.items() for x in kv))
    return F.coalesce(F.try_element_at(codes, F.col("tournament")), F.lit(5)).cast("double")


def _venue(facts: DataFrame, factors: DataFrame) -> DataFrame:
    v = factors.select("venue_id", "bat_factor", F.col("boundary_rate").alias("_boundary"), F.col("pace_index").alias("_pace"))
    return facts.join(F.broadcast(v), "venue_id", "left")


_VENUE = {"venue_bat_factor": lambda: _clipped("bat_factor", 1.0, 0.5, 2.0), "boundary_rate": lambda: _clipped("_boundary", 0.12, 0.05, 0.25), "pace_index": lambda: _clipped("_pace", 0.5, 0, 1)}


def batting_features(batting: DataFrame, factors: DataFrame, career: DataFrame, chase: DataFrame, least_balls: int = 4, on: tuple[str, ...] = ("player_id",)) -> DataFrame:
    """16 features per batter innings. Phase strike rates are those of the innings itself, as the models expect; without
    that leak, and with careers of earlier days only (on: player and day), see ``point_in_time``."""
    on = list(on)
    c = career.where("tournament = 'ALL'").select(*on, F.col("adj_average").alias("_avg"), F.col("adj_strike_rate").alias("_sr"), F.col("innings").alias("_n"))
    s = chase.groupBy(*on).agg(*(F.max(F.when(F.col("innings_type") == t, F.col(a))).alias(b) for t, a, b in (("chase", "average", "_ca"), ("first", "average", "_fa"), ("chase", "strike_rate", "_cs"))))
    d = _venue(batting.where(F.col("balls_faced") >= least_balls), factors).join(c, on, "left").join(s, on, "left")
    own = {f"{p}_sr": F.least(F.col(f"{p}_runs") * 100.0 / F.greatest(F.col(f"{p}_balls"), F.lit(1)), F.lit(300.0)) for p in ("pp", "mid", "death")}
    out = {n: f() for n, f in _VENUE.items()} | {
        "batting_position": _clipped("batting_position", 5, 1, 11),
        "is_chase": F.col("is_chase").cast("double"),
        "req_rr": _clipped("required_rr_start", 0, 0, 20),
        "career_adj_avg": _clipped("_avg", 20, 0, 80),
        "career_adj_sr": _clipped("_sr", 120, 50, 250),
        "career_innings": _clipped("_n", 1, 1, 300),
        "chase_avg": _clipped("_ca", 20, 0, 80),
        "first_avg": _clipped("_fa", 20, 0, 80),
        "chase_sr": _clipped("_cs", 120, 50, 250),
        "tournament_enc": _tournament(),
    }
    return d.select("innings_id", "player_id", "runs", "season", "tournament", *((out | own)[n].alias(n) for n in BAT_FEATURES))


def bowling_features(bowling: DataFrame, factors: DataFrame, career: DataFrame, least_balls: int = 6, on: tuple[str, ...] = ("player_id",)) -> DataFrame:
    """10 features per bowler innings and its economy, the target."""
    on = list(on)
    names = ("adj_economy", "dot_pct", "innings", "pp_economy", "mid_economy", "death_economy")
    c = career.where("tournament = 'ALL'").select(*on, *(F.col(n).alias(f"_{n}") for n in names))
    d = _venue(bowling.where(F.col("balls_bowled") >= least_balls), factors).join(c, on, "left").withColumn("economy_target", F.col("runs_conceded") * 6.0 / F.col("balls_bowled"))
    out = {n: f() for n, f in _VENUE.items()} | {
        "career_adj_econ": _clipped("_adj_economy", 8.5, 4, 18),
        "career_dot_pct": _clipped("_dot_pct", 33, 10, 70),
        "career_bowl_inn": _clipped("_innings", 1, 1, 300),
        "pp_economy": _clipped("_pp_economy", 8.0, 4, 18),
        "mid_economy": _clipped("_mid_economy", 8.0, 4, 18),
        "death_economy": _clipped("_death_economy", 9.5, 4, 20),
        "tournament_enc": _tournament(),
    }
    return d.where((F.col("economy_target") > 2) & (F.col("economy_target") < 24)).select("innings_id", "player_id", "economy_target", "season", *(out[n].alias(n) for n in BOWL_FEATURES))


#: Settings of the boosted trees: batters (openers and top order, and all), lower order and tail, bowlers.
BAT_TREES = {"trees": 196, "rate": 0.1357, "depth": 6, "share": 0.7745, "least": 41}
LOW_TREES = {"trees": 150, "rate": 0.1, "depth": 4, "share": 0.7745, "least": 20}
BOWL_TREES = {"trees": 400, "rate": 0.05, "depth": 4, "share": 0.8, "least": 20, "subset": "all"}
#: Rows that a partition should have before there is one for each core, and rows beyond which there are more than cores.
TRAIN_ROWS, PART_ROWS = 50_000, 4_000_000


def training_parts(rows: int, cores: int) -> int:
    """Partitions that trees are trained on. Each level of each tree is a job over all of them, so that tasks in plenty
    cost more than their work: one a core, fewer where rows are few, more only where they wouldn't fit a task."""
    return max(1, min(cores, -(-rows // TRAIN_ROWS)), -(-rows // PART_ROWS))


def train(d: DataFrame, features: list[str], label: str, trees: int = 196, rate: float = 0.1357, depth: int = 6, share: float = 0.7745, least: int = 41, subset: str = "0.7645") -> PipelineModel:
    """Scaler and boosted trees, fitted by Spark over all rows, which lie in even parts."""
    trees_ = GBTRegressor(featuresCol="scaled", labelCol=label, predictionCol="prediction", maxIter=trees, stepSize=rate, maxDepth=depth, subsamplingRate=share, minInstancesPerNode=least, featureSubsetStrategy=subset, seed=42)
    stages = [VectorAssembler(inputCols=features, outputCol="features"), StandardScaler(inputCol="features", outputCol="scaled", withMean=True), trees_]
    d = d.select(*features, F.col(label).cast("double").alias(label))
    cores = d.sparkSession.sparkContext.defaultParallelism
    d = settle(d.repartition(cores), "training")
    parts = training_parts(d.count(), cores)
    return Pipeline(stages=stages).fit(d.coalesce(parts) if parts <= cores else d.repartition(parts))


def train_by_position(d: DataFrame, trees: int | None = None, least_rows: int = 100) -> dict[str, PipelineModel]:
    """A model for each position group with enough rows, and one over all as fallback; trees: fewer than the settings'."""
    d = settle(d.withColumn("_g", position_group()), "positions")
    counts = {r["_g"]: r["n"] for r in d.groupBy("_g").agg(F.count("*").alias("n")).collect()}
    own = lambda kind: kind | {"trees": trees or kind["trees"]}
    models = {"all": train(d, BAT_FEATURES, "runs", **own(BAT_TREES))}
    for group in C.POSITION_GROUPS:
        if counts.get(group, 0) >= least_rows:
            models[group] = train(d.where(F.col("_g") == group), BAT_FEATURES, "runs", **own(BAT_TREES if group in ("openers", "top_order") else LOW_TREES))
    return models


def train_bowling(d: DataFrame, **settings) -> PipelineModel:
    """The model of economy."""
    return train(d, BOWL_FEATURES, "economy_target", **(BOWL_TREES | settings))


def fold_errors(d: DataFrame, features: list[str], label: str, folds: int = 3, **settings) -> DataFrame:
    """(fold, n, mae): errors on each fold, by hash of the innings, of a model of the others."""
    d = settle(d.withColumn("fold", F.pmod(F.xxhash64("innings_id", "player_id"), F.lit(folds)).cast("int")), "folds")
    rows = [train(d.where(F.col("fold") != k), features, label, **settings).transform(d.where(F.col("fold") == k)).select("fold", F.abs(F.col("prediction") - F.col(label)).alias("e")) for k in range(folds)]
    return reduce(DataFrame.union, rows).groupBy("fold").agg(F.count("*").alias("n"), F.avg("e").alias("mae"))


def save_model(model: PipelineModel, path: str, meta: dict) -> None:
    """The model and what is known of it (features, sizes, errors, importances) as JSON beside it."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/meta").first()["value"])


def metrics_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(model, metric, value): the numbers in the meta of saved models."""
    rows = [(p.rstrip("/").rsplit("/", 1)[-1], k, float(v)) for p in paths for k, v in load_model(spark, p)[1].items() if isinstance(v, (int, float))]
    return spark.createDataFrame(rows, "model string, metric string, value double")


def position_group() -> Column:
    p = F.col("batting_position")
    return F.coalesce(*(F.when(p.between(lo, hi), name) for name, (lo, hi) in C.POSITION_GROUPS.items()), F.lit("top_order"))


def predict_by_position(models: dict[str, PipelineModel], d: DataFrame) -> DataFrame:
    """Each row by its group's model, or by the one over all."""
    d = d.withColumn("_g", position_group())
    own = [models[g].transform(d.where(F.col("_g") == g)) for g in C.POSITION_GROUPS if g in models]
    rest = [g for g in C.POSITION_GROUPS if g not in models]
    if rest:
        own.append(models["all"].transform(d.where(F.col("_g").isin(rest))))
    return reduce(DataFrame.union, own).drop("_g", "features", "scaled").withColumn("prediction", F.greatest(F.round("prediction", 1), F.lit(0.0)))


def evaluate(d: DataFrame, label: str) -> DataFrame:
    """One row: R2, mean absolute error, bias, and the shares within 10 and 20."""
    e = F.col("prediction") - F.col(label)
    return d.agg(
        F.count("*").alias("n"),
        (1 - F.sum(e * e) / F.nullif(F.var_pop(label) * F.count("*"), F.lit(0.0))).alias("r2"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e).alias("bias"),
        (F.avg((F.abs(e) <= 10).cast("double")) * 100).alias("within_10_pct"),
        (F.avg((F.abs(e) <= 20).cast("double")) * 100).alias("within_20_pct"),
    )


def errors_by(d: DataFrame, label: str, key: str = "tournament") -> DataFrame:
    """Innings, mean absolute error and bias of each tournament, the least error first."""
    e = F.col("prediction") - F.col(label)
    return d.groupBy(key).agg(F.count("*").alias("innings"), X.round_even(F.avg(F.abs(e)), 2).alias("mae"), X.round_even(F.avg(e), 2).alias("bias")).orderBy("mae", key)


def holdout(d: DataFrame, features: list[str], label: str, season: str, strict: bool = False, **params) -> DataFrame:
    """Fit on the other seasons (only those before, if strict), evaluate on the one held out.

    The features must not come from the held-out season either: see ``split_by_season``.
    """
    rest = d.where(F.col("season") < season) if strict else d.where(F.col("season") != season)
    return evaluate(train(rest, features, label, **params).transform(d.where(F.col("season") == season)), label)


def split_by_season(facts: DataFrame, season: str, strict: bool = True) -> DataFrame:
    """The facts that features may be made from: seasons before the held-out one, or all others."""
    return facts.where(F.col("season") < season) if strict else facts.where(F.col("season") != season)


def tune(d: DataFrame, features: list[str], label: str, grid: list[dict], season: str | None = None, folds: int = 3) -> DataFrame:
    """(setting, mae) of each setting over folds, best first; a held-out season is left out of the search."""
    rest = d.where(F.col("season") != season) if season else d
    rows = [fold_errors(rest, features, label, folds, **g).agg((F.sum(F.col("mae") * F.col("n")) / F.sum("n")).alias("mae")).withColumn("setting", F.lit(str(sorted(g.items())))) for g in grid]
    return reduce(DataFrame.union, rows).orderBy("mae")


#: Where boosted trees are searched: the bounds of the settings.
TREE_SPACE = {"trees": search.Number(100, 500, whole=True), "rate": search.Number(0.01, 0.2, log=True), "depth": search.Number(3, 6, whole=True), "share": search.Number(0.5, 1.0), "least": search.Number(10, 60, whole=True)}


def find_settings(d: DataFrame, features: list[str], label: str, space: search.Space = TREE_SPACE, season: str | None = None, folds: int = 3, **how) -> list[search.Trial]:
    """Settings by their mean absolute error over folds, best first. A held-out season is left out of the search; folds
    are the steps of a trial, so a poor setting sees one fold only. how: trials, side_by_side, seed .. of ``search.minimise``."""
    rest = d.where(F.col("season") != season) if season else d
    rest = settle(rest.withColumn("fold", F.pmod(F.xxhash64("innings_id", "player_id"), F.lit(folds)).cast("int")), "search")

    def judge(setting: dict, k: int) -> float:
        model = train(rest.where(F.col("fold") != k), features, label, **setting)
        return model.transform(rest.where(F.col("fold") == k)).agg(F.avg(F.abs(F.col("prediction") - F.col(label)))).first()[0]

    return search.minimise(judge, space, steps=folds, **how)


def settings_report(d: DataFrame, features: list[str], label: str, season: str, settings: dict[str, dict]) -> DataFrame:
    """(model, n, r2, mae, ..) on the held-out season of each named setting, trained on the others."""
    rows = [holdout(d, features, label, season, **s).withColumn("model", F.lit(name)) for name, s in settings.items()]
    return reduce(DataFrame.union, rows).orderBy("mae")


def players_at_venue(bat_model: PipelineModel, bowl_model: PipelineModel, players: DataFrame, venue: DataFrame) -> DataFrame:
    """Each player at one venue: predicted runs batting first and chasing, and predicted economy, best first.

    players: player_id and the features of batting and bowling but for those of the venue (null where unknown); venue:
    one row of bat_factor, boundary_rate, pace_index.
    """
    v = venue.limit(1).select(F.col("bat_factor"), F.col("boundary_rate").alias("_boundary"), F.col("pace_index").alias("_pace"))
    d = players.crossJoin(F.broadcast(v)).withColumns({n: f() for n, f in _VENUE.items()}).drop("bat_factor", "_boundary", "_pace")
    usual = {"career_adj_avg": 20.0, "career_adj_sr": 120.0, "career_innings": 20.0, "chase_avg": 20.0, "first_avg": 20.0, "chase_sr": 120.0, "batting_position": 4.0, "pp_sr": 130.0, "mid_sr": 125.0, "death_sr": 135.0, "career_adj_econ": 8.5, "career_dot_pct": 33.0, "career_bowl_inn": 20.0, "pp_economy": 8.0, "mid_economy": 8.0, "death_economy": 9.5, "tournament_enc": 5.0}
    d = d.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(x)) if c in d.columns else F.lit(x) for c, x in usual.items()})
    runs = bat_model.transform(two_situations(d)).groupBy("player_id").agg(*(F.greatest(X.round_even(F.max(F.when(F.col("situation") == k, F.col("prediction"))), 1), F.lit(0.0)).alias(n) for k, n in (("first", "runs_first"), ("chase", "runs_chase"))))
    economy = bowl_model.transform(d).select("player_id", X.round_even(F.col("prediction"), 2).alias("economy"))
    return runs.join(economy, "player_id").orderBy(F.desc("runs_first"), "player_id")


def intervals(model: PipelineModel, d: DataFrame, features: list[str], key: str, draws: int = 300, noise: float = 0.07, seed: int = 0) -> DataFrame:
    """10 % and 90 % points of predictions under multiplicative noise on every feature: all draws of all rows are one
    transformed frame."""
    many = d.select(key, *features).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    shaken = many.withColumns({f: F.col(f) * (1 + noise * F.randn(seed + i)) for i, f in enumerate(features)})
    p = model.transform(shaken)
    return p.groupBy(key).agg(F.greatest(F.percentile("prediction", F.lit(0.1)), F.lit(0.0)).alias("lo"), F.greatest(F.percentile("prediction", F.lit(0.9)), F.lit(0.0)).alias("hi"))


def two_situations(players: DataFrame) -> DataFrame:
    """Feature rows for batting first (no required rate) and for chasing at nine an over."""
    first = players.withColumn("is_chase", F.lit(0.0)).withColumn("req_rr", F.lit(0.0)).withColumn("situation", F.lit("first"))
    return first.unionByName(players.withColumn("is_chase", F.lit(1.0)).withColumn("req_rr", F.lit(9.0)).withColumn("situation", F.lit("chase")))


def importances(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    return sorted(zip(features, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1])


def lagged_phase_rates(batting: DataFrame) -> DataFrame:
    """Phase strike rates of the player's earlier innings only, which do not leak the target."""
    from pyspark.sql import Window

    before = Window.partitionBy("player_id").orderBy("match_date", "innings_id").rowsBetween(Window.unboundedPreceding, -1)
    return batting.withColumns({f"{p}_sr_before": X.ratio(F.sum(f"{p}_runs").over(before), F.sum(f"{p}_balls").over(before), 100) for p in ("pp", "mid", "death")})


def scaled_features(model: PipelineModel, d: DataFrame) -> DataFrame:
    """The standardised features as an array, for inspection."""
    return model.transform(d).withColumn("scaled_features", vector_to_array("scaled")).drop("features", "scaled")
