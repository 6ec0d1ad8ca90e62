"""Reading and writing of tables: append, overwrite, by partition, by key, as documents, as copies."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creasework.operators.profiles import without_nulls
from creasework.operators.venues import upsert


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """A table with the columns and rows that are needed; both reach the Parquet reader."""
    d = spark.read.parquet(path)
    d = d.where(where) if where else d
    return d.select(*columns) if columns else d


def append(d: DataFrame, path: str) -> None:
    d.write.mode("append").parquet(path)


def overwrite(d: DataFrame, path: str) -> None:
    d.write.mode("overwrite").parquet(path)


def overwrite_partitions(d: DataFrame, path: str, by: list[str]) -> None:
    """Replace only the partitions (such as tournaments) that d has rows of."""
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def upsert_table(spark: SparkSession, new: DataFrame, path: str, key: list[str], to: str) -> None:
    """Write the table at path with new's rows in place of those of equal key to another path (readers of the old one
    are not disturbed, and a failed write leaves it whole)."""
    upsert(spark.read.parquet(path), new, key).write.mode("overwrite").parquet(to)


def write_documents(d: DataFrame, path: str, compression: str = "gzip") -> None:
    """One JSON document per row, without null fields."""
    without_nulls(d).write.mode("overwrite").option("compression", compression).text(path)


def copy_tables(spark: SparkSession, source: str, target: str, names: list[str], fmt: str = "json") -> dict[str, int]:
    """Copy tables to another format; dates become timestamps. Gives the row counts."""
    counts = {}
    for name in names:
        d = spark.read.parquet(f"{source}/{name}.parquet")
        d = d.withColumns({c: F.col(c).cast("timestamp") for c, t in d.dtypes if t == "date"}) if any(t == "date" for _, t in d.dtypes) else d
        d.write.mode("overwrite").format(fmt).save(f"{target}/{name}")
        counts[name] = spark.read.format(fmt).schema(d.schema).load(f"{target}/{name}").count()
    return counts


def snapshot(d: DataFrame, path: str, compression: str = "gzip") -> None:
    """A compressed copy that restore() reads."""
    d.write.mode("overwrite").option("compression", compression).parquet(path)


def restore(spark: SparkSession, snapshot_path: str, path: str) -> bool:
    """Write a snapshot to path if no table is there yet; whether it was written."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return False
    spark.read.parquet(snapshot_path).write.parquet(path)
    return True


def read_presets(spark: SparkSession, path: str) -> DataFrame:
    """(team, playing_xi, bench, substitutes) from JSON lines {"team": ..., "squad": ...}; a squad that is a plain list
    of names is one of the old form, with the eleven only."""
    raw = spark.read.text(path)
    new = "playing_xi array<string>, bench array<string>, substitutes array<string>"
    squad = F.get_json_object("value", "$.squad")
    d = raw.select(F.get_json_object("value", "$.team").alias("team"), F.when(F.ltrim(squad).startswith("["), F.from_json(squad, "array<string>")).alias("old"), F.when(~F.ltrim(squad).startswith("["), F.from_json(squad, new)).alias("new"))
    empty = F.array().cast("array<string>")
    return d.select("team", F.coalesce("new.playing_xi", "old", empty).alias("playing_xi"), F.coalesce("new.bench", empty).alias("bench"), F.coalesce("new.substitutes", empty).alias("substitutes"))


def write_presets(d: DataFrame, path: str) -> None:
    squad = F.struct("playing_xi", "bench", "substitutes")
    d.select(F.to_json(F.struct("team", squad.alias("squad"))).alias("value")).write.mode("overwrite").text(path)


def write_bucketed(d: DataFrame, path: str, name: str, by: str, buckets: int, order: list[str], look_up: list[str] | None = None, row_group_bytes: int | None = None) -> DataFrame:
    """Write d to path in buckets by a key, sorted within each, and name it in the session's catalog.

    Tables with the same number of buckets join on the key without a shuffle. look_up: columns with a Bloom filter in each
    row group, so that a lookup of one value skips the groups without it. How the table lies is noted beside it.
    """
    spark, sorted_by = d.sparkSession, [by, *(c for c in order if c != by)]
    w = d.repartition(buckets, by).write.mode("overwrite").option("path", path).bucketBy(buckets, by).sortBy(*sorted_by)
    for c in look_up or []:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    if row_group_bytes:
        w = w.option("parquet.block.size", row_group_bytes)
    spark.sql(f"drop table if exists {name}")
    w.saveAsTable(name)
    layout = {"by": by, "buckets": buckets, "order": sorted_by, "schema": d.schema.json()}
    spark.createDataFrame([(json.dumps(layout),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_layout")
    return spark.table(name)


def open_bucketed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A bucketed table that another session has written, named in this one's catalog."""
    from pyspark.sql.types import StructType

    layout = json.loads(spark.read.text(f"{path}/_layout").first()["value"])
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(layout["schema"])).fields)
    spark.sql(f"drop table if exists {name}")
    spark.sql(f"create table {name} ({columns}) using parquet clustered by (`{layout['by']}`) sorted by ({', '.join(f'`{c}`' for c in layout['order'])}) into {layout['buckets']} buckets location '{path}'")
    return spark.table(name)
