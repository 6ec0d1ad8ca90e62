"""Helpers that several operators share: tables, settled intermediates, ranks, components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creasework.sources.shared import settle

#: Words of the decontamination and licence contracts: A-Z lower-cased, then runs of these characters.
#: Matched on the raw text, so that lower-casing can follow word by word.
RAW_WORD = r"[a-zA-Z0-9\x{80}-\x{10FFFF}]++"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder. Its texts are long, so Arrow batches are cut to a thousand rows where the session has no
    setting of its own: they take memory of executors and Python workers."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def extended(docs: DataFrame, keep: list[str], added: str) -> T.StructType:
    """The schema of the kept columns, whatever their names are, and of those that an operator adds."""
    return T.StructType([docs.schema[c] for c in keep] + T.StructType.fromDDL(added).fields)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that a worker holds few texts as Python objects at a time.

    At the end of a task Arrow's unused memory goes back to the system: workers live on for tasks of other stages.
    """
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)
        del b
    pa.default_memory_pool().release_unused()


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else (F.lower would also change other alphabets)."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(df: DataFrame, keys: list[str], order: list[str], out: str, rows: int, per_bucket: int = 20_000) -> DataFrame:
    """A gapless rank from 0 within keys, for groups of any size.

    A group is cut into hash buckets; each bucket is numbered by itself and starts where the counts of the buckets
    before it end, so no task sees a whole group. Rows that are equal in every order column share a bucket.
    """
    n = max(64, -(-rows // per_bucket))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n")).select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return df.withColumn("_own", F.row_number().over(own) - 1).join(starts, [*keys, "_bucket"]).withColumn(out, F.col("_start") + F.col("_own")).drop("_bucket", "_own", "_start")


#: Rows of a key that may meet in a task; keys with more are broadcast (CROWDED_KEYS of them at most).
TASK_ROWS, CROWDED_KEYS = 20_000, 50_000


def small_side(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A settled frame of a few numbers a row, broadcast if it has no more than so many rows (some 50 MB)."""
    return F.broadcast(df) if df.count() <= rows else df


def join_one(rows: DataFrame, one: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with a frame that has one row for each key, so that the rows of a crowded key never meet in a task.

    Keys with more rows than TASK_ROWS, or than a CROWDED_KEYS-th of all rows where that is more, go by a broadcast
    of their rows of one; the others by a shuffle.
    """
    crowded = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > TASK_ROWS)
    top = crowded.agg(F.count("*").alias("keys"), F.sum("_n").alias("rows")).first()
    if not top["keys"]:
        return rows.join(one, keys, how)
    crowded = settle(crowded.where(F.col("_n") > max(TASK_ROWS, top["rows"] // CROWDED_KEYS)), "crowded_keys")
    hot = F.broadcast(crowded.select(*keys))
    spread = rows.join(hot, keys, "left_semi").join(F.broadcast(one.join(hot, keys, "left_semi")), keys, how)
    return spread.unionByName(rows.join(hot, keys, "left_anti").join(one, keys, how))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in an edge (a, b): root is the smallest node that can be reached.

    Alternating large-star and small-star steps; minima are aggregated on the way to the shuffle and come back by
    ``join_one``, so a hub's neighbours never meet in one task. Ends when a step changes nothing.
    """
    at = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        seen = at.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            return at.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen
        both = at.select(F.col("a").alias("u"), F.col("b").alias("v")).union(at.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        beside = join_one if seen[0] > TASK_ROWS else DataFrame.join  # fewer can't crowd a task
        large = settle(beside(both, least, ["u"]).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "stars")
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = beside(large, lower, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(lower.select("a", F.col("m").alias("b")))
        at = settle(small.distinct(), "edges")


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; rows of remainder 1 are held out (a null id is never held out)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def bounded_sample(df: DataFrame, per_class: int, label: str, counts: dict) -> DataFrame:
    """About per_class rows of each value of label, chosen by a hash of doc_id; all of them where there are fewer."""
    share = F.coalesce(*(F.when(F.col(label) == k, F.lit(min(1.0, per_class / n))) for k, n in counts.items() if n), F.lit(0.0))
    return df.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < share * 1_000_000)
