"""Substring search over names without a scan of all: a table of each name's letter trigrams, spread by trigram.

A pattern (``%``, ``_`` and ``\\`` as in LIKE, in any case) can only match names that hold every trigram of its literal
parts. The search looks up how many names each of them has, reads the rows of the rarest one, whose folder and row groups
are found by the Parquet reader, and holds these names against the pattern itself. Nothing is shuffled but the matches.
Patterns without three literal letters in a row read the names.

The folder grows by ``add``: names that are added again are found once. A name and its key are kept with each of its
trigrams, so the index takes about as many copies of the names as they have letters. Null names are never found; names
under three letters by short patterns only, as they can't hold longer ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that trigrams are dealt over.
FOLDERS = 64


def trigrams(name: Column) -> Column:
    """The distinct trigrams of a lower-cased name."""
    size = F.char_length(name)
    return F.when(size >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), size - 2), lambda i: F.substr(name, i, F.lit(3)))))


def _folder(gram: Column) -> Column:
    return F.pmod(F.crc32(gram.cast("binary")), F.lit(FOLDERS)).cast("int")


def add(names: DataFrame, column: str, path: str) -> None:
    """Add names with their other columns (keys) to the index at path.

    Trigrams are written before the names: an addition that failed half-way is made whole by adding it again. Rows go to
    files by ranges of trigram and name, so a trigram that most names hold is shared by many tasks.
    """
    rows = names.select(F.struct(*names.columns).alias("row"), F.explode(trigrams(F.lower(column))).alias("gram")).withColumn("folder", _folder(F.col("gram")))
    spread = rows.repartitionByRange("folder", "gram", F.xxhash64("row"))
    spread.sortWithinPartitions("folder", "gram").write.mode("append").partitionBy("folder").parquet(f"{path}/grams")
    rows.groupBy("gram").agg(F.count("*").alias("names")).write.mode("append").parquet(f"{path}/counts")
    names.write.mode("append").parquet(f"{path}/names")


def literal_parts(pattern: str) -> list[str]:
    """The runs of literal letters in a LIKE pattern."""
    parts, escaped = [""], False
    for c in pattern:
        if escaped or c not in "%_\\":
            parts[-1] += c
            escaped = False
        elif c == "\\":
            escaped = True
        else:
            parts.append("")
    return [p for p in parts if p]


def literal(text: str) -> str:
    """The pattern of names that hold the text as it stands."""
    return "%" + "".join(f"\\{c}" if c in "%_\\" else c for c in text) + "%"


def rarest(spark: SparkSession, path: str, pattern: str) -> str | None:
    """The trigram of the pattern that the fewest names hold; one that no name holds, if there is any."""
    lower = spark.range(1).select(F.lower(F.lit(pattern))).first()[0]  # as the names' letters were lowered
    grams = sorted({p[i : i + 3] for p in literal_parts(lower) for i in range(len(p) - 2)})
    if not grams:
        return None
    counts = spark.read.parquet(f"{path}/counts").where(F.col("gram").isin(grams)).groupBy("gram").agg(F.sum("names"))
    known = dict.fromkeys(grams, 0) | {g: n for g, n in counts.collect()}  # as many rows as the pattern has letters
    return min(grams, key=known.__getitem__)


def find(spark: SparkSession, path: str, column: str, pattern: str) -> DataFrame:
    """The distinct rows whose name matches the pattern (``ilike``)."""
    gram = rarest(spark, path, pattern)
    if gram is None:
        rows = spark.read.parquet(f"{path}/names")
    else:
        here = _folder(F.lit(gram))
        folder = spark.range(1).select(here).first()[0]
        rows = spark.read.parquet(f"{path}/grams").where((F.col("folder") == folder) & (F.col("gram") == gram)).select("row.*")
    return rows.where(F.col(column).ilike(pattern)).distinct()
