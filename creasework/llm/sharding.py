"""Operator 9: shards of nearly equal bytes by Karmarkar-Karp differencing.

Rows of equal text are one indivisible group. Group sizes are aggregated on the executors; groups that could tip the
balance stay single, the many small ones are summed in hash cells, so the partition problem has a bounded number of
items at any scale (at most SHARDS * LARGE + CELLS). Differencing keeps each item as a partial partition of as many
sums as there are shards; it repeatedly combines the two with the largest spread, one's largest sums with the other's
smallest, until one partition is left.

A single group that is larger than a shard's fair share can't be cut: its shard takes nothing else and the others stay
level. Null texts have no bytes and group with empty ones. Repeated rows and null ids are rows like any other; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creasework.llm.common import ranked, settle, table

SHARDS = 40
#: Bytes that a row costs besides its text.
ROW_BYTES = 16
#: Groups above 1/LARGE of a fair share are items of their own; the rest is summed in CELLS cells.
LARGE, CELLS = 128, 8192


def differencing(sizes: dict, shards: int = SHARDS) -> dict:
    """The shard of each item. Ties go by the order of the items, so the result depends on nothing else."""
    heap = []
    for i, (item, size) in enumerate(sorted(sizes.items())):
        sums = [(0, ())] * (shards - 1) + [(size, (item, ()))]  # ascending; members as nested pairs
        heap.append((-size, i, sums))
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        sums = sorted(((x + y, (p, q) if p and q else p or q) for (x, p), (y, q) in zip(a, reversed(b), strict=True)), key=lambda s: s[0])
        least = sums[0][0]
        # only differences matter for what follows
        heapq.heappush(heap, (least - sums[-1][0], count, [(x - least, p) for x, p in sums]))
        count += 1
    out = {}
    for shard, (_, members) in enumerate(heap[0][2] if heap else ()):
        stack = [members]
        while stack:
            m = stack.pop()
            if not m:
                continue
            if isinstance(m[0], str):
                out[m[0]] = shard
            else:
                stack += m
    return out


def shards_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each row; slots are gapless from 0 in each shard."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("same"))
    rows = settle(rows, "sizes")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    groups = settle(rows.groupBy("same").agg(F.sum("size").alias("bytes")), "groups")
    large = F.col("bytes") * shards * LARGE > total
    cell = F.pmod("same", F.lit(CELLS)).cast("string")
    item = F.when(large, F.concat(F.lit("g"), F.col("same").cast("string"))).otherwise(F.concat(F.lit("c"), cell))
    sizes = {r["item"]: r["bytes"] for r in groups.groupBy(item.alias("item")).agg(F.sum("bytes").alias("bytes")).collect()}
    placed = differencing(sizes, shards)
    spark = docs.sparkSession
    of_group = spark.createDataFrame([(int(k[1:]), s) for k, s in placed.items() if k[0] == "g"], "same long, g int")
    of_cell = spark.createDataFrame([(int(k[1:]), s) for k, s in placed.items() if k[0] == "c"], "cell int, c int")
    out = rows.withColumn("cell", F.pmod("same", F.lit(CELLS)).cast("int")).join(F.broadcast(of_group), "same", "left").join(F.broadcast(of_cell), "cell", "left")
    out = out.select("doc_id", "size", "text_crc32", F.coalesce("g", "c").alias("shard"))
    return ranked(out, ["shard"], ["doc_id", "size", "text_crc32"], "slot", n)


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards_by_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
