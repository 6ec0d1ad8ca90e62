"""Role similarity: the most alike vectors by cosine.

Every vector is compared with every other; that is what the operator means, so the work is cut in blocks: vectors are
dealt to blocks by hash, a block and a strip of blocks are one task's matrix products, and only the best k of a strip
leave it. Beyond some 100 000 vectors, an approximate index should choose candidates first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Blocks that a task compares a block with at most, and tasks that there are before it is more than one.
STRIP, STRIP_TASKS = 8, 64


def role_vectors(ratings: DataFrame, scores: list[str]) -> DataFrame:
    """(id, vector) of the sub-scores, null as 0."""
    return ratings.select(F.col("player_id").alias("id"), F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in scores)).alias("vector"))


def nearest_columns(s: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k greatest values of each row, the greatest first, equal ones in order: what a stable sort of the
    whole rows gives, of which only the values from the k-th on are sorted."""
    if s.shape[1] <= 4 * k:
        return np.argsort(-s, axis=1, kind="stable")[:, :k]
    edge = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
    rows, columns = np.nonzero(s >= edge)
    order = np.lexsort((columns, -s[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    starts = np.searchsorted(rows, np.arange(len(s)))
    return columns[starts[:, None] + np.arange(k)]


def top_similar(vectors: DataFrame, k: int = 20, block_rows: int = 2000) -> DataFrame:
    """(id_a, id_b, similarity) of the k nearest others of each id; similarity to 4 digits, ties by id.

    A task compares a block with a strip of up to STRIP blocks, one after another, and sends the best k of the strip."""
    n = vectors.count()
    blocks = max(1, -(-n // block_rows))
    strip = min(STRIP, max(1, blocks * blocks // STRIP_TASKS))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = dealt.select("id", "vector", F.lit(0).alias("side"), F.col("block").alias("a"), every(-(-blocks // strip)).alias("b"))
    right = dealt.select("id", "vector", F.lit(1).alias("side"), every(blocks).alias("a"), F.floor(F.col("block") / strip).cast("int").alias("b"))
    unit = lambda q: (m := np.array(q["vector"].tolist(), float)) / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)

    def nearest(p: pd.DataFrame) -> pd.DataFrame:
        x, y = p[p.side == 0].sort_values("id"), p[p.side == 1].sort_values("id")
        if x.empty or y.empty:
            return pd.DataFrame({"id_a": [], "id_b": [], "similarity": []})
        own, ux = x["id"].to_numpy(), unit(x)
        best, ids = np.empty((len(x), 0)), np.empty((len(x), 0), np.int64)
        for at in range(0, len(y), block_rows):  # ids ascend, so of equal ones those that were found before come first
            part = y.iloc[at : at + block_rows]
            other = part["id"].to_numpy()
            s = np.round(ux @ unit(part).T, 4)
            s[own[:, None] == other[None, :]] = -np.inf
            here = nearest_columns(s, k)
            best, ids = np.hstack([best, np.take_along_axis(s, here, 1)]), np.hstack([ids, other[here]])
            keep = nearest_columns(best, k)
            best, ids = np.take_along_axis(best, keep, 1), np.take_along_axis(ids, keep, 1)
        out = pd.DataFrame({"id_a": np.repeat(own, best.shape[1]), "id_b": ids.ravel(), "similarity": best.ravel()})
        return out[np.isfinite(out.similarity)]

    found = left.union(right).groupBy("a", "b").applyInPandas(nearest, "id_a long, id_b long, similarity double")
    rank = F.row_number().over(Window.partitionBy("id_a").orderBy(F.desc("similarity"), "id_b"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
