"""Nearest vectors by cosine through random hyperplanes, for more vectors than all pairs can serve.

The signs of a vector's products with random hyperplanes are its code. Several tables of codes are drawn. In a table, a
vector's bucket is the shortest beginning of its code that fewer than ``crowd`` vectors share, so buckets follow the data:
long codes where many vectors lie close together, short ones elsewhere. Each vector also asks the buckets whose codes
differ where its products are nearest to zero (probes). All that meet in a bucket are compared exactly, and the best k
over all buckets stay.

Rows that move are tables * (1 + probes) a vector, whatever their number; they take the vector along once, to where it
is compared, and as numbers of the width in which it is given. Equal vectors are one vector with several ids:
they never meet as pairs, and an id's equals come before others as its nearest. A bucket that stays crowded at the whole
code is cut in blocks whose pairs are tasks, so nothing in it is dropped. ``similarity.top_similar`` is the exact query.
Vectors are of one length; zero vectors have similarity 0 with all. An empty frame gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creasework.sources.shared import settle

#: Bits of a code; bits that the shortest bucket has.
BITS, LEAST_BITS = 20, 2
#: Codes by their counts that may be broadcast.
BROADCAST_CODES = 1_000_000


def _planes(size: int, table: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, table]).standard_normal((size, BITS))


def _classes(vectors: DataFrame) -> DataFrame:
    """(cid, vector, ids): different vectors, with how many ids and the smallest id of each."""
    return vectors.groupBy("vector").agg(F.min("id").alias("cid"), F.count("*").alias("ids"))


def codes(classes: DataFrame, tables: int, probes: int, seed: int) -> DataFrame:
    """(t, code, flips, cid): each vector's own code in each table, and its bits by how near to change they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for p in batches:
            x = np.array(p["vector"].tolist(), float)
            for t in range(tables) if len(p) else ():
                if t not in planes:
                    planes[t] = _planes(x.shape[1], t, seed)
                products = x @ planes[t]
                code = (products > 0) @ (1 << np.arange(BITS - 1, -1, -1))
                yield pd.DataFrame({"t": t, "code": code, "flips": (np.argsort(np.abs(products), axis=1, kind="stable")[:, : max(probes * 3, 1)]).tolist(), "cid": p["cid"]})

    return classes.select("cid", "vector").mapInPandas(run, "t int, code long, flips array<int>, cid long")


def bucket_bits(coded: DataFrame, crowd: int) -> DataFrame:
    """(t, code, bits): of each code that there is, the length of the shortest beginning that at most crowd share."""
    counts = coded.groupBy("t", "code").agg(F.count("*").alias("n"))
    levels = range(LEAST_BITS, BITS + 1)
    prefix = lambda b: F.shiftright("code", BITS - b)
    each = counts.select("t", F.explode(F.array(*(F.struct(F.lit(b).alias("bits"), prefix(b).alias("prefix")) for b in levels))).alias("x"), "n").groupBy("t", "x").agg(F.sum("n").alias("n"))
    return each.select("t", "x.bits", "x.prefix", "n").where((F.col("n") <= crowd) | (F.col("bits") == BITS))


def buckets(coded: DataFrame, crowd: int, probes: int) -> DataFrame:
    """(t, bits, prefix, n, cid, asks, all): where each vector lies, and the buckets that it asks as well.

    A beginning is a bucket if it is small enough and the one a bit shorter is not.
    """
    small = settle(bucket_bits(coded, crowd), "buckets")
    longer = small.select("t", F.col("bits").alias("b"), F.col("prefix").alias("p")).where(F.col("b") < BITS)
    above = small.join(longer, (small["t"] == longer["t"]) & (small["bits"] == longer["b"] + 1) & (F.shiftright(small["prefix"], 1) == longer["p"]), "left_anti")
    leaves = settle(above.select("t", "bits", "prefix", "n"), "leaves")
    leaves_ = F.broadcast(leaves) if leaves.count() <= BROADCAST_CODES else leaves
    spans = F.array(*(F.struct(F.lit(b).alias("bits"), F.shiftright("code", BITS - b).alias("prefix")) for b in range(LEAST_BITS, BITS + 1)))
    own = coded.select("t", "cid", "code", "flips", F.explode(spans).alias("x")).select("t", "cid", "code", "flips", "x.bits", "x.prefix").join(leaves_, ["t", "bits", "prefix"])
    # the bits of the own bucket that are nearest to change, the nearest first; the code with one changed is asked
    near = F.slice(F.filter("flips", lambda i: i < F.col("bits")), 1, probes)
    asked = own.select("t", "cid", F.explode(near).alias("i"), "code").withColumn("code", F.col("code").bitwiseXOR(F.expr(f"shiftleft(1L, {BITS - 1} - i)")))
    other = asked.select("t", "cid", F.explode(spans).alias("x")).select("t", "cid", "x.bits", "x.prefix").join(leaves_, ["t", "bits", "prefix"])
    both = own.select("t", "bits", "prefix", "n", "cid", F.lit(False).alias("asks"))
    both = settle(both.unionByName(other.select("t", "bits", "prefix", "n", "cid", F.lit(True).alias("asks"))), "members")
    all_ = settle(both.groupBy("t", "bits", "prefix").agg(F.count("*").alias("all")), "sizes")
    return both.join(F.broadcast(all_) if all_.count() <= BROADCAST_CODES else all_, ["t", "bits", "prefix"])


def _blocks(members: DataFrame, block_rows: int) -> DataFrame:
    """Members dealt to the pairs of blocks of their bucket: as one that is compared (left), and as one compared with.
    Those that only ask are compared, so the left has as many blocks as they need too."""
    count = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / block_rows)).cast("int")
    block = lambda c: F.pmod(F.xxhash64("cid"), count(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), count(c) - 1))
    keys = ["t", "bits", "prefix"]
    left = members.select(*keys, "cid", "vector", F.lit(True).alias("left"), block("all").alias("a"), every("n").alias("b"))
    right = members.where(~F.col("asks")).select(*keys, "cid", "vector", F.lit(False).alias("left"), every("all").alias("a"), block("n").alias("b"))
    return left.unionByName(right)


def nearest_classes(classes: DataFrame, k: int, tables: int, probes: int, crowd: int, seed: int) -> DataFrame:
    """(a, b, similarity) of the k nearest other vectors found for each."""
    coded = settle(codes(classes, tables, probes, seed), "codes")
    members = _blocks(buckets(coded, crowd, probes).join(classes.select("cid", "vector"), "cid"), 2 * crowd)

    def compare(p: pd.DataFrame) -> pd.DataFrame:
        x, y = p[p.left].drop_duplicates("cid").sort_values("cid"), p[~p.left].sort_values("cid")
        if x.empty or y.empty:
            return pd.DataFrame({"a": [], "b": [], "similarity": []})
        unit = lambda q: (m := np.array(q["vector"].tolist(), float)) / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
        s, own = np.round(unit(x) @ unit(y).T, 4), y["cid"].to_numpy()
        s[x["cid"].to_numpy()[:, None] == own[None, :]] = -np.inf
        best = np.argsort(-s, axis=1, kind="stable")[:, :k]
        out = pd.DataFrame({"a": np.repeat(x["cid"].to_numpy(), best.shape[1]), "b": own[best].ravel(), "similarity": np.take_along_axis(s, best, 1).ravel()})
        return out[np.isfinite(out.similarity)]

    found = members.groupBy("t", "bits", "prefix", "a", "b").applyInPandas(compare, "a long, b long, similarity double").distinct()
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def _first_ids(vectors: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """(cid, first): the n smallest ids of each vector. Buckets of ids keep a vector that most rows share apart."""
    dealt = vectors.join(classes.select("cid", "vector"), "vector").select("cid", "id", F.pmod(F.xxhash64("id"), F.lit(1000)).alias("part"))
    least = lambda c: F.slice(F.sort_array(c), 1, n)
    row = F.row_number().over(Window.partitionBy("cid", "part").orderBy("id"))
    return dealt.withColumn("row", row).where(F.col("row") <= n).groupBy("cid").agg(least(F.collect_list("id")).alias("first"))


def _numbers(vectors: DataFrame) -> Column:
    """The vector as it is if it is of floats, which products take as doubles exactly; else as doubles."""
    return F.col("vector") if vectors.schema["vector"].dataType.simpleString() == "array<float>" else F.col("vector").cast("array<double>")


def top_similar(vectors: DataFrame, k: int = 20, tables: int = 12, probes: int = 6, crowd: int = 256, seed: int = 7) -> DataFrame:
    """(id_a, id_b, similarity, rank) of the k nearest others found for each id; similarity to 4 digits, ties by id."""
    v = settle(vectors.select(F.col("id").cast("long").alias("id"), _numbers(vectors).alias("vector")), "vectors")
    classes = settle(_classes(v), "classes")
    near = nearest_classes(classes, k, tables, probes, crowd, seed)
    first = settle(_first_ids(v, classes, k + 1), "first_ids")
    zero = F.exists("vector", lambda x: x != 0)
    own = classes.where(zero & (F.col("ids") > 1)).select(F.col("cid").alias("a"), F.col("cid").alias("b"), F.lit(1.0).alias("similarity"))
    offers = near.unionByName(own).join(first.select(F.col("cid").alias("b"), "first"), "b").groupBy("a").agg(F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "first"))).alias("offers"))
    flat = F.flatten(F.transform("offers", lambda o: F.transform(o["first"], lambda i: F.struct(o["s"].alias("s"), i.alias("id")))))
    best = offers.select("a", F.slice(F.sort_array(flat), 1, k + 1).alias("best"))  # one more: an id is no neighbour of itself
    ids = v.join(classes.select("cid", "vector"), "vector").select(F.col("id").alias("id_a"), F.col("cid").alias("a"))
    mine = lambda: F.slice(F.filter("best", lambda o: o["id"] != F.col("id_a")), 1, k)
    out = ids.join(best, "a").select("id_a", F.posexplode(mine()).alias("rank", "o"))
    return out.select("id_a", F.col("o.id").alias("id_b"), (-F.col("o.s")).alias("similarity"), (F.col("rank") + 1).alias("rank"))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours that were found; ties at the last place count by similarity."""
    last = exact.groupBy("id_a").agg(F.min("similarity").alias("last"), F.count("*").alias("n"))
    hits = found.join(last, "id_a").where(F.col("similarity") >= F.col("last")).groupBy("id_a").agg(F.count("*").alias("hits"))
    r = last.join(hits, "id_a", "left").agg((F.sum(F.least(F.coalesce("hits", F.lit(0)), "n")) / F.sum("n")).alias("recall")).first()
    return r["recall"]
