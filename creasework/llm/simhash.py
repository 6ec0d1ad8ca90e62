"""Operator 7: SimHash near-duplicates by bit-sliced comparison.

A fingerprint is a majority vote over shingle hashes. Fingerprints that may lie within the radius meet in buckets; a
bucket stores its members as vertical bit planes, and one query is compared with 64 members at a time: differing bits
are added up in bit-sliced counters by carry-save adders, and a block is abandoned once all members exceed the radius.
A bucket gives a spanning forest of its links, never all pairs; connected components join the forests.

Two searches feed the buckets:

* ``near_fingerprints`` is exact: with r differing bits at most, one of r+1 parts of the bits agrees (pigeonhole). A
  part that too many fingerprints share is cut again by the same rule on its remaining bits, until buckets are small
  (a leaf has few free bits, so few distinct fingerprints fit in it).
* ``near_texts`` is for similarity of shingle sets (five words, 0.8 by default), where the radius is too wide for
  pigeonhole: buckets are minhash bands and the comparison uses 512-bit fingerprints. Distances far below the expected
  one are links; what lies around it is held against the shingles themselves, unless it is connected already. An
  overfull band is first linked to a few leaders, which leaves one group of most; a band with several groups left is
  compared block by block, so that rows which share a band are always compared or connected.

Null texts count as empty. Texts without words have the fingerprint zero and link like any other. Repeated rows, null
ids and extra columns are allowed; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creasework.llm.common import components, join_one, settle, slices, small_side, table

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Rows of a bucket that are compared at once; larger buckets are cut first.
BUCKET_ROWS = 128
#: Rows, of whole buckets, that a task compares at once (one bucket at least): 2 MB of unpacked 512-bit fingerprints.
COMPARED_ROWS = 4096
_BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str | None, k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of k words, repeats included (the whole sequence if it is shorter; none if there are no words)."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-k] + 1))
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """Bit i is set if over half of the hashes have it."""
    if not len(hashes):
        return 0
    cells = (hashes[:, None].view(np.uint8).reshape(-1, 8) + (np.arange(8) * 256)).ravel()
    votes = (np.bincount(cells, minlength=2048).reshape(8, 256) @ _BIT_OF_BYTE).ravel()
    return int.from_bytes(np.packbits(2 * votes > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, w0): the 64-bit fingerprint of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            prints = [majority(shingle_hashes(t, shingle)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints, pa.int64())], names=["doc_id", "w0"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, w0 long")


# --- bit-sliced comparison ---------------------------------------------------------------------------------------


def _planes(bits: np.ndarray) -> np.ndarray:
    """Plane [i, block]: bit i of the block's 64 members, one member a bit. bits: a row of zeros and ones for each member."""
    blocks = -(-len(bits) // 64)
    own = np.zeros((blocks * 64, bits.shape[1]), np.uint8)
    own[: len(bits)] = bits
    return np.packbits(np.ascontiguousarray(own.reshape(blocks, 64, -1).transpose(2, 0, 1)), axis=2, bitorder="little").view(np.uint64)[:, :, 0]


def _exceeds(digits: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Members whose bit-sliced count is above the radius."""
    above, same = over.copy(), np.full(len(over), ALL)
    for d in range(len(digits) - 1, -1, -1):
        if radius >> d & 1:
            same &= digits[d]
        else:
            above |= same & digits[d]
            same &= ~digits[d]
    return above


def _unpacked(prints: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")


def within(prints: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of the same group that differ in radius bits at most. group: sorted, from 0.

    Members fill blocks of 64 in order, whatever their group; a query is compared with the blocks that hold later
    members of its group, and only those members are alive at the start.
    """
    n, width = len(prints), prints.shape[1] * 64
    end = np.cumsum(np.bincount(group))[group]  # after the last member of the group
    bits = _unpacked(prints)
    planes, bits = _planes(bits), np.ascontiguousarray(bits.T)
    place = np.arange(n)
    first = (place + 1) // 64
    spans = np.where(end > place + 1, (end - 1) // 64 - first + 1, 0)
    query = np.repeat(place, spans)
    target = np.repeat(first, spans) + np.arange(len(query)) - np.repeat(np.cumsum(spans) - spans, spans)
    low = np.clip(query + 1 - target * 64, 0, 63).astype(np.uint64)
    high = np.clip(target * 64 + 64 - end[query], 0, 63).astype(np.uint64)
    alive = (ALL << low) & (ALL >> high)
    digits = [np.zeros(len(query), np.uint64) for _ in range(radius.bit_length())]
    over = np.zeros(len(query), np.uint64)
    for i in range(0, width, 2):
        if not len(query):
            break
        x, y = (planes[k][target] ^ (np.uint64(0) - bits[k][query].astype(np.uint64)) for k in (i, i + 1))
        if digits:
            half = x ^ y
            digits[0], carry = half ^ digits[0], (x & y) | (half & digits[0])  # carry-save: two planes and the units digit
            for d in range(1, len(digits)):
                digits[d], carry = digits[d] ^ carry, digits[d] & carry
            over |= carry
        else:
            over |= x | y
        if i % 8 == 6 or i == width - 2:
            alive &= ~_exceeds(digits, over, radius)
            keep = alive != 0
            if not keep.all():
                query, target, alive, over = query[keep], target[keep], alive[keep], over[keep]
                digits = [d[keep] for d in digits]
    if not len(query):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    hit, bit = np.nonzero(np.unpackbits(alive[:, None].view(np.uint8), axis=1, bitorder="little"))
    return query[hit], target[hit] * 64 + bit


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each index is linked to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _buckets(p: pd.DataFrame) -> np.ndarray:
    """The bucket of each row, numbered from 0; rows are sorted by (path, key)."""
    path, key = p["path"].to_numpy(), p["key"].to_numpy()
    return np.concatenate(([0], np.cumsum((path[1:] != path[:-1]) | (key[1:] != key[:-1])))).astype(np.int64)


def _parts(group: np.ndarray, rows: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole buckets of about so many rows (one bucket at least)."""
    ends = np.cumsum(np.bincount(group))
    at = 0
    while at < len(group):
        last = max(int(np.searchsorted(ends, at + rows, "right")) - 1, int(group[at]))
        yield at, int(ends[last])
        at = int(ends[last])


def _by_bucket(compare: Callable[[pd.DataFrame], pd.DataFrame], most: int | None = None):
    """Over batches sorted by (path, key): compare gets whole buckets, about COMPARED_ROWS (or most) rows at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for p in chain(batches, (None,)):
            if p is not None:
                if not len(p):
                    continue
                held.append(p)
                last = p[["path", "key"]].iloc[-1]
                if (held[0][["path", "key"]].iloc[0] == last).all():
                    continue  # one bucket so far
            if not held:
                return
            rows = pd.concat(held, ignore_index=True)
            group = _buckets(rows)
            whole = len(rows) if p is None else int(np.searchsorted(group, group[-1]))
            held = [rows[whole:]]
            for a, e in _parts(group[:whole], most or COMPARED_ROWS):
                yield compare(rows[a:e].reset_index(drop=True))

    return run


def _links_within(words: int, radius: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A link from each member of a bucket to the first member of its tree."""
    cols = [f"w{i}" for i in range(words)]

    def links(p: pd.DataFrame) -> pd.DataFrame:
        prints = np.ascontiguousarray(p[cols].to_numpy()).view(np.uint64)
        node = p["node"].to_numpy()
        out = pd.DataFrame({"a": node, "b": node[_forest(len(p), *within(prints, _buckets(p), radius))]})
        return out[out.a != out.b]

    return links


def _compare(rows: DataFrame, compare: Callable[[pd.DataFrame], pd.DataFrame], schema: str = "a long, b long", most: int | None = None) -> DataFrame:
    """What compare finds in whole buckets (path, key)."""
    return rows.repartition("path", "key").sortWithinPartitions("path", "key", "node").mapInPandas(_by_bucket(compare, most), schema)


# --- exact search for small radii --------------------------------------------------------------------------------


def _masks(levels: int, parts: int) -> list[list[int]]:
    """Masks of level l: the bits in which the members of a bucket agree; each level cuts what is free in parts."""
    out, now = [], [0]
    for _ in range(levels):
        new = []
        for m in now:
            free = [b for b in range(64) if not m >> b & 1]
            new += [m | sum(1 << b for b in free[p::parts]) for p in range(parts)]
        out.append(new)
        now = new
    return out


def near_fingerprints(prints: DataFrame, radius: int = 2, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b) links that connect all distinct 64-bit fingerprints w0 that differ in radius bits at most; exact."""
    parts = radius + 1
    levels = 1
    while 64 * (1 - 1 / parts) ** levels > 6:
        levels += 1
    masks = [[m - (1 << 64) if m >> 63 else m for m in ms] for ms in _masks(levels, parts)]
    rows = prints.select("w0").distinct().select(F.col("w0").alias("node"), "w0", F.lit(0).alias("up"))
    links = None
    for level, own in enumerate(masks):
        paths = F.array(*(F.lit(p) for p in range(parts)))
        rows = rows.select("node", "w0", F.explode(F.transform(paths, lambda p: F.col("up") * parts + p)).alias("path"))
        rows = rows.withColumn("key", F.col("w0").bitwiseAND(F.element_at(F.array(*(F.lit(m).cast("long") for m in own)), F.col("path") + 1)))
        shared = rows.groupBy("path", "key").agg(F.count("*").alias("n")).where("n > 1")
        rows = settle(join_one(rows, shared, ["path", "key"]), "buckets")
        last = level == len(masks) - 1
        found = _compare((rows if last else rows.where(F.col("n") <= bucket_rows)).select("path", "key", "node", "w0"), _links_within(1, radius))
        links = found if links is None else links.union(found)
        rows = rows.where(F.col("n") > bucket_rows).select("node", "w0", F.col("path").alias("up"))
        if last or rows.isEmpty():
            return links


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, w0, component_id) of each row; component_id: the smallest doc_id that links reach."""
    prints = settle(fingerprints(docs, shingle), "simhash")
    roots = components(near_fingerprints(prints, radius))
    least = prints.groupBy("w0").agg(F.min("doc_id").alias("least"))
    named = settle(least.join(roots, least.w0 == roots.node, "left").select("w0", "least", F.coalesce("root", "w0").alias("root")), "named")
    heads = named.groupBy("root").agg(F.min("least").alias("component_id"))
    heads = settle(join_one(named, heads, ["root"]).select("w0", "component_id"), "heads")
    return join_one(prints, heads, ["w0"]).select("doc_id", "w0", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")


# --- similar texts -----------------------------------------------------------------------------------------------

#: Bands and rows of a band: two texts of similarity 0.8 share a band with probability 0.998.
BANDS, BAND_ROWS = 12, 4
#: 64-bit words of a text's fingerprint. The spread of distances shrinks with its root.
WORDS = 8
#: Standard deviations around the expected distance: below, a link is sure (1 in 1000 is not); above, there is none.
SURE, OPEN = 3.0, 3.0
#: Least shingle hashes of a text that candidates are compared by: all of them up to so many, else a sample of the
#: union (its standard error is below 0.009).
SHINGLES = 2048
_SEEDS = np.random.default_rng(7).integers(1, 1 << 63, (2, BANDS * BAND_ROWS), dtype=np.uint64)


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = h ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def text_signatures(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(doc_id, uid, w0, w1.., bands): fingerprint and minhash bands of the set of shingles; uid numbers the rows."""
    cols = [f"w{i}" for i in range(WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            prints, bands = [], []
            for t in b.column("text").to_pylist():
                h = np.unique(shingle_hashes(t, shingle))
                prints.append([majority(_mixed(h, i)) for i in range(WORDS)])
                low = np.full(BANDS * BAND_ROWS, ALL)
                for at in range(0, len(h), 4096):
                    part = h[at : at + 4096, None] * (_SEEDS[0] | np.uint64(1)) + _SEEDS[1]
                    low = np.minimum(low, (part ^ (part >> np.uint64(31))).min(axis=0))
                bands.append([xxhash.xxh64_intdigest(x.tobytes(), i) - (1 << 63) for i, x in enumerate(low.reshape(BANDS, BAND_ROWS))])
            words = np.array(prints, np.int64).reshape(len(prints), WORDS)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("uid"), *(pa.array(words[:, i]) for i in range(WORDS)), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "uid", *cols, "bands"])

    rows = docs.select("doc_id", "text", "uid" if "uid" in docs.columns else F.monotonically_increasing_id().alias("uid"))
    return rows.mapInArrow(run, f"doc_id long, uid long, {', '.join(f'{c} long' for c in cols)}, bands array<long>")


def distance(bits: int, similarity: float, deviations: float) -> int:
    """Bits in which fingerprints of sets of this similarity differ, with so many standard deviations more.

    Sets of similarity s have an angle of arccos(2s / (1 + s)) (equal sizes), so their fingerprints differ in about
    bits * angle / pi bits.
    """
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return max(0, int(bits * share + deviations * np.sqrt(bits * share * (1 - share))))


def _doubtful(words: int, radius: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Rows of a bucket that may be similar to a row of another root."""
    cols = [f"w{i}" for i in range(words)]

    def rows(p: pd.DataFrame) -> pd.DataFrame:
        prints = np.ascontiguousarray(p[cols].to_numpy()).view(np.uint64)
        root = p["root"].to_numpy()
        i, j = within(prints, _buckets(p), radius)
        open_ = root[i] != root[j]
        return p.iloc[np.unique(np.concatenate((i[open_], j[open_])))][["path", "key", "node"]]

    return rows


def _verified(words: int, radius: int, similarity: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Links between rows of different roots whose shingle sets are similar; pairs that are linked already are left out."""
    cols = [f"w{i}" for i in range(words)]

    def links(p: pd.DataFrame) -> pd.DataFrame:
        prints = np.ascontiguousarray(p[cols].to_numpy()).view(np.uint64)
        root, sets = p["root"].to_numpy(), [np.frombuffer(x, np.uint32) for x in p["shingles"]]
        i, j = within(prints, _buckets(p), radius)
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
        order = np.argsort(np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1), kind="stable")  # the likeliest first
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        found = []
        for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
            a, b = top(root[x]), top(root[y])
            if a != b and jaccard(sets[x], sets[y]) >= similarity:
                parent[max(a, b)] = min(a, b)
                found.append((root[x], root[y]))
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return links


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets by their least hashes: exact if neither was cut, else of the least SHINGLES of both."""
    both = np.union1d(a, b)
    if max(len(a), len(b)) >= SHINGLES:
        both = both[:SHINGLES]
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum()) / max(1, len(both))


def shingle_sets(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(node, shingles): the least SHINGLES hashes of each row's shingles, ascending, of 32 bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 100):
            sets = [np.unique(shingle_hashes(t, shingle) >> np.uint64(32)).astype(np.uint32)[:SHINGLES].tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return docs.select("node", "text").mapInArrow(run, "node long, shingles binary")


def _blocks(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """Overfull buckets cut in blocks; each pair of blocks becomes a bucket of its own."""
    sizes = rows.groupBy("path", "key").agg(F.ceil(F.count("*") / bucket_rows).cast("int").alias("blocks"))
    rows = join_one(rows, sizes, ["path", "key"]).withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("key", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).drop("own", "other", "blocks")


def near_texts(items: DataFrame, texts: DataFrame | None = None, similarity: float = 0.8, shingle: int = 5, bucket_rows: int = 512, levels: int = 4, leaders: int = 8) -> DataFrame:
    """(a, b): links from the nodes of distinct items (node, w0, w1.., bands) to the smallest node that similar shingle
    sets connect them with.

    Fingerprints that differ in few bits are links; those near the expected distance are held against the shingles of
    texts (uid, text; items then have the uid of one of their texts), unless other links connect the two already.
    Without texts, one standard deviation above the expected distance decides.
    """
    cols = [c for c in items.columns if c[0] == "w"]
    bits = 64 * len(cols)
    sure, radius = distance(bits, similarity, 1.0 if texts is None else -SURE), distance(bits, similarity, OPEN)
    out = lambda roots: roots.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b")
    rows = items.select("node", F.posexplode("bands").alias("path", "key"))
    shared = rows.groupBy("path", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = settle(join_one(join_one(rows, shared, ["path", "key"]), items.select("node", *cols), ["node"]), "bands")
    small, crowded = rows.where(F.col("n") <= bucket_rows).drop("n"), rows.where(F.col("n") > bucket_rows).drop("n")
    roots = components(_compare(small.select("path", "key", "node", *cols), _links_within(len(cols), sure)))
    rooted = lambda d: join_one(d, roots, ["node"], "left").withColumn("root", F.coalesce("root", "node"))
    for i in range(levels):
        # an overfull bucket: link what is near one of a few leaders to it, until one group is left or the rounds end
        if crowded.isEmpty():
            break
        several = rooted(crowded).groupBy("path", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("path", "key")
        crowded = settle(join_one(crowded, several, ["path", "key"]), "crowded")
        heads = crowded.groupBy("path", "key").agg(*(F.min(F.struct(F.xxhash64("node", F.lit(i * leaders + k)).alias("order"), "node", *cols)).alias(f"h{k}") for k in range(leaders)))
        apart = lambda h: sum(F.bit_count(F.col(c).bitwiseXOR(F.col(h)[c])) for c in cols)
        met = join_one(crowded, heads, ["path", "key"])
        near = F.array_compact(F.array(*(F.when(apart(f"h{k}") <= sure, F.col(f"h{k}.node")) for k in range(leaders))))
        links = met.select(F.col("node").alias("a"), F.explode(near).alias("b")).where("a <> b")
        roots = components(links.union(out(roots)))
    if not crowded.isEmpty():
        several = rooted(crowded).groupBy("path", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("path", "key")
        crowded = settle(_blocks(join_one(crowded, several, ["path", "key"]), bucket_rows), "blocks")
        links = _compare(crowded.select("path", "key", "node", *cols), _links_within(len(cols), sure))
        roots = components(links.union(out(roots)))
    if texts is None:
        return out(roots)
    # what may be similar though its fingerprints don't say so for sure
    rows = settle(rooted(small.union(crowded)), "rooted")
    found = settle(_compare(rows.select("path", "key", "node", "root", *cols), _doubtful(len(cols), radius), "path int, key long, node long"), "doubtful")
    if found.isEmpty():
        return out(roots)
    wanted = settle(items.select("node", "uid").join(found.select("node").distinct(), "node"), "wanted")
    sets = settle(shingle_sets(texts.join(small_side(wanted), "uid"), shingle), "shingles")
    open_ = join_one(join_one(rows, found, ["path", "key", "node"]), sets, ["node"])
    links = _compare(open_.select("path", "key", "node", "root", *cols, "shingles"), _verified(len(cols), radius, similarity), most=1024)
    return out(components(links.union(out(roots))))


def dedup(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without near copies: of each group that links connect, the row with the smallest doc_id stays."""
    numbered = settle(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("uid")), "rows")  # numbered once
    cols = [f"w{i}" for i in range(WORDS)]
    signed = settle(text_signatures(numbered.select("row.doc_id", "row.text", "uid"), shingle).withColumn("node", F.xxhash64(*cols)), "signatures")
    items = signed.groupBy("node").agg(*(F.min(c).alias(c) for c in (*cols, "bands")), F.min("uid").alias("uid"))
    links = near_texts(settle(items, "items"), numbered.select("uid", "row.text"), similarity, shingle)
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    named = join_one(signed.select("doc_id", "uid", "node"), roots, ["node"], "left").withColumn("root", F.coalesce("root", "node"))
    named = settle(named, "roots")
    first = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid"))["uid"].alias("uid"))
    gone = settle(named.join(first, "uid", "left_anti").select("uid"), "gone")  # by the unique uid, so that no group meets in one task
    return numbered.join(small_side(gone), "uid", "left_anti").select("row.*")
