import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from creasework.llm import simhash
from creasework.llm.common import components, ranked


def brute_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    out = 0
    for bit in range(64):
        out |= (2 * sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles) > len(shingles)) << bit
    return out


def brute_components(prints):
    ids, parent = list(prints), {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


TEXTS = [None, "", " \t\n", "one", "One", "a b", "a b c d", "a b c d e", "É é É é", "x " * 50, "w" * 5000]


def test_fingerprints_and_components(spark):
    rnd = random.Random(5)
    base = " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 4) for _ in range(300))
    texts = TEXTS + [base, base + " tail", base, *(" ".join(rnd.sample("p q r s t u".split(), 4)) for _ in range(60))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, w0 string")
    got = {r["doc_id"]: r for r in simhash.simhash_components(docs).collect()}
    prints = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: r["w0"] % (1 << 64) for i, r in got.items()} == prints
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(prints)


def test_crowded_buckets_are_exact(spark):
    """More fingerprints around one centre than a bucket may hold: refinement must lose no link."""
    rnd = random.Random(6)
    prints = {0}
    while len(prints) < 700:
        prints.add(rnd.choice(sorted(prints)[:50]) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    prints |= {rnd.getrandbits(64) for _ in range(300)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.near_fingerprints(spark.createDataFrame([(p,) for p in signed], "w0 long"), bucket_rows=40)
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    want = brute_components({p: p % (1 << 64) for p in signed})
    groups = lambda f: {frozenset(x for x in signed if f(x) == g) for g in {f(x) for x in signed}}
    assert groups(lambda p: roots.get(p, p)) == groups(want.get)


@pytest.mark.parametrize(("words", "radius"), [(1, 0), (1, 2), (4, 41)])
def test_bit_sliced_comparison(words, radius):
    rng = np.random.default_rng(words + radius)
    base = rng.integers(0, 1 << 63, (8, words), dtype=np.uint64)
    x = base[rng.integers(0, 8, 300)]
    for _ in range(max(1, radius // 4)):
        x[np.arange(300), rng.integers(0, words, 300)] ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    group = np.sort(rng.integers(0, 3, 300))
    group = np.unique(group, return_inverse=True)[1]
    i, j = simhash.within(x, group, radius)
    distance = np.bitwise_count(x[:, None] ^ x[None]).sum(axis=2)
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if group[a] == group[b] and distance[a, b] <= radius}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_dedup_keeps_one_of_each_group(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    rows = []
    for g in range(12):
        words = [word() for _ in range(200)]
        rows.append((g * 10 + 1, " ".join(words)))
        rows.append((g * 10 + 2, " ".join(words)))
        near = list(words)
        near[rnd.randrange(200)] = word()
        rows.append((g * 10 + 3, " ".join(near)))
    rows += [(None, "alone here"), (900, None), (901, ""), (902, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("_uidx", F.lit(2))
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [g * 10 + 1 for g in range(12)] + [900] and None in ids


def test_crowded_bands(spark):
    """A group of near copies that overfills its bands leaves one row."""
    rnd = random.Random(8)
    base = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    rows = []
    for i in range(300):
        words = list(base)
        words[rnd.randrange(300)] = f"w{i}"
        rows.append((i, " ".join(words)))
    signed = simhash.text_signatures(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("node", F.xxhash64("w0", "w1", "w2", "w3"))
    items = signed.groupBy("node").agg(*(F.min(c).alias(c) for c in ("w0", "w1", "w2", "w3", "bands")))
    roots = components(simhash.near_texts(items, bucket_rows=50)).select("root").distinct().count()
    assert roots == 1


def test_crowded_to_the_last_band(spark):
    """Texts far apart that share all bands, without and with a near pair: compared block by block, none is lost."""
    rnd = random.Random(9)
    prints = [[rnd.getrandbits(64) - (1 << 63) for _ in range(4)] for _ in range(60)]
    prints += [[p[0] ^ 1, *p[1:]] for p in prints[:20]]
    items = spark.createDataFrame([(i, *p, [1] * simhash.BANDS) for i, p in enumerate(prints)], "node long, w0 long, w1 long, w2 long, w3 long, bands array<long>")
    links = {(max(r), min(r)) for r in simhash.near_texts(items, bucket_rows=8, levels=2, leaders=2).collect()}
    assert links == {(60 + i, i) for i in range(20)}


def flipped(rnd, p, n):
    """p, four words of 64 bits, with n bits changed."""
    whole = sum((w % (1 << 64)) << 64 * i for i, w in enumerate(p))
    for bit in rnd.sample(range(256), n):
        whole ^= 1 << bit
    words = [whole >> 64 * i & (1 << 64) - 1 for i in range(4)]
    return [w - (1 << 64) if w >> 63 else w for w in words]


def groups_of(spark, prints, bands, **kind):
    items = spark.createDataFrame([(i, *p, b) for i, (p, b) in enumerate(zip(prints, bands, strict=True))], "node long, w0 long, w1 long, w2 long, w3 long, bands array<long>")
    roots = {r["node"]: r["root"] for r in components(simhash.near_texts(items, **kind)).collect()}
    return [roots.get(i, i) for i in range(len(prints))]


def test_a_star_in_a_crowded_band(spark):
    """600 edits near the original only (radius 44), and copies near to one of them only: one group."""
    rnd = random.Random(12)
    prints = [flipped(rnd, [0] * 4, 128)]
    prints += [flipped(rnd, prints[0], 40) for _ in range(600)]
    prints += [flipped(rnd, p, 40) for p in prints[1:101]]
    assert set(groups_of(spark, prints, [[1] * simhash.BANDS] * len(prints))) == {0}


def test_clusters_that_touch_in_a_crowded_band(spark):
    """Chains of three, the middle near both ends: whichever of them is a leader, the chain stays whole."""
    rnd = random.Random(13)
    first = [flipped(rnd, [0] * 4, rnd.randint(110, 140)) for _ in range(40)]
    middle = [flipped(rnd, p, 35) for p in first]
    prints = first + middle + [flipped(rnd, p, 35) for p in middle]
    got = groups_of(spark, prints, [[1] * simhash.BANDS] * len(prints), bucket_rows=16)
    assert got == list(range(40)) * 3


def test_a_near_pair_shares_one_crowded_band_only(spark):
    rnd = random.Random(14)
    prints = [flipped(rnd, [0] * 4, 128) for _ in range(60)]
    prints += [flipped(rnd, p, 30) for p in prints[:20]]
    bands = [[1, *(rnd.getrandbits(62) for _ in range(simhash.BANDS - 1))] for _ in prints]
    assert groups_of(spark, prints, bands, bucket_rows=8, leaders=2) == [*range(60), *range(20)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_components(docs).count() == 0 and simhash.dedup(docs).count() == 0


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 180)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, **{i: 100 for i in range(101, 180)}}


def test_ranks_are_gapless(spark):
    d = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise("x").alias("k"), "id")
    got = ranked(d, ["k"], ["id"], "r", 1000, 10).groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("r").alias("d"), F.min("r").alias("lo"), F.max("r").alias("hi")).collect()
    assert all(r["n"] == r["d"] == r["hi"] + 1 and r["lo"] == 0 for r in got)


def test_links_do_not_depend_on_the_parts(monkeypatch):
    """Buckets of one row up to several blocks, compared all at once and part by part."""
    import pandas as pd

    rng = np.random.default_rng(11)
    sizes = [1, 2, 200, 3, 64, 65, 1, 130]
    base = rng.integers(0, 1 << 62, (3, 8))
    x = base[rng.integers(0, 3, sum(sizes))] ^ (1 << rng.integers(0, 62, (sum(sizes), 8)))
    p = pd.DataFrame(x, columns=[f"w{i}" for i in range(8)]).assign(path=1, key=np.repeat(np.arange(len(sizes)), sizes), node=np.arange(sum(sizes)))
    found = []
    for rows in (8192, 150, 1):
        monkeypatch.setattr(simhash, "COMPARED_ROWS", rows)
        found.append(pd.concat(simhash._by_bucket(simhash._links_within(8, 40))(iter([p[:150], p[:0], p[150:]]))).to_numpy().tolist())
    assert found[0] and found[0] == found[1] == found[2]


def test_dedup_equals_exact_similarity(spark):
    """Groups by the exact similarity of all pairs; edits around the threshold, and one band more crowded than a bucket."""
    rnd = random.Random(21)
    rows = []
    for g in range(25):
        base = [f"{g}x{rnd.randrange(10**6)}" for _ in range(400)]
        rows.append(" ".join(base))
        for edits in (3, 9, 12, 15, 18, 21, 24, 30, 60):
            words = list(base)
            for at in rnd.sample(range(400), edits):
                words[at] = f"e{rnd.randrange(10**6)}"
            rows.append(" ".join(words))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in rows)]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i - i % 10, i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.dedup(docs).collect()) == sorted(set(root))


def test_joins_of_crowded_keys(spark, monkeypatch):
    from creasework.llm import common

    monkeypatch.setattr(common, "TASK_ROWS", 10)
    rows = spark.range(200).select(F.when(F.col("id") < 150, 1).otherwise(F.col("id")).alias("k"), "id")
    one = spark.createDataFrame([(1, "hot"), (160, "x"), (500, "y")], "k long, v string")
    got = {r["id"]: r["v"] for r in common.join_one(rows, one, ["k"], "left").collect()}
    assert got == {i: "hot" if i < 150 else "x" if i == 160 else None for i in range(200)}
    edges = [(0, i) for i in range(1, 60)] + [(900, i) for i in range(300, 400)] + [(59, 300)]
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(roots.values()) == {0} and len(roots) == 160
