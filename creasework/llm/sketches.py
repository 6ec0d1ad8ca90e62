"""Operator 2: document fingerprints that subtract, as invertible Bloom lookup sketches.

A text is cut into paragraphs: at line ends, and within a line wherever the last four characters hash to a cut, so an
edit leaves the paragraphs around it alone. Each paragraph's digest (with its number among equal ones) is added to
three cells of a small sketch, each cell holding a count and the exclusive or of digests and of check sums. The
difference of two sketches holds only the paragraphs in which the texts differ; peeling cells with a single digest
recovers them. When peeling gets stuck, both sketches are made anew with four times the cells, until it succeeds.

The likeness of two fingerprints is the share of paragraphs that did not differ (1 for two empty texts). Null texts
count as empty. Equal texts have equal fingerprints. Rows of equal doc_id follow each other by a hash of the text, then
by the text; null ids come after all others. An empty table gives an empty result; a single row is its own successor.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creasework.llm.common import table

#: Mean and most characters of a paragraph within a line; cells of a fingerprint in each of its three parts.
MEAN, MOST, CELLS = 16, 64, 8
_B = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B ** i and B ** -i modulo 2 ** 64 for i < n."""
    if len(_POWERS[0]) < n:
        size = 2 * n
        for k, base in enumerate((_B, pow(_B, -1, 1 << 64))):
            _POWERS[k] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, base, np.uint64))), dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def paragraph_digests(text: str) -> np.ndarray:
    """A digest for each paragraph; equal paragraphs get different ones by their number."""
    if not text:
        return np.empty(0, np.uint64)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    roll = c * np.uint32(0x85EBCA6B)
    for back, factor in ((1, 0xC2B2AE35), (2, 0x27D4EB2F), (3, 0x165667B1)):
        roll[back:] += c[:-back] * np.uint32(factor)
    roll ^= roll >> np.uint32(15)
    roll *= np.uint32(0x2C1B3C6D)
    ends = np.nonzero(((roll >> np.uint32(12)) % np.uint32(MEAN) == 0) | (c == 10))[0] + 1
    if not len(ends) or ends[-1] != len(c):
        ends = np.append(ends, len(c))
    starts = np.concatenate(([0], ends[:-1]))
    parts = -(-(ends - starts) // MOST)
    if (parts > 1).any():
        starts = np.repeat(starts, parts) + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * MOST
        ends = np.append(starts[1:], len(c))
    up, down = _powers(len(c) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((c.astype(np.uint64) + np.uint64(0x632BE5AB)) * up[: len(c)], dtype=np.uint64)))
    digests = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    order = np.argsort(digests, kind="stable")
    ordered = digests[order]
    first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    number = np.arange(len(ordered)) - np.maximum.accumulate(np.where(first, np.arange(len(ordered)), 0))
    return _mix(ordered + number.astype(np.uint64) * np.uint64(_B))


def _check(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype(np.uint32)


class Sketches:
    """The sketches of several texts with equally many cells, in flat arrays: text by text, three parts of q cells."""

    def __init__(self, digests: list[np.ndarray], q: int):
        self.n, self.q = len(digests), q
        self.count = np.zeros(3 * q * self.n, np.int32)
        self.keys = np.zeros(3 * q * self.n, np.uint64)
        self.checks = np.zeros(3 * q * self.n, np.uint32)
        if self.n:
            own = np.repeat(np.arange(self.n), [len(d) for d in digests])
            self._add(np.concatenate(digests), own, np.ones(len(own), np.int32))

    def _add(self, keys: np.ndarray, own: np.ndarray, signs: np.ndarray) -> np.ndarray:
        places = []
        for part in range(3):
            cell = (_mix(keys + np.uint64((part + 1) * _B & 0xFFFFFFFFFFFFFFFF)) % np.uint64(self.q)).astype(np.int64)
            places.append((own * 3 + part) * self.q + cell)
            np.add.at(self.count, places[-1], signs)
            np.bitwise_xor.at(self.keys, places[-1], keys)
            np.bitwise_xor.at(self.checks, places[-1], _check(keys))
        return np.concatenate(places)

    def strings(self) -> list[str]:
        cells = np.empty((self.n, 3 * self.q), [("count", "<i4"), ("key", "<u8"), ("check", "<u4")])
        for name, own in (("count", self.count), ("key", self.keys), ("check", self.checks)):
            cells[name] = own.reshape(self.n, -1)
        return [base64.b64encode(row.tobytes()).decode() for row in cells]

    def minus(self, other: Sketches, rows: np.ndarray, others: np.ndarray) -> Sketches:
        """The sketches of rows less those of other's rows."""
        out = Sketches([], self.q)
        out.n = len(rows)
        pick = lambda x, at: x.reshape(-1, 3 * self.q)[at].ravel()
        out.count = pick(self.count, rows) - pick(other.count, others)
        out.keys = pick(self.keys, rows) ^ pick(other.keys, others)
        out.checks = pick(self.checks, rows) ^ pick(other.checks, others)
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(whether each sketch could be emptied, and of each recovered digest: sketch, digest, sign). Empties them."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        look = np.nonzero(self.count)[0]
        while len(look):
            pure = look[(np.abs(self.count[look]) == 1) & (_check(self.keys[look]) == self.checks[look])]
            if not len(pure):
                break
            own, keys, signs = pure // (3 * self.q), self.keys[pure], self.count[pure]
            order = np.lexsort((keys, own))
            own, keys, signs = own[order], keys[order], signs[order]
            new = np.concatenate(([True], (own[1:] != own[:-1]) | (keys[1:] != keys[:-1])))
            own, keys, signs = own[new], keys[new], signs[new]
            found.append((own, keys, signs))
            look = np.unique(self._add(keys, own, -signs))
        stuck = (self.count != 0) | (self.keys != 0)
        done = ~stuck.reshape(self.n, -1).any(axis=1) if self.n else np.zeros(0, bool)
        empty = (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int32))
        own, keys, signs = (np.concatenate(x) for x in zip(*found, strict=True)) if found else empty
        return done, own, keys, signs


def differences(left: list[np.ndarray], right: list[np.ndarray], q: int = CELLS) -> list[np.ndarray]:
    """Of each pair, the digests that only one of the two has, by subtracting and peeling sketches."""
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(left)
    open_ = np.arange(len(left))
    while len(open_):
        a, b = (Sketches([x[i] for i in open_], q) for x in (left, right))
        rows = np.arange(len(open_))
        done, own, keys, _ = a.minus(b, rows, rows).peel()
        order = np.argsort(own, kind="stable")
        own, keys = own[order], keys[order]
        cuts = np.searchsorted(own, np.arange(len(open_) + 1))
        for i in np.nonzero(done)[0]:
            out[open_[i]] = keys[cuts[i] : cuts[i + 1]]
        open_, q = open_[~done], q * 4
    return out


def likeness(left: list[np.ndarray], right: list[np.ndarray]) -> list[float]:
    found = differences(left, right)
    return [1.0 if not len(a) + len(b) else 1 - len(d) / (len(a) + len(b)) for a, b, d in zip(left, right, found, strict=True)]


def edited(text: str, follower: str) -> str:
    """The last third of the characters replaced by the follower's first ones."""
    k = len(text) // 3
    return text[: len(text) - k] + follower[:k]


class Ranges:
    """Buckets of rows in order of descending id, then of a hash of the text; null ids come last.

    bounds are ids that cut the rows in equal parts. An id that fills several parts is cut by its hashes instead, so no
    bucket holds many more rows than another, whatever the ids are. heads has the first row (id is null, -id, hash) of
    each bucket that has rows.
    """

    def __init__(self, quantiles: list[int], parts: int, nulls: int, rows_per_bucket: int):
        ids, repeats = np.unique(np.array(quantiles, np.int64), return_counts=True)
        self.bounds = ids[::-1].astype(np.int64)  # bucket group 2i: ids above bounds[i]; 2i + 1: bounds[i] itself
        sizes = np.ones(2 * len(ids) + 2, np.int64)
        sizes[1:-2:2] = repeats[::-1]
        sizes[-1] = max(1, nulls // rows_per_bucket)
        self.sizes, self.first = sizes, np.cumsum(sizes) - sizes
        self.heads: tuple[np.ndarray, np.ndarray] | None = None

    def buckets(self, ids: pd.Series, hashes: pd.Series) -> np.ndarray:
        null = ids.isna().to_numpy()
        own = ids.fillna(0).to_numpy().astype(np.int64)
        up = -self.bounds
        left, right = np.searchsorted(up, -own, "left"), np.searchsorted(up, -own, "right")
        group = np.where(null, len(self.sizes) - 1, left + right)
        share = (hashes.to_numpy().astype(np.float64) + 2.0**63) / 2.0**64
        return self.first[group] + np.minimum((share * self.sizes[group]).astype(np.int64), self.sizes[group] - 1)


def with_followers(docs: DataFrame, rows_per_bucket: int = 2000, most_buckets: int = 100_000) -> DataFrame:
    """(doc_id, text, bucket, halo): rows by descending doc_id in buckets, each sorted in one partition; the first row
    of the next bucket is there too, as halo (of the first bucket at the end of the last). Texts move once.

    What reaches the driver has a row for each bucket: quantiles of ids, and the ids and hashes of the first rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n, nulls = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    parts = max(1, min(most_buckets, (n - nulls) // rows_per_bucket))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts).alias("q")).first()["q"] if parts > 1 and n > nulls else []
    ranges = Ranges(cuts or [], parts, nulls, rows_per_bucket)
    hashed = rows.withColumn("hash", F.xxhash64(F.coalesce("text", F.lit(""))))

    @F.pandas_udf("long")
    def bucket(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(ranges.buckets(ids, hashes))

    order = F.struct(F.col("doc_id").isNull().alias("no_id"), (-F.col("doc_id")).alias("id"), "hash")
    first = hashed.select("doc_id", "hash", bucket("doc_id", "hash").alias("bucket")).groupBy("bucket").agg(F.min(order).alias("head")).orderBy("bucket").collect()
    places = [r["bucket"] for r in first]
    before = dict(zip(places, places[-1:] + places[:-1], strict=True))
    heads = {(None if r["head"]["no_id"] else -r["head"]["id"], r["head"]["hash"]): before[r["bucket"]] for r in first}

    @F.pandas_udf("array<long>")
    def dealt(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        """The row's bucket, and the one before it if the row may be its follower."""
        own = ranges.buckets(ids, hashes)
        keys = zip((None if x != x else int(x) for x in ids.astype(object).where(ids.notna(), float("nan"))), hashes.tolist(), strict=True)
        return pd.Series([[b, heads[k]] if k in heads else [b] for b, k in zip(own.tolist(), keys, strict=True)])

    to = hashed.select("doc_id", "text", "hash", F.posexplode(dealt("doc_id", "hash")).alias("copy", "bucket"))
    moved = to.select("doc_id", "text", "bucket", (F.col("copy") == 1).alias("halo"), "hash")
    return moved.repartition("bucket").sortWithinPartitions("bucket", "halo", F.desc_nulls_last("doc_id"), "hash", "text").drop("hash")


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def results(rows: list[tuple[int | None, str]]) -> pa.RecordBatch:
        """Of all rows but the last, which is only a follower."""
        texts = [t for _, t in rows]
        changed = [edited(t, f) for t, f in zip(texts, texts[1:], strict=False)]
        own, new = [paragraph_digests(t) for t in texts], [paragraph_digests(t) for t in changed]
        out = [
            [d for d, _ in rows[:-1]],
            [len(t) for t in texts[:-1]],
            [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
            Sketches(own[:-1], CELLS).strings(),
            Sketches(new, CELLS).strings(),
            likeness(own[:-1], new),
            likeness(own[:-1], own[1:]),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    held: list[tuple[int | None, str]] = []
    size, bucket, ended = 0, None, False
    for b in batches:
        for doc, text, own, halo in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if own != bucket:
                held, size, bucket, ended = [], 0, own, False
            if ended:
                continue
            held.append((doc, text or ""))
            size += len(held[-1][1])
            if halo or len(held) > 256 or size > 4_000_000:
                if len(held) > 1:
                    yield results(held)
                held, size, ended = held[-1:], len(held[-1][1]), halo


def fingerprints(docs: DataFrame) -> DataFrame:
    return with_followers(docs).mapInArrow(_fingerprinted, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
