"""Operator 6: toxic passages by maximum-scoring segments.

A token scores its log-odds between toxic and other texts, with a Dirichlet prior: counts of a word are shrunk to the
rates of its beginnings (of 3 to 7 characters), those to the rate of the whole sample. A feature must be LIFT times as
frequent among the tokens of toxic texts as among those of others, whatever the shares of the two in the sample. Tokens
without significant odds score the small negative drift that toxic texts have on ordinary words. A linear-time scan
finds every maximal scoring segment (Ruzzo and Tompa); a segment's expected number in a text of n ordinary tokens is
K n exp(-score) (Karlin and Altschul; log-odds have the scale 1), K being fitted on the non-toxic texts. The evidence
of all segments is the least chance of any number r of them: their normalised scores add up to t with probability
exp(-t) t^(r-1) / (r! (r-1)!), and each further segment costs a factor of two. The score is the share of toxic texts
among those of like evidence, ascending with it (pooled bins of the labelled rows).

Weights are fitted on a sample of labelled rows that are not held out, SAMPLE for each label at most, chosen by a hash
of doc_id; of repeated ids one text (the last in order) is learned from. The curve is fitted on the same rows, each half being scanned with the other half's weights; its odds are
then those of all labelled rows that are not held out, not of the sample. Null and empty
texts score like texts without hits. Repeated rows and null ids give a row each. Repeated labels of an id count once
(toxic if any is); null labels count as none. Without labels of both kinds every score is the toxic share.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creasework.llm.common import bounded_sample, extended, fold, settle, slices, table

#: Labelled texts of each label that the weights are fitted on, at most.
SAMPLE = 8000
#: Beginnings of words that count as features, besides whole words.
STARTS = (3, 4, 5, 6, 7)
#: Standard errors that log-odds must be above zero; weight of the prior in tokens of a feature.
Z, PRIOR = 3.0, 2.0
#: Times that a feature must be more frequent in toxic texts than in others.
LIFT = 2.0
THRESHOLD = 0.7
#: Evidence that counts at most.
MOST = 40.0
#: Segments whose scores may add up; further ones are lower and no longer change the least chance.
SEGMENTS = 50
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)  # whole words end in "$"
    drift: float = -0.01
    k: float = 1e-4
    curve: tuple[tuple[float, ...], tuple[float, ...]] = ((0.0,), (0.5,))  # evidence and the toxic share, both ascending

    #: Remembered tokens at most (some 150 bytes each); then memory starts anew.
    KNOWN = 100_000

    def __post_init__(self) -> None:
        self.known: dict[str, float] = {}

    def token(self, word: str) -> float:
        """The weight of the most specific significant feature, else 0."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > self.KNOWN:
                self.known.clear()
            tries = (f"{word}$", *(word[:n] for n in reversed(STARTS) if len(word) >= n))
            found = self.known[word] = next((self.weights[t] for t in tries if t in self.weights), 0.0)
        return found

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """(tokens, maximal scoring segments as (first token, token after the last, score))."""
        words = WORD.findall((text or "").lower())
        known = list(map(self.known.get, words))
        if None in known:
            known = list(map(self.token, words))
        if not any(known):
            return len(words), []
        places = np.nonzero(np.array(known))[0].tolist()
        return len(words), maximal_segments([(i, known[i]) for i in places], self.drift)

    def evidence(self, n: int, scores: list[float]) -> float:
        """Minus the log of the chance of the segments' scores in a text of n tokens, 0 at least."""
        found = total = 0.0
        floor = math.log(self.k * n + 1e-3)
        for r, s in enumerate(sorted(scores, reverse=True)[:SEGMENTS]):
            total += s - floor
            if s <= floor or total <= 0:
                break
            found = max(found, total - r * math.log(max(total, 1.0)) + math.lgamma(r + 2) + math.lgamma(r + 1) - r * math.log(2))
        return min(MOST, found)

    def score(self, evidence: float) -> float:
        share = float(np.interp(evidence, *self.curve))
        return share + (1 - share) * 1e-3 * evidence / MOST  # more evidence ranks higher where the curve is flat


def maximal_segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, in linear time; hits: (place, score > 0), all other places score drift < 0."""
    stack: list[list[float]] = []  # start, end, sum before the segment, sum up to its end
    total, last = 0.0, -1
    for place, weight in hits:
        total += drift * (place - last - 1)
        now = [place, place + 1, total, total + weight]
        total, last = total + weight, place
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= now[2]:
                j -= 1
            if j < 0 or stack[j][3] >= now[3]:
                stack.append(now)
                break
            now = [stack[j][0], now[1], stack[j][2], now[3]]
            del stack[j:]
    return [(int(a), int(b), float(r - l)) for a, b, l, r in stack]


def _weights(counts: DataFrame, part: int | None) -> Model:
    """Log-odds of words and beginnings from counts (word, part, toxic, n) outside the given part."""
    rows = counts if part is None else counts.where(F.col("part") != part)
    both = rows.groupBy("word").agg(F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(~F.col("toxic"), F.col("n")).otherwise(0)).alias("o"))
    names = F.array(F.concat("word", F.lit("$")), *(F.when(F.length("word") >= n, F.substring("word", 1, n)) for n in STARTS))
    sums = both.select(F.explode(F.array_compact(names)).alias("name"), "t", "o").groupBy("name").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    total = both.agg(F.sum("t"), F.sum("o")).first()
    if not total[0] or not total[1]:
        return Model()
    # what can't be significant stays on the executors; rates within each label, so the sample's balance plays no part
    rate = total[0] / (total[0] + total[1])
    few = sums.where((F.col("t") >= 3) & (F.col("t") * total[1] > LIFT * F.col("o") * total[0])).collect()
    share = {r["name"]: (r["t"], r["o"]) for r in few}
    weights = {}
    for name, (t, o) in share.items():
        word = name.endswith("$")
        above = next((share[name[:n]] for n in reversed(STARTS) if n < len(name) - word + word and name[:n] in share and name[:n] != name), None)
        p = (above[0] + PRIOR * rate) / (above[0] + above[1] + PRIOR) if above else rate
        a, b = t + PRIOR * p, o + PRIOR * (1 - p)
        odds = np.log(a / total[0]) - np.log(b / total[1])
        if odds > Z * np.sqrt(1 / a + 1 / b):
            weights[name] = float(odds)
    heavy = sum(t for name, (t, o) in share.items() if name.endswith("$") and name in weights) / total[0]
    return Model(weights, float(np.log(max(0.5, 1 - heavy))) - 0.01)


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """The toxic share by evidence: weighted shares of bins of equal size, made ascending by pooling neighbours."""
    order = np.argsort(x, kind="stable")
    x, y, weight = x[order], y[order], weight[order]
    none = int((x <= 0).sum())
    size = max(20, (len(x) - none) // 100)
    cuts = [0, none, *range(none + size, len(x) - size + 1, size), len(x)]
    blocks: list[list[float]] = []  # weight, weight of toxic texts, weighted evidence
    for a, e in zip(cuts, cuts[1:], strict=False):
        if a == e:
            continue
        w = weight[a:e]
        blocks.append([float(w.sum()), float((w * y[a:e]).sum()), float((w * x[a:e]).sum())])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return tuple(b[2] / b[0] for b in blocks), tuple(b[1] / b[0] for b in blocks)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Weights, K and curve from labelled documents that are not held out."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    marks = marks.where(fold() != 1)
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = bounded_sample(marks, sample, "toxic", counts)
    # the sample's ids are 2 * sample at most (give or take their hashes), so they are broadcast and no other text moves
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    rows = settle(texts.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")), "labelled")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{Nl}\p{No}]+"), F.lit(0))  # what WORD matches
    tokens = settle(rows.select("part", "toxic", F.explode(words).alias("word")).groupBy("word", "part", "toxic").agg(F.count("*").alias("n")), "tokens")
    halves = {part: _weights(tokens, part) for part in (0, 1)}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, found = [], []
            for part, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                size, segments = halves[part].segments(text)
                n.append(size), found.append(sorted((s for *_, s in segments), reverse=True)[:SEGMENTS])
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.float64()))], names=["toxic", "n", "scores"])

    seen = rows.select("part", "toxic", "text").mapInArrow(scan, "toxic boolean, n long, scores array<double>").toPandas()  # 2 * sample rows at most
    model = _weights(tokens, None)
    y = seen["toxic"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        model.curve = ((0.0,), (float((y.sum() + 0.5) / (len(y) + 1)),))
        return model
    plain = seen[~seen["toxic"]]
    best = np.array([x[0] if len(x) else 0.0 for x in plain["scores"]])
    model.k = float(np.where(best > 0, np.minimum(np.exp(np.minimum(best, 20)), 50), 0).sum() + 1) / float(plain["n"].sum() + 1)
    x = np.array([model.evidence(n, list(s)) for n, s in zip(seen["n"], seen["scores"], strict=True)])
    # the sample may take another share of each label; weights give it the odds that the labels have
    taken = {k: min(1.0, sample / n) for k, n in counts.items()}
    model.curve = _curve(x, y, np.where(y > 0, 1 / taken[True], 1 / taken[False]))
    return model


def scan_texts(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns, score, predicted and the significant passages (tokens first..last, expected number < 0.05)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.__post_init__()
        for b in slices(batches):
            scores, passages = [], []
            for t in b.column("_text").to_pylist():
                n, segments = model.segments(t)
                scores.append(model.score(model.evidence(n, [s for *_, s in segments])))
                expected = [(a, e, s, model.k * n * float(np.exp(-s))) for a, e, s in segments]
                passages.append([{"first": a, "last": e - 1, "score": s, "expected": x} for a, e, s, x in expected if x < 0.05])
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))
            predicted = [int(s >= THRESHOLD) for s in scores]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(scores, pa.float64()), pa.array(predicted, pa.int32()), pa.array(passages, kind)], names=[*keep, "score", "predicted", "passages"])

    schema = extended(docs, keep, "score double, predicted int, passages array<struct<first:int,last:int,score:double,expected:double>>")
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan_texts(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return found.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", "predicted", "passages")
