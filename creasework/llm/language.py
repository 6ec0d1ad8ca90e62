"""Operator 5: language identification by mixtures of languages.

A text is a mixture of languages: each of its letter trigrams comes from one of them. Expectation-maximisation finds
the proportions from the trigrams' likelihoods; the set of languages is the one with the best penalised likelihood
(half a log of the effective number of trigrams for each language). The prediction is the language with the largest
proportion, ties going to the first in order; the score is that proportion, shrunk for short texts.

The trigram model is fitted on a sample of labelled texts, about SAMPLE for each language, taken by a hash of doc_id
among the rows that are not held out (all rows of an id go together). Null texts and texts without letters are ``und`` with score 0. Repeated rows and
null ids give a row each; an empty table gives an empty result. Without labelled rows all texts are ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creasework.llm.common import bounded_sample, extended, fold, slices, table

#: Labelled texts of a language that the model is fitted on, about (chosen by hash, whole texts).
SAMPLE = 1500
#: Cells that trigrams are hashed to.
CELLS = 1 << 15
#: A trigram shares two letters with the next one; likelihoods count as those of a third as many.
OVERLAP = 3
_LETTER = np.array([chr(i).isalpha() for i in range(0x10000)])


def trigram_cells(text: str) -> np.ndarray:
    """Cells of the trigrams of letters; other characters count as one space. Empty if there is no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[np.minimum(codes, 0xFFFF)]
    beyond = codes > 0xFFFF
    if beyond.any():
        high = codes[beyond]
        letter[beyond] = np.isin(high, [c for c in np.unique(high).tolist() if chr(c).isalpha()])
    if not letter.any():
        return np.empty(0, np.int64)
    codes = np.where(letter, codes, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.concatenate((np.array([32], np.uint32), codes[keep], np.array([32], np.uint32)))
    mixed = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA6B)) ^ (c[2:] * np.uint32(0xC2B2AE35))
    return ((mixed ^ (mixed >> np.uint32(15))) % np.uint32(CELLS)).astype(np.int64)


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihoods of each cell in each language) from documents that are not held out."""
    rows = docs.where((fold() != 1) & F.col("lang").isNotNull())  # a null id is never held out, nor learned from
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((CELLS, 0), np.float32)
    place = {x: i for i, x in enumerate(langs)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((len(place), CELLS), np.int64)
        for p in batches:
            for lang, text in zip(p["lang"], p["text"], strict=True):
                np.add.at(seen[place[lang]], trigram_cells(text or ""), 1)
        where = np.nonzero(seen)
        yield pd.DataFrame({"lang": where[0], "cell": where[1], "n": seen[where]})

    chosen = bounded_sample(rows, sample, "lang", counts).select("lang", "text")
    found = chosen.mapInPandas(count, "lang int, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    seen = np.full((CELLS, len(langs)), 0.1)
    seen[found["cell"], found["lang"]] += found["n"]
    return langs, np.log(seen / seen.sum(axis=0)).astype(np.float32)


#: Proportions that differ by less are equal, so that sums in another order (another processor) decide nothing.
TIE = 1e-6


def mixture(odds: np.ndarray, times: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, float]:
    """(proportions, log-likelihood) by expectation-maximisation; odds[i, l]: likelihood of trigram i, which stands
    times[i] times, in language l."""
    share = np.full(odds.shape[1], 1 / odds.shape[1], odds.dtype)
    total = times.sum()
    for _ in range(rounds):
        new = share * (odds.T @ (times / (odds @ share))) / total
        done = np.abs(new - share).max() < 1e-3
        share = new
        if done:
            break
    return share, float(times @ np.log(odds @ share))


def languages_of(cells: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(languages, proportions): the set with the best penalised likelihood, found by leaving out the least.

    Equal trigrams count together, so memory is bounded by CELLS however long a text is.
    """
    kinds, times = np.unique(cells, return_counts=True)
    own = logs[kinds]
    odds = np.exp(own - own.max(axis=1, keepdims=True)) + np.float32(1e-6)
    times = times.astype(np.float64)
    chosen = np.arange(logs.shape[1])
    share, fit_ = mixture(odds, times)
    penalty = 0.5 * np.log(len(cells) / OVERLAP + 1)
    while len(chosen) > 1:
        rest = np.arange(len(chosen)) != np.flatnonzero(share <= share.min() + TIE)[-1]
        fewer, fewer_fit = mixture(odds[:, chosen[rest]], times)
        if (fit_ - fewer_fit) / OVERLAP > penalty:
            break
        chosen, share, fit_ = chosen[rest], fewer, fewer_fit
    return chosen, share


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns, lang_pred, score and the proportions of each row's languages."""
    langs, logs = model
    names = np.array(langs, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            best, score, mix = [], [], []
            for t in b.column("_text").to_pylist():
                cells = trigram_cells(t) if t and langs else ()
                if not len(cells):
                    best.append("und"), score.append(0.0), mix.append([])
                    continue
                chosen, share = languages_of(cells, logs)
                top = int(np.flatnonzero(share >= share.max() - TIE)[0])
                n = len(cells) / OVERLAP
                best.append(names[chosen[top]])
                score.append(float(min(1.0, (n * share[top] + 1) / (n + len(langs)))))
                mix.append([{"lang": names[c], "share": float(s)} for c, s in zip(chosen, share, strict=True)])
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(mix, kind)], names=[*keep, "lang_pred", "score", "mixture"])

    schema = extended(docs, keep, "lang_pred string, score double, mixture array<struct<lang:string,share:double>>")
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs), ["doc_id"])
    return found.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "mixture")
