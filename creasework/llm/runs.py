"""Operator 11: all runs (maximal periodic stretches) of words, by longest previous factors.

The words of many texts are numbered text by text, each text closed by a number of its own, and handled at once as
arrays. Suffixes are sorted by prefix doubling; the classes of each doubling are kept, so the longest common extension
of any two places, to the right or to the left, takes a step for each doubling. From the suffix array, the nearest
earlier places on either side of a suffix and their common prefixes give the longest previous factor (LPF) of each
place, and jumps over these give the blocks of the Lempel-Ziv factorisation. A run either touches a block's border or
lies inside a block:

* at each border Main's extensions of all periods that fit the two blocks beside it find the runs that touch it;
* a run inside a block is a copy of one in the block's earlier occurrence; runs are kept in order of their starts, and
  each block, from left to right, copies those of its source.

A run that ends in block j has a start less than a period before block j-1, for else that block would have an earlier
occurrence longer than itself. So with exponent e or more its period is at most (length of both blocks) / (e - 1), and
the periods that are tried are as many as the words, but for a constant factor. A text of n words takes O(n log n) time
and memory; a batch holds texts of BATCH words, or one text.

Null and empty texts have no words and no runs. Repeated rows give a row each; an empty table gives an empty result.
Columns that are kept may have any names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creasework.llm.common import extended, slices, table

#: Words that are sorted at once, unless one text has more.
BATCH = 200_000


class Suffixes:
    """Sorted suffixes of texts that are joined, and the longest common extensions of any two places.

    ids numbers the words; each text has numbers of its own and ends with one that stands nowhere else.
    """

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        count = np.bincount(ids)
        start = np.cumsum(count) - count
        #: levels[k]: equal for two places whose 2**k words are equal; the last is each suffix's rank.
        self.levels = [start[ids].astype(np.int32)]
        self.group_start = self.levels[0]
        self.group_end = (start + count)[ids].astype(np.int32)
        order = np.argsort(ids, kind="stable")
        active, h = order[count[ids[order]] > 1], 1
        while len(active):
            rank = self.levels[-1]
            group = rank[active]
            key = group.astype(np.int64) * n + rank[active + h]
            by_key = np.argsort(key)
            active, key = active[by_key], key[by_key]
            at = np.arange(len(active))
            head, first = np.ones(len(active), bool), np.ones(len(active), bool)
            head[1:], first[1:] = key[1:] != key[:-1], group[1:] != group[:-1]
            finer = rank.copy()
            finer[active] = group + np.maximum.accumulate(np.where(head, at, 0)) - np.maximum.accumulate(np.where(first, at, 0))
            self.levels.append(finer)
            active = active[~(head & np.append(head[1:], True))]
            h *= 2
        self.order = np.empty(n, np.int32)
        self.order[self.levels[-1]] = np.arange(n, dtype=np.int32)

    def _extend(self, a: np.ndarray, b: np.ndarray, left: bool) -> np.ndarray:
        """Words by which a and b (which differ) agree: from there to the right, or up to there to the left."""
        got, failed, live, k = np.zeros(len(a), np.int64), np.zeros(len(a), np.int8), np.arange(len(a)), 0

        def equal(level: int, live: np.ndarray) -> np.ndarray:
            x, y = (v[live] - got[live] - (1 << level) + 1 if left else v[live] + got[live] for v in (a, b))
            same = self.levels[level][x] == self.levels[level][y]
            return same & (x >= 0) & (y >= 0) if left else same

        while len(live):  # the last level has no two equal places
            same = equal(k, live)
            failed[live[~same]] = k
            live = live[same]
            got[live] += 1 << k
            k += 1
        for level in range(k - 1, -1, -1):
            live = np.flatnonzero(failed > level)
            live = live[equal(level, live)]
            got[live] += 1 << level
        return got

    def to_right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._extend(a, b, False)

    def to_left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._extend(a, b, True)

    def _nearest_earlier(self, step: int) -> np.ndarray:
        """Per rank, the nearest rank before (step -1) or after it (1) whose suffix stands earlier in the text and begins
        with the same word; -1 where there is none. Ranks that can't be it are skipped with what they know themselves."""
        place, n = self.order, len(self.order)
        bound = self.group_start[place] - 1 if step < 0 else self.group_end[place]
        found = np.arange(n, dtype=np.int32) + np.int32(step)
        live = np.flatnonzero(found != bound)
        live = live[place[found[live]] > place[live]]
        for _ in range(12):
            if not len(live):
                break
            found[live] = found[found[live]]
            live = live[found[live] != bound[live]]
            live = live[place[found[live]] > place[live]]
        if len(live):
            self._search_blocks(found, live, bound, step)
        found[found == bound] = -1
        return found

    def _search_blocks(self, found: np.ndarray, live: np.ndarray, bound: np.ndarray, step: int) -> None:
        """The same for the few that wait for long chains: by minima over 2**k ranks, larger ones first."""
        least, n = [self.order], len(self.order)
        while (1 << len(least)) < n:
            w, m = 1 << (len(least) - 1), least[-1].copy()
            if step < 0:
                m[w:] = np.minimum(m[w:], least[-1][:-w])
            else:
                m[:-w] = np.minimum(m[:-w], least[-1][w:])
            least.append(m)
        for k in range(len(least) - 1, -1, -1):
            room = (found[live] - bound[live]) * -step >= 1 << k
            some = live[room]
            over = some[least[k][found[some]] > self.order[some]]
            found[over] += step << k

    def previous_factors(self) -> tuple[np.ndarray, np.ndarray]:
        """Per place: the length of the longest factor that also begins earlier (LPF), and where it does (-1: nowhere)."""
        n = len(self.order)
        length, source = np.zeros(n, np.int32), np.full(n, -1, np.int32)
        for step in (-1, 1):
            near = self._nearest_earlier(step)
            ranks = np.flatnonzero(near >= 0)
            here, there = self.order[ranks].astype(np.int64), self.order[near[ranks]].astype(np.int64)
            common = self.to_right(here, there).astype(np.int32)
            better = common > length[here]
            length[here[better]], source[here[better]] = common[better], there[better]
        return length, source


def blocks(lpf: list[int], start: int, end: int) -> list[int]:
    """Starts of the Lempel-Ziv blocks of the text in [start, end), and the end."""
    out, at = [], start
    while at < end:
        out.append(at)
        at += lpf[at] or 1
    out.append(end)
    return out


def _at_borders(s: Suffixes, cuts: list[np.ndarray], ends: list[tuple[int, int]], length: int, exponent: float) -> np.ndarray:
    """(start, length, period) of all long enough runs that touch a block's border."""
    border = np.concatenate(cuts)
    low, high = (np.concatenate([np.full(len(c), e[i], np.int64) for c, e in zip(cuts, ends, strict=True)]) for i in (0, 1))
    before = np.concatenate([np.diff(c, prepend=c[0]) for c in cuts])
    after = np.concatenate([np.diff(c, append=c[-1]) for c in cuts])
    periods = ((before + after) / (exponent - 1)).astype(np.int64)
    which = np.repeat(np.arange(len(border)), periods)
    p = np.arange(len(which)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    at, low, high, x = border[which], low[which], high[which], s.levels[0]
    found = []
    for right in (True, False):  # the longer half of a run lies right of the border, or left of it
        a = at if right else at - p - 1
        some = np.flatnonzero(a + p < high if right else a >= low)
        if exponent > 2:
            some = some[x[a[some]] == x[a[some] + p[some]]]
        a, q = a[some], p[some]
        a, b = (a, a + q) if right else (a + 1, a + q + 1)
        more, less = s.to_right(a, b), np.zeros(len(a), np.int64)
        inside = np.flatnonzero(a > 0)
        less[inside] = s.to_left(a[inside] - 1, b[inside] - 1)
        found.append(np.stack([a - less, less + more + q, q], 1))
    got = np.concatenate(found)
    return got[(got[:, 1] >= length) & (got[:, 1] >= exponent * got[:, 2])]


def runs(texts: list[list], length: int = 2, exponent: float = 2) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each list of words, in that order, with their smallest period.

    length, exponent: of what length, and of how many periods (2 or more), runs are.
    """
    ids, ends, n = [], [], 0
    for words in texts:
        own: dict = {}
        begin = len(ids)
        ids += [own.setdefault(w, n + len(own)) for w in words]
        n += len(own)
        ends.append((begin, len(ids)))
        ids.append(n)
        n += 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not any(texts):
        return out
    s = Suffixes(np.array(ids, np.int64))
    lpf, source = s.previous_factors()
    lengths = lpf.tolist()
    cuts = [np.array(blocks(lengths, *e), np.int64) for e in ends]
    some = [i for i, words in enumerate(texts) if words]
    smallest: dict[tuple[int, int], int] = {}
    for start, size, period in _at_borders(s, [cuts[i] for i in some], [ends[i] for i in some], length, exponent).tolist():
        smallest[start, size] = min(period, smallest.get((start, size), period))
    firsts, by_text = [e[0] for e in ends], {}
    for (start, size), period in smallest.items():
        by_text.setdefault(bisect_right(firsts, start) - 1, []).append((start, size, period))
    for i, found in by_text.items():
        found.sort()
        begin, cut = ends[i][0], cuts[i]
        for k in np.flatnonzero(np.diff(cut) > length + 1).tolist():
            a, e = int(cut[k]), int(cut[k + 1])
            shift = a - int(source[a])
            at = bisect_right(found, (a - shift, len(ids), 0))
            while at < len(found) and found[at][0] < e - shift:
                start, size, period = found[at]
                if start + shift + size < e:  # the words beside it are copied as well
                    insort(found, (start + shift, size, period))
                at += 1
        out[i] = [(start - begin, size, period) for start, size, period in found]
    return out


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    if not found:
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    for start, size, period in found:
        steps[start + period] += 1
        steps[start + size] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]


def scan(docs: DataFrame, keep: list[str], text: str = "text", length: int = 6, exponent: float = 4, prepare: Callable[[object, list[bytes]], list[bytes]] | None = None, key: str = "doc_id") -> DataFrame:
    """The kept columns, runs (array of start, length, period) and collapsed: the text without what runs repeat.

    prepare: changes the words of a text (its key, words) before they are searched.
    """
    rows = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def told(batch: pa.RecordBatch, at: int, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = runs(texts, length, exponent)
        flat = np.array([r for f in found for r in f], np.int64).reshape(-1, 3)
        offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(rows)))
        texts_ = pa.array([b" ".join(collapsed(w, f)).decode() for w, f in zip(texts, found, strict=True)], pa.string())
        own = batch.slice(at, len(texts))
        return pa.RecordBatch.from_arrays([*own.columns[2:], lists, texts_], names=[str(i) for i in range(len(keep) + 2)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, held, at = [], 0, 0
            for i, (k, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1), strict=True)):
                words = t.as_buffer().to_pybytes().split() if t.is_valid else []
                words = prepare(k, words) if prepare else words
                if held and held + len(words) > BATCH:
                    yield told(b, at, texts)
                    texts, held, at = [], 0, i
                texts.append(words)
                held += len(words)
            if texts:
                yield told(b, at, texts)

    fields = "runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *keep).mapInArrow(run, extended(docs, keep, fields))


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's change of texts: where crc32 of the id is a multiple of ten, the words from one on repeat."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 6 words and 4 periods or more. The longest: of equally long ones the first, then of the smallest period."""
    found = scan(table(spark, sf_dir, "documents"), ["doc_id"], prepare=repeated_tail)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    d = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return d.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(length * 1000 / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


SQL = r"""WITH tab AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS h FROM documents, tab),
e AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS rep, (h // 10) % greatest(len(w), 1) AS a, (h // 10) % 8 AS k FROM d),
f AS (SELECT doc_id, n, w, rep, a, 1 + (n - a) // (3 + k) AS p FROM e),
x AS (SELECT doc_id, i, w[1 + CASE WHEN rep AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM f)),
q AS (SELECT l.doc_id, l.i, r.i - l.i AS p FROM x l JOIN x r ON l.doc_id = r.doc_id AND l.word = r.word AND r.i > l.i),
s AS (SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM q) GROUP BY doc_id, p, island),
r AS (SELECT doc_id, start, length, min(p) AS p FROM s WHERE length >= greatest(6, 4 * p) GROUP BY 1, 2, 3),
b AS (SELECT doc_id, count(*) AS n_runs, arg_min((start, length, p), (-length, start, p)) AS m, string_agg(start || ',' || length || ',' || p || chr(10), '' ORDER BY start, p) AS lines FROM r GROUP BY 1),
g AS (SELECT DISTINCT doc_id, unnest(range(start + p, start + length)) AS i FROM r),
c AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN g USING (doc_id, i) GROUP BY 1)
SELECT f.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, m[1]::BIGINT AS start, m[2]::BIGINT AS length, m[3]::BIGINT AS period, (m[2] * 1000 // m[3])::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM f LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)"""
