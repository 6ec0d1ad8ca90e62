"""Operator 4: best-fit-decreasing packing of tokenised documents into sequences of a fixed capacity.

Tokens are counted on the executors. The pieces of one length are alike, so best fit decreasing needs only how many
there are of each length: a table of ``capacity`` rows, whatever the corpus holds. Lengths are placed in descending
order; a segment tree over remaining capacities finds the tightest open sequence that still fits in logarithmic time,
and a whole run of equal pieces goes to equal sequences in one step. The result is a plan of runs (length, first rank,
sequence, offset) that is exactly what placing piece by piece gives. Each piece then finds its run by its length and
its rank among the pieces of that length.

Null and empty texts have one token, the end mark. Repeated rows and null ids are packed like any other row. Texts
longer than the capacity are cut into full pieces and a rest. An empty table gives an empty result.
"""

from __future__ import annotations

import array
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creasework.llm.common import ranked, settle, slices, table

CAPACITY = 4096
END = 1

# --- tokens ------------------------------------------------------------------------------------------------------


#: The byte-level alphabet: bytes without a printable sign of their own are shifted to 256 and on, in order.
_BYTE_LEVEL = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


class WordTokens:
    """Ids of a lower-casing word-level BPE, as little-endian unsigned 32-bit integers.

    White space separates words and no merge crosses a piece of a word (a run of letters, a digit, a run of other
    signs), so ids are looked up word by word; the tokenizer's merges are only asked for pieces that are not
    remembered. Characters beyond the Latin blocks go to the tokenizer as whole texts, because their case and
    composition may depend on their neighbours; so do texts with special tokens.
    """

    #: Bytes of remembered words and pieces at most. When half of them are full, the older half goes; what is met again
    #: moves to the newer one first, so that frequent words stay.
    MEMORY = 96_000_000
    PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
    #: Where Python and the tokenizer agree on letters, digits, white space and lower case.
    SIMPLE = re.compile(r"[\n\t\r\x0b\x0c\x20-\x84\x86-\xa9\xab-\xb1\xb4-\xb8\xbb\xbf-įı-ſ]*")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.bytes = 0

    def _keep(self, piece: str, ids: bytes) -> None:
        if len(piece) < 64:
            self.known[piece] = ids
            self.bytes += 200 + len(ids)

    def _piece(self, piece: str) -> bytes:
        signs = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(_BYTE_LEVEL)
        return array.array("I", [t.id for t in self.tokenize(signs)]).tobytes()

    def _learn(self, word: str) -> bytes:
        """The ids of a word that isn't in the newer memory. Its pieces are remembered; a word of several pieces, or with
        capitals, only when they were known before, as most words are met once."""
        older = self.older
        ids = older.get(word)
        if ids is not None:
            self._keep(word, ids)
            return ids
        low, known, fresh = word.lower(), self.known, False
        found = []
        for p in (low,) if low.isalpha() else self.PIECE.findall(low):
            ids = known.get(p)
            if ids is None:
                ids = older.get(p)
                if ids is None:
                    ids, fresh = self._piece(p), True
                self._keep(p, ids)
            found.append(ids)
        ids = found[0] if len(found) == 1 else b"".join(found)
        if not fresh and word not in known:
            self._keep(word, ids)
        return ids

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" in text or not self.SIMPLE.fullmatch(text):
            return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if 2 * self.bytes > self.MEMORY:
            self.known, self.older, self.bytes = {}, self.known, 0
        words = text.split()
        got = list(map(self.known.get, words))
        try:
            return b"".join(got)
        except TypeError:  # some are not remembered
            learn = self._learn
            return b"".join([learn(w) if g is None else g for w, g in zip(words, got, strict=True)])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32): the token pieces of each row; row numbers the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end, step = WordTokens(tokenizer), array.array("I", [END]).tobytes(), 4 * capacity
        for batch in slices(batches, 1024):
            docs_, rows, texts = (batch.column(i).to_pylist() for i in range(3))
            out: list[list] = [[] for _ in range(6)]
            for doc, row, text in zip(docs_, rows, texts, strict=True):
                ids = tokens.ids(text) + end
                for k, a in enumerate(range(0, len(ids), step)):
                    part = ids[a : a + step]
                    for column, x in zip(out, (doc, row, k, k * capacity, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(run, "doc_id long, row long, piece int, start long, length long, ids_crc32 long")


# --- plan --------------------------------------------------------------------------------------------------------


class RemainingTree:
    """Segment tree over remaining capacities: which values have open sequences, and the least of them from r on."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)

    def set(self, r: int, here: bool) -> None:
        i = r + self.size
        self.any[i] = here
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, r: int) -> int | None:
        i = r + self.size
        if self.any[i]:
            return r
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first sequence, pieces a sequence takes, offset) of best fit decreasing.

    Piece number rank + i of a run goes to sequence + i // pieces, at offset + i % pieces * length. Sequences with equal
    room are kept as intervals, so a step costs the same for one piece and for a billion.
    """
    tree, open_, plan, used = RemainingTree(capacity), defaultdict(list), [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if not open_[room]:
                tree.set(room, True)
            open_[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                each = capacity // length
                first, n, room = used, -(-left // each), capacity
                used += n
            else:
                each = room // length
                first, n = open_[room].pop()
                if not open_[room]:
                    tree.set(room, False)
            full = min(n, left // each)
            if full:
                plan.append((length, rank, first, each, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:  # fewer than each are left: one more sequence takes them
                plan.append((length, rank, first + full, each, capacity - room))
                put(room - left * length, first + full, 1)
                full, left = full + 1, 0
            if full < n:
                put(room, first + full, n - full)
    return plan


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Settled pieces with sequence_id and offset. What reaches the driver: one count for each length up to capacity."""
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = np.array(best_fit_plan(counts, capacity), np.int64).reshape(-1, 5)
    span = max(counts.values(), default=0) + 1
    starts = plan[:, 0] * span + plan[:, 1]
    order = np.argsort(starts)
    plan, starts = plan[order], starts[order]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            run = plan[np.searchsorted(starts, p["length"].to_numpy() * span + p["rank"].to_numpy(), "right") - 1]
            at = p["rank"].to_numpy() - run[:, 1]
            yield p.drop(columns="rank").assign(sequence_id=run[:, 2] + at // run[:, 3], offset=run[:, 4] + at % run[:, 3] * run[:, 0])

    # pieces of one length go by rank; any numbering of them is as good, as they are equally long
    by_length = ranked(cut, ["length"], ["row", "piece"], "rank", sum(counts.values()))
    kinds = dict(cut.dtypes)
    columns = [c for c in by_length.columns if c != "rank"]
    return by_length.mapInPandas(place, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    return packed(settle(pieces(docs, tokenizer, capacity), "pieces"), capacity)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(table(spark, sf_dir, "documents"), default_tokenizer())
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
