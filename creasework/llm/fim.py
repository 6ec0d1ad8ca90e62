"""Operator 12: fill-in-middle transformation by overlapping chunks.

A text's units are a run of white space with the word after it (``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+``) or white space
at the end. A unit ends where a character that is no white space stands beside one that is, or where the text ends, so
two adjacent characters tell, and a text may be counted in chunks that overlap by one character: each chunk counts its
own ends, prefix sums of the counts say which chunk holds the unit a cut comes after, and only that chunk is scanned
again for the place. White space is ASCII, so bytes of UTF-8 serve as characters; nothing but the two cuts leaves the
Python worker, and prefix, middle and suffix are cut and put together by column expressions.

The form is ``plain`` where the text is empty or holds a mark already or where the draw says so, else ``spm`` or ``psm``.
Null texts are empty; a null id draws as the empty string. Repeated rows give the same row each; an empty table gives an
empty result. Columns that are kept may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creasework.llm.common import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Characters (bytes) of a chunk.
CHUNK = 1 << 16
_WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _ends(part: np.ndarray) -> np.ndarray:
    """Whether a unit ends at each byte but the last, which only tells what follows."""
    white = _WHITE[part]
    return ~white[:-1] & white[1:]


class Units:
    """The units of one text in chunks of bytes that overlap by one."""

    def __init__(self, data: np.ndarray, chunk: int = CHUNK):
        self.data, self.chunk = data, chunk
        counts = [np.count_nonzero(_ends(data[a : a + chunk + 1])) for a in range(0, len(data), chunk)]
        #: Units that end up to the end of each chunk; the text's end closes one more.
        self.upto = np.cumsum(counts, dtype=np.int64)
        self.n = int(self.upto[-1]) + 1 if counts else 0

    def end_of(self, rank: int) -> int:
        """The byte after the first rank units."""
        if rank in (0, self.n):
            return len(self.data) if rank else 0
        k = int(np.searchsorted(self.upto, rank))
        inside = rank - (int(self.upto[k - 1]) if k else 0)
        a = k * self.chunk
        return a + int(np.flatnonzero(_ends(self.data[a : a + self.chunk + 1]))[inside - 1]) + 1


def _characters(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def cuts(chunk: int = CHUNK):
    """An Arrow function (text, two draws) -> (n, a, b): units, and characters before the middle and before the suffix.

    Cuts come after draw mod (n + 1) units, the smaller first; without draws only n is told.
    """

    def run(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        out: list[list] = [[], [], []]
        for text, x, y in zip(texts, first.to_pylist(), second.to_pylist(), strict=True):
            data = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid and len(text.as_buffer()) else np.zeros(0, np.uint8)
            units = Units(data, chunk)
            a = b = None
            if x is not None and y is not None:
                low, high = sorted((x % (units.n + 1), y % (units.n + 1)))
                at, to = units.end_of(low), units.end_of(high)
                a = _characters(data[:at])
                b = a + _characters(data[at:to])
            for column, v in zip(out, (units.n, a, b), strict=True):
                column.append(v)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in out], names=["n", "a", "b"])

    return F.arrow_udf(run, "n long, a long, b long")


def draws(key: Column, seed: int = 42) -> list[Column]:
    """The first four 8-digit groups of the hex sha256 of ``seed:key``, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text", rate: int = 50, spm: int = 80, seed: int = 42, chunk: int = CHUNK) -> DataFrame:
    """The kept columns, n, form, prefix_chars, middle_chars (null if plain) and output. rate: texts of a hundred that are
    transformed; spm: of a hundred of those, how many begin with their suffix."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(F.struct(*keep).alias("kept"), t.alias("t"), F.array(*draws(F.col(key), seed)).alias("h"))
    marked = F.col("t").contains(PREFIX) | F.col("t").contains(SUFFIX) | F.col("t").contains(MIDDLE)
    form = F.when((F.col("t") == "") | marked | (F.col("h")[2] % 100 >= rate), "plain").when(F.col("h")[3] % 100 < spm, "spm").otherwise("psm")
    d = d.withColumn("form", form)
    cut = lambda i: F.when(F.col("form") != "plain", F.col("h")[i])
    d = d.withColumn("cut", cuts(chunk)("t", cut(0), cut(1)))
    a, b = F.col("cut.a").cast("int"), F.col("cut.b").cast("int")
    whole = F.col("t")
    prefix, middle, suffix = whole.substr(F.lit(1), a), whole.substr(a + 1, b - a), whole.substr(b + 1, F.length(whole))
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    output = F.when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(whole)
    return d.select("kept.*", F.col("cut.n").alias("n"), "form", F.col("cut.a").alias("prefix_chars"), (F.col("cut.b") - F.col("cut.a")).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that was transformed. It holds no mark, so the first of each kind is the one that was put in."""
    spm = form == "spm"
    inner = F.substring(output, len(PREFIX) + 1, 2**31 - 1)
    first = F.when(spm, F.substring_index(inner, PREFIX, 1)).otherwise(F.substring_index(inner, SUFFIX, 1))
    rest = inner.substr(F.length(first) + len(PREFIX) + 1, F.length(inner))
    second = F.substring_index(rest, MIDDLE, 1)
    middle = rest.substr(F.length(second) + len(MIDDLE) + 1, F.length(rest))
    return F.when(form == "plain", output).when(spm, F.concat(second, middle, first)).otherwise(F.concat(first, middle, second))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the output and of the text rebuilt from it, for every row."""
    done = transform(table(spark, sf_dir, "documents"), ["doc_id"])
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS s, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
h AS (SELECT doc_id, t, u, len(u) AS n, ('0x' || s[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || s[9:16])::BIGINT % (len(u) + 1) AS y,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || s[17:24])::BIGINT % 100 >= 50 THEN 'plain' WHEN ('0x' || s[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, coalesce(array_to_string(u[1:least(x, y)], ''), '') AS p, coalesce(array_to_string(u[least(x, y) + 1:greatest(x, y)], ''), '') AS m FROM h),
o AS (SELECT *, substr(t, length(p) + length(m) + 1) AS q FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || q || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || q || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM o"""
