"""Operator 10: licence notices by exact phrases and fuzzy short-notice search.

Words are runs of digits, letters and non-ASCII characters, with A-Z lower-cased. Base places are those where a
phrase's words stand consecutively. The fuzzy search finds notices with a few edits: a notice with at most e errors is
cut in e + 1 pieces, one of which must stand in the text unchanged (pigeonhole); all pieces are searched at once by an
Aho-Corasick automaton, and around each place the regex library matches the whole notice with at most e errors. A fuzzy
match counts if it begins and ends at words and has the words that tell licences apart (mit, bsd, apache ..) in their
places with one edit at most; numbers of clauses must stand there unedited, short names in a notice of two words ("mit
license") as words. A match reports its span and edits. "All rights reserved" alone is no licence: its label is ``reserved``, at half the score.

Null and empty texts have no words, no places and score 0. Repeated rows and null ids give a row each; an empty table
gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creasework.llm.common import extended, slices, table

#: Base phrases and their labels. Fixed by contract.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices of the fuzzy search: words, label, errors allowed. Shorter ones must stand exactly.
NOTICES = [
    ("mit license", "mit", 1),
    ("released under the mit license", "mit", 2),
    ("apache license", "apache", 1),
    ("licensed under the apache license version 2 0", "apache", 3),
    ("general public license", "gpl", 2),
    ("gnu general public license", "gpl", 3),
    ("permission is hereby granted free of charge to any person", "mit", 4),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("bsd 3 clause license", "bsd", 1),
    ("bsd 2 clause license", "bsd", 1),
    ("mozilla public license", "mpl", 2),
    ("creative commons attribution", "cc", 2),
    ("licensed under cc by", "cc", 1),
    ("all rights reserved", "reserved", 1),
    ("spdx license identifier", "spdx", 2),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("eclipse public license", "epl", 2),
    ("boost software license", "bsl", 2),
    ("artistic license", "artistic", 1),
    ("creative commons zero", "cc0", 1),
    ("this is free and unencumbered software released into the public domain", "unlicense", 5),
]
#: Words that tell licences apart; the number of a version doesn't.
TELLING = frozenset("mit bsd cc by 2 3 apache lesser affero zero".split())
#: Labels that tell of no licence.
WEAK = frozenset(["reserved"])
#: Every byte outside words becomes a space; A-Z becomes a-z; other bytes stay.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def plain_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split(b" ") if text else []


def _cut(notice: str, parts: int) -> list[tuple[int, str]]:
    """The notice in as many pieces of nearly equal length, with their offsets."""
    at = [round(i * len(notice) / parts) for i in range(parts + 1)]
    return [(a, notice[a:b]) for a, b in zip(at, at[1:], strict=False)]


def telling_words(notice: str) -> tuple[frozenset[str], list[tuple[int, str]]]:
    """The telling words of a notice: those that must stand as words, and those that only count in their places: numbers
    unedited, others with an edit at most."""
    words = notice.partition(" version ")[0].split(" ")
    starts = accumulate((len(w) + 1 for w in words), initial=0)
    told = [(at, w) for at, w in zip(starts, words, strict=False) if w in TELLING]
    firm = frozenset(w for _, w in told if len(words) == 2 and len(w) < 4)
    return firm, [(at, w) for at, w in told if w not in firm]


@lru_cache(1)
def _search():
    """The automaton over all seeds, the notices' fuzzy patterns and those of their telling words; built once in each
    worker."""
    import ahocorasick
    import regex

    seeds: dict[str, list[tuple[int, int]]] = {}
    for i, (notice, _, errors) in enumerate(NOTICES):
        for offset, seed in _cut(notice, errors + 1):
            seeds.setdefault(seed, []).append((i, offset))
    automaton = ahocorasick.Automaton()
    for seed, uses in seeds.items():
        automaton.add_word(seed, (len(seed), uses))
    automaton.make_automaton()
    telling = [(firm, [(at, len(w), regex.compile(rf"(?<![0-9]){w}(?![0-9])" if w.isdigit() else rf"(?:{w}){{e<=1}}")) for at, w in loose]) for firm, loose in (telling_words(n) for n, _, _ in NOTICES)]
    return automaton, telling, [regex.compile(rf"(?b)(?:(?<![^ ]){regex.escape(n)}(?![^ ])){{e<={e}}}") for n, _, e in NOTICES]


def fuzzy_notices(line: str) -> list[tuple[str, int, int, int]]:
    """(label, first character, character after the last, edits) of notices in words joined by single spaces."""
    automaton, telling, patterns = _search()
    windows: dict[int, list[list[int]]] = {}
    for end, (size, uses) in automaton.iter(line):
        for i, offset in uses:
            notice, _, errors = NOTICES[i]
            begin = end + 1 - size - offset
            a, b = max(0, begin - errors), min(len(line), begin + len(notice) + errors)
            spans = windows.setdefault(i, [])
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(b, spans[-1][1])
            else:
                spans.append([a, b])
    found = []
    for i, spans in windows.items():
        notice, label, errors = NOTICES[i]
        firm, loose = telling[i]
        for a, b in spans:
            for m in patterns[i].finditer(line, max(0, a), b):
                s, e = m.span()
                whole = (s == 0 or line[s - 1] == " ") and (e == len(line) or line[e] == " ") and s < e
                if not whole or not firm <= set(line[s:e].split()):
                    continue
                if all(p.search(line, max(s, s + at - errors), min(e, s + at + size + errors)) for at, size, p in loose):
                    found.append((label, s, e, sum(m.fuzzy_counts)))
    return found


def number_of(lengths: list[int], places: list[int]) -> list[int]:
    """The number of the word at each place of a line, words of these lengths being joined by single spaces."""
    starts = list(accumulate((n + 1 for n in lengths), initial=0))
    return [bisect_right(starts, p) - 1 for p in places]


def word_numbers(words: list[bytes], places: list[int]) -> list[int]:
    return number_of(list(map(len, words)), places) if places else []


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns, base places, labels, score and the fuzzy matches (label, first_word, last_word, edits)."""
    base = [(f" {p} ".encode(), len(p.split()), label) for p, label in PHRASES.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
        for b in slices(batches):
            out: list[list] = [[] for _ in names]
            for text in b.column("_text").to_pylist():
                words = [w for w in plain_words(text) if w]
                line = b" " + b" ".join(words) + b" "
                found, base_labels = [], set()
                for phrase, _, label in base:
                    at = line.find(phrase)
                    while at >= 0:
                        found.append(at)
                        base_labels.add(label)
                        at = line.find(phrase, at + 1)
                places = word_numbers(words, found)
                near = []
                if words:
                    plain = line[1:-1].decode("utf-8", "surrogatepass")
                    spans = fuzzy_notices(plain)
                    starts = [len(w.decode("utf-8", "surrogatepass")) for w in words] if spans else []
                    first, last = (number_of(starts, [m[k] - (k == 2) for m in spans]) for k in (1, 2))
                    near = [(m[0], a, e, m[3]) for m, a, e in zip(spans, first, last, strict=True)]
                labels = base_labels | {m[0] for m in near}
                score = 1.0 if base_labels else max((1 / (1 + 0.25 * m[3]) * (0.5 if m[0] in WEAK else 1.0) for m in near), default=0.0)
                matches = [{"label": m[0], "first_word": m[1], "last_word": m[2], "edits": m[3]} for m in sorted(set(near), key=lambda m: m[1:])]
                row = (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, matches)
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("edits", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names=[*keep, *names])

    added = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,first_word:int,last_word:int,edits:int>>"
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, extended(docs, keep, added))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), ["doc_id"])

