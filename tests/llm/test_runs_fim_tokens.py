"""Operators 11 to 13: runs, fill-in-middle, files of token ids."""

import hashlib
import io
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from creasework.llm import fim, queries, runs, tokens
from creasework.sources.shared import checkpoint_dir

SF = "/root/testdata/sf0.001"
EXTRA = [(1, "a b a b a b a b x", "n"), (1, "a b a b a b a b x", "n"), (2, None, "n"), (None, "  lead  trail \n", "n"), (3, "", "n"), (4, "z " * 50_000, "n"), (5, "\t\n ", "n"), (6, "no <S> here", "n")]


def brute_runs(w, length, exponent):
    out = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            size = j - i + p
            if size >= max(2 * p, length, exponent * p):
                out.setdefault((i, size), p)
            i = j + 1
    return sorted((a, n, p) for (a, n), p in out.items())


def made_texts(draw):
    k, texts = draw.choice([1, 2, 3, 5]), []
    for _ in range(draw.randint(0, 5)):
        w = [draw.randrange(k) for _ in range(draw.randint(0, 30))]
        for _ in range(draw.randint(0, 3)):
            a = draw.randrange(len(w) or 1)
            b = draw.randint(a, len(w))
            w = (w[:b] + w[a:b] * draw.randint(1, 4) + w[b:])[:140]
        texts.append(w)
    return texts


@pytest.mark.parametrize(("length", "exponent"), [(2, 2), (3, 2.5), (6, 4)])
def test_runs_against_brute_force(length, exponent):
    draw = random.Random(length)
    for _ in range(250):
        texts = made_texts(draw)
        assert runs.runs(texts, length, exponent) == [brute_runs(w, length, exponent) for w in texts], texts
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 600:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    up = [c for i in range(60) for c in ("x", *range(i))]  # long chains of earlier places
    assert runs.runs([list(fibonacci[-1]), up, up[::-1]], length, exponent) == [brute_runs(w, length, exponent) for w in (list(fibonacci[-1]), up, up[::-1])]


def test_nearest_earlier_places_by_blocks_equal_plain_search():
    draw = random.Random(4)
    for _ in range(60):
        ids = np.array([draw.randrange(3) for _ in range(draw.randint(1, 80))] + [3])
        s = runs.Suffixes(ids)
        assert [tuple(ids[i:]) for i in s.order] == sorted(tuple(ids[i:]) for i in range(len(ids)))
        for step in (-1, 1):
            near = s._nearest_earlier(step)
            place = s.order[:]
            bound = s.group_start[place] - 1 if step < 0 else s.group_end[place]
            blocks = np.arange(len(place), dtype=np.int32) + np.int32(step)
            s._search_blocks(blocks, np.arange(len(place)), bound, step)
            for r in range(len(place)):
                want = next((q for q in range(r + step, int(bound[r]), step) if place[q] < place[r]), -1)
                assert near[r] == want and (blocks[r] if blocks[r] != bound[r] else -1) == want


def test_longest_previous_factors():
    draw = random.Random(9)
    for _ in range(60):
        w = [draw.randrange(2) for _ in range(draw.randint(1, 40))]
        length, source = runs.Suffixes(np.array([*w, 2])).previous_factors()
        for i in range(len(w)):
            common = lambda j: next((k for k in range(len(w) - i) if w[j + k] != w[i + k]), len(w) - i)  # noqa: B023, E731
            assert length[i] == max((common(j) for j in range(i)), default=0)
            assert length[i] == 0 or (source[i] < i and common(source[i]) >= length[i])


def test_runs_of_rows(spark):
    got = runs.scan(spark.createDataFrame(EXTRA, "doc_id long, text string, runs string"), ["doc_id", "runs"]).collect()
    assert len(got) == len(EXTRA) and all(r[1] == "n" for r in got)
    by = {r[0]: r for r in got}
    assert [tuple(x) for x in by[1][2]] == [(0, 8, 2)] and by[1][3] == "a b x" and by[2][3] == "" and by[None][3] == "lead trail"
    assert [tuple(x) for x in by[4][2]] == [(0, 50_000, 1)] and by[4][3] == "z" and by[5][3] == ""
    assert runs.scan(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).count() == 0


def test_small_batches_of_words_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b " * i + "c") for i in range(20)], "doc_id long, text string")
    want = runs.scan(docs, ["doc_id"]).collect()
    monkeypatch.setattr(runs, "BATCH", 5)
    assert runs.scan(docs, ["doc_id"]).collect() == want


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def test_units_are_those_of_the_pattern_whatever_the_chunk():
    draw = random.Random(2)
    for _ in range(400):
        text = "".join(draw.choice("ab é日😀 \t\n\x0b") for _ in range(draw.randint(0, 40)))
        parts, data = UNIT.findall(text), np.frombuffer(text.encode(), np.uint8)
        for chunk in (1, 2, 3, 7, 1000):
            units = fim.Units(data, chunk)
            assert units.n == len(parts)
            assert [units.end_of(k) for k in range(units.n + 1)] == [len("".join(parts[:k]).encode()) for k in range(len(parts) + 1)]


def test_transform_cuts_where_draws_say_and_is_undone(spark):
    draw = random.Random(3)
    rows = [*EXTRA, *[(i, "".join(draw.choice(["wörd", " ", "\n", "日本", "x ", "<", "S>"]) for _ in range(draw.randint(0, 30))), "n") for i in range(10, 400)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string")
    for rate in (50, 100):
        done = fim.transform(docs, ["doc_id", "text", "form"], rate=rate, chunk=5)
        done = done.toDF("doc_id", "text", "own", "n", "form", "prefix_chars", "middle_chars", "output").withColumn("back", fim.restore(F.col("output"), F.col("form")))
        got = done.collect()
        assert len(got) == len(rows) and {r["form"] for r in got} == {"plain", "spm", "psm"}
        for r in got:
            text = r["text"] or ""
            parts = UNIT.findall(text)
            h = hashlib.sha256(f"42:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
            h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
            a, b = sorted(x % (len(parts) + 1) for x in h[:2])
            p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
            plain = not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate
            form = "plain" if plain else "spm" if h[3] % 100 < 80 else "psm"
            want = text if plain else f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
            assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"], r["own"]) == (len(parts), form, None if plain else len(p), None if plain else len(m), want, text, "n")
    assert fim.transform(docs.limit(0), ["doc_id"]).count() == 0


@pytest.fixture(scope="module")
def coder():
    return tokens.ByteTokens(tokens.default_tokenizer())


def test_units_of_bytes_have_the_ids_of_whole_texts(coder, monkeypatch):
    draw = random.Random(1)
    signs = ["a", "b", "'s", "'", " ", " ", "  ", "\n", "\t", "1", "é", "ß", ".", ",", "日", chr(0x3000), "\xa0", "\x1c", "\x85", "<|endoftext|>", "<|", "!", "😀", chr(0x301), "ſ", "\r\n", chr(0x200B), "\x1f", chr(0xFEFF), "'re", "_", "²", "ª", "\x00"]
    texts = [None, "", *("".join(draw.choice(signs) for _ in range(draw.randint(0, 14))) for _ in range(4000))]
    want = [coder._encode(t or "") for t in texts]
    for memory in (coder.MEMORY, 5000):  # the small one is forgotten again and again
        monkeypatch.setattr(coder, "MEMORY", memory)
        assert [ids for part in tokens.by_size(pa.array(texts, pa.string()), 333) for ids in coder.serialize(part)] == want
    assert [len(x) for x in tokens.by_size(pa.array(["aaaa", None, "b", "cccccccc", "d"]), 2, 5)] == [2, 1, 1, 1]


def wanted(coder, rows):
    out, start = [], 0
    for key, text in rows:
        ids = np.frombuffer(coder._encode(text or ""), coder.kind).astype("<u4")
        ids = np.append(ids, np.uint32(0))
        out.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        start += len(ids)
    return out


def test_files_are_read_back_in_order(spark, coder, monkeypatch):
    draw = random.Random(8)
    texts = {k: " ".join(draw.choice(["alpha", "beta", "gamma", "naïve", "日本"]) for _ in range(draw.randint(0, 60))) for k in range(300)}
    rows = [(k, texts[k]) for k in draw.sample(range(300), 300)] + [(None, "no id"), (None, "no id"), (7, None), (999, ""), (500, "long " * 30_000)]
    monkeypatch.setattr(tokens, "FILE_BYTES", 2000)
    folder = f"{checkpoint_dir(spark)}/files-of-ids"
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tokens.write(docs, folder, tokens.default_tokenizer())
    got = sorted((tuple(r) for r in tokens.read(spark, folder).collect()), key=lambda r: r[1])
    assert [(r[0] is not None, r[0] or 0) for r in got] == sorted((k is not None, k or 0) for k, _ in rows)  # null keys first
    by = {}
    for key, _, n, crc in wanted(coder, rows):
        by.setdefault(key, []).append((n, crc))
    found, start = {}, 0
    for key, at, n, crc in got:
        assert at == start
        start += n
        found.setdefault(key, []).append((n, crc))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in by.items()}
    ids = tokens.read(spark, folder, with_ids=True).where("doc_id = 999").first()["ids"]
    assert ids == [0]
    store, path = tokens._store(folder)
    names = [f.path for f in store.get_file_info(tokens.fs_selector(path)) if f.path.endswith(".ids")]
    assert len(names) > 3 and not [f.path for f in store.get_file_info(tokens.fs_selector(path)) if f.path.endswith(".tmp")]
    with store.open_input_stream(f"{path}/dictionary") as f:
        dictionary = f.read()
    assert dictionary
    places = 0
    for name in names:
        with store.open_input_file(name) as f:
            file = tokens.IdFile(f, dictionary)
            for r in file.index:
                if r["has_key"]:
                    places += len(file.of(int(r["key"])))
            assert file.of(-5) == []
        with store.open_input_file(name) as f, pytest.raises(ValueError, match="another dictionary"):
            tokens.IdFile(f, b"other")
    assert places >= 302


def test_few_or_no_documents_need_no_dictionary(spark, coder):
    for i, rows in enumerate(([], [(3, "x")])):
        folder = f"{checkpoint_dir(spark)}/few-ids-{i}"
        tokens.write(spark.createDataFrame(rows, "doc_id long, text string"), folder, tokens.default_tokenizer())
        assert [tuple(r) for r in tokens.read(spark, folder).collect()] == wanted(coder, rows)


def test_a_cut_file_is_refused():
    content = tokens.file_bytes([(1, 1, b"frame")], 0, 2, hashlib.sha256(b"").digest())
    tokens.IdFile(io.BytesIO(content), b"")
    with pytest.raises(ValueError, match="cut off"):
        tokens.IdFile(io.BytesIO(content[:-30] + bytes(30)), b"")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.SQL[name]).df()
    order = lambda d: d[sorted(d.columns)].astype(object).where(d.notna(), None).sort_values("doc_id").reset_index(drop=True).astype(str).replace(r"\.0$", "", regex=True)
    pd.testing.assert_frame_equal(order(got), order(want))


def test_token_query_equals_the_tokenizer(spark, coder):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = sorted(tuple(r) for r in queries.QUERIES["op13_token_files"](spark, SF).collect())
    assert got == wanted(coder, rows)
