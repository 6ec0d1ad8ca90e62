"""Nulls, empty tables, repeated rows, long texts and clashing names, for every operator."""

import pytest

from creasework.llm import decontaminate, html, language, licences, packing, sharding, simhash, sketches, toxicity, warc

EXTRA = "lang string, score double, bucket long, hash long, row long, uid long, size long, n long, w0 long, _text string, slot long, node long, rank long, matches string, toxic int, html string, url string, page_id long"
LONG = "word " * 60_000
ROWS = [(1, "mit license here", "aa"), (1, "mit license here", "aa"), (2, None, None), (3, "", "aa"), (None, "no id", "bb"), (4, LONG, "bb"), (5, LONG + "end", "bb"), (6, "\n\t ", "cc")]


def documents(spark, rows):
    names = [c.split()[0] for c in EXTRA.split(", ")]
    filled = [(i, t, lang, *[t if k in ("_text", "html", "url", "matches") else 0 if k == "toxic" else 0.5 if k == "score" else 7 for k in names[1:]]) for i, t, lang in rows]
    return spark.createDataFrame(filled, f"doc_id long, text string, {EXTRA}")


OPERATORS = {
    "decontaminate": lambda d: decontaminate.hits(d, d.selectExpr("doc_id as item_id", "text")),
    "sketches": lambda d: sketches.fingerprints(d),
    "html": lambda d: html.extract(d, ["doc_id", "url"]),
    "packing": lambda d: packing.pack(d, packing.default_tokenizer()).where("piece = 0"),
    "language": lambda d: language.identify(d, language.fit(d), ["doc_id"]),
    "toxicity": lambda d: toxicity.scan_texts(d, toxicity.fit(d, d.select("doc_id", "toxic")), ["doc_id"]),
    "simhash": lambda d: simhash.simhash_components(d),
    "warc": lambda d: warc.derivatives(warc.responses(d), ["page_id"]).where("warc_type = 'metadata'"),
    "sharding": lambda d: sharding.shards_by_bytes(d),
    "licences": lambda d: licences.scan(d, ["doc_id"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_each_row_has_a_result(spark, name):
    assert len(OPERATORS[name](documents(spark, ROWS)).collect()) == len(ROWS)
    assert OPERATORS[name](documents(spark, [])).count() == 0


def test_dedup_and_cleaning_keep_the_columns(spark):
    docs = documents(spark, ROWS)
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [1, 2, 4, 5]
    assert decontaminate.decontaminate(docs, docs.selectExpr("doc_id as item_id", "text").where("doc_id = 99")).columns == docs.columns


def test_ties_of_languages_and_shards_go_by_order(spark):
    """Texts that two languages fit equally get the first in order; equal sizes give the same shards each time."""
    rows = [(i, "same words here", "ab"[i % 2]) for i in range(60)]
    docs = documents(spark, rows)
    assert {r["lang_pred"] for r in language.identify(docs, language.fit(docs.selectExpr("doc_id + 1000 as doc_id", "text", "lang").union(docs.selectExpr("doc_id + 1000 as doc_id", "text", "case lang when 'a' then 'b' else 'a' end"))), ["doc_id"]).collect()} == {"a"}
    sizes = {str(i): 10 for i in range(100)}
    assert sharding.differencing(sizes, 7) == sharding.differencing(dict(reversed(sizes.items())), 7)
