"""Operator 1: benchmark decontamination, DataFrame functions only.

Words are runs of digits, letters and non-ASCII characters, with A-Z lower-cased. A benchmark window is ten
consecutive words of an item; an item of fewer words, but not none, is one window. The windows are a hash set that is
broadcast behind a check of its size (beyond it, hashes and places are shuffled to it, never words). Every window of every document is hashed by
doubling (pairs, fours, eights, then ten words), looked up, and a hit is verified word by word.

Null texts have no words. Null ids and repeated rows are kept as they are, one result per input row. Items without
words match nothing, items of equal text each count. Empty tables give an empty result, or documents without hits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creasework.llm.common import RAW_WORD, ascii_lower, settle, table

#: Windows of a benchmark that may be broadcast; at some 150 bytes each they need 150 MB at most.
BROADCAST_WINDOWS = 1_000_000


def raw_words(text: str | Column) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(RAW_WORD), F.lit(0))


def _paired(left: Column, right: Column, shift: int, n: Column) -> Column:
    """hash(left[i], right[i + shift]) for each i where both are."""
    tail = F.slice(right, shift + 1, F.greatest(F.size(right) - shift, F.lit(0)))
    return F.zip_with(F.slice(left, 1, F.greatest(F.least(F.size(left), F.size(right) - shift), F.lit(0))), tail, lambda a, b: F.xxhash64(a, b))


def with_window_hashes(df: DataFrame, words: str, length: int, out: str) -> DataFrame:
    """Add out: the hash of each run of length words (none if there are fewer)."""
    df = df.withColumn("_p1", F.transform(words, lambda w: F.xxhash64(F.lower(w))))
    done, have, size = "_p1", length & 1, 1
    done = "_p1" if have else None
    while size * 2 <= length:
        df = df.withColumn(f"_p{size * 2}", _paired(F.col(f"_p{size}"), F.col(f"_p{size}"), size, None))
        size *= 2
        if length & size:
            if done is None:
                done = f"_p{size}"
            else:
                df = df.withColumn(f"_d{size}", _paired(F.col(done), F.col(f"_p{size}"), have, None))
                done = f"_d{size}"
            have |= size
    return df.withColumn(out, F.col(done)).drop(*(c for c in df.columns if c.startswith(("_p", "_d")) and c != out))


def windows(items: DataFrame, length: int = 10) -> DataFrame:
    """(size, hash, gram, items): the distinct windows of benchmark items (item_id, text), each with its items."""
    split = items.select("item_id", F.transform(raw_words("text"), lambda w: ascii_lower(w)).alias("words")).where(F.size("words") > 0)
    grams = split.select(
        "item_id",
        F.least(F.size("words"), F.lit(length)).alias("size"),
        F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - length + 1, F.lit(1))), lambda i: F.slice("words", i, length))).alias("gram"),
    )
    return grams.groupBy("size", "gram").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def _merged(spans: Column, length: int) -> Column:
    """Sorted spans of length places at most, joined where they touch or overlap; linear in their number.

    Of the spans with one start the longest counts, so only the length spans before a place can reach it.
    """
    none = F.array().cast("array<struct<start:int,end:int>>")
    longest = F.filter(spans, lambda s, i: F.coalesce(F.try_element_at(spans, i + 2)["start"] > s["start"], F.lit(True)))

    def of(a: Column) -> Column:
        last = lambda i: F.array_max(F.transform(F.slice(a, F.greatest(i - length, F.lit(0)) + 1, F.least(i, F.lit(length))), lambda s: s["end"]))
        first = F.filter(F.transform(a, lambda s, i: F.when((i == 0) | (last(i) < s["start"]), i)), lambda i: i.isNotNull())
        stops = lambda b: F.transform(F.concat(F.slice(b, 2, F.greatest(F.size(b) - 1, F.lit(0))), F.array(F.size(a))), last)
        ends = F.transform(F.array(first), lambda b: F.zip_with(F.transform(b, lambda i: F.element_at(a, i + 1)["start"]), stops(b), lambda s, e: F.struct(s.alias("start"), e.alias("end"))))
        return F.element_at(ends, 1)

    # one-element arrays bind an intermediate, so that it is computed once a row
    return F.when(F.size(spans) > 0, F.element_at(F.transform(F.array(longest), of), 1)).otherwise(none)


def _without(items: Column, spans: Column) -> Column:
    """items outside the merged spans (start, end): the slices between them, linear in both."""
    starts, ends = F.transform(spans, lambda s: s["start"]), F.transform(spans, lambda s: s["end"])
    between = F.zip_with(F.concat(F.array(F.lit(0)), ends), F.concat(starts, F.array(F.size(items))), lambda a, b: F.slice(items, a + 1, b - a))
    return F.flatten(between)


def hits(docs: DataFrame, items: DataFrame, length: int = 10, keep: list[str] | None = None) -> DataFrame:
    """For each row of docs: the kept columns, uid, n_words, spans (start, end of merged hits) and items.

    One pass: each row gives a header and its windows; windows outside the hash set go before anything is shuffled.
    """
    keep = keep or ["doc_id"]
    grams = settle(windows(items, length), "windows")
    known = grams.agg(F.count("*"), F.array_sort(F.collect_set("size"))).first()
    sizes = list(known[1] or [])
    hashed = [with_window_hashes(grams.where(F.col("size") == s), "gram", s, "hs").select("size", "gram", "items", "hs") for s in sizes]
    rows = docs.select(F.struct(*keep).alias("row"), F.monotonically_increasing_id().alias("uid"), raw_words("text").alias("words"))
    for s in sizes:
        rows = with_window_hashes(rows, "words", s, f"h{s}")
    n = F.size("words")
    if not sizes:
        return rows.select("row.*", "uid", n.alias("n_words"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.array().cast("array<long>").alias("items"))
    set_ = settle(reduce(DataFrame.union, hashed), "grams").select("size", "gram", "items", F.element_at("hs", 1).alias("hash"))
    lower = lambda gram: F.transform(gram, lambda w: ascii_lower(w))
    span = lambda place, size: F.struct(place.alias("start"), (place + size).alias("end"))
    if known[0] <= BROADCAST_WINDOWS:
        # one pass: the windows of the first size come first, then those of the next; place 0 is the document itself
        starts, before = {}, F.lit(1)
        for s in sizes:
            starts[s] = before
            before = before + F.greatest(n - s + 1, F.lit(0))
        tall = rows.select("row", "uid", "words", F.posexplode(F.concat(F.array(F.xxhash64("uid")), *(f"h{s}" for s in sizes))).alias("at", "hash"))
        met = tall.join(F.broadcast(set_), "hash", "left").where("at = 0 or size is not null")
        place = F.col("at") - F.coalesce(*(F.when(F.col("size") == s, starts[s]) for s in sizes))
        start = F.when((F.col("at") > 0) & (place >= 0) & (place + F.col("size") <= n), place)
        # a hit takes its own words along, never its whole document: slices are cut in the same generated code as the
        # join, because the window is used twice below and so isn't merged into what follows
        met = met.select("row", "uid", n.alias("n_words"), "size", "gram", "items", start.alias("place"), F.slice("words", F.coalesce(start, F.lit(0)) + 1, F.coalesce(F.when(start.isNotNull(), F.col("size")), F.lit(0))).alias("window"))
        true = F.col("place").isNotNull() & (F.size("window") == F.col("size")) & (lower("window") == F.col("gram"))
        met = met.select("row", "uid", "n_words", F.when(true, span(F.col("place"), F.col("size"))).alias("span"), F.when(true, F.col("items")).alias("items"))
        by_row = met.groupBy("uid").agg(F.first("row").alias("row"), F.max("n_words").alias("n_words"), F.sort_array(F.collect_list("span")).alias("spans"), F.collect_set("items").alias("items"))
    else:
        # only numbers are shuffled for the search; the few hits of a document come back to its words together
        rows = settle(rows, "hashed")
        of_size = lambda s: F.transform(f"h{s}", lambda h, i: F.struct(h.alias("hash"), i.alias("place"), F.lit(s).alias("own")))
        tall = rows.select("uid", F.explode(F.concat(*(of_size(s) for s in sizes))).alias("w")).select("uid", "w.*")
        found = tall.join(set_, "hash").where("own = size").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("place", "size", "gram", "items"))).alias("found"))
        true = lambda x: lower(F.slice("words", x["place"] + 1, x["size"])) == x["gram"]
        by_row = rows.select("row", "uid", "words").join(found, "uid", "left").withColumn("found", F.coalesce(F.filter("found", true), F.filter(F.array().cast(found.schema["found"].dataType), true)))
        by_row = by_row.select("row", "uid", n.alias("n_words"), F.transform("found", lambda x: span(x["place"], x["size"])).alias("spans"), F.transform("found", lambda x: x["items"]).alias("items"))
    merged = _merged(F.col("spans"), length)
    return by_row.select("row.*", "uid", "n_words", merged.alias("spans"), F.array_distinct(F.flatten("items")).alias("items"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    names = F.sort_array(F.transform("items", lambda i: i.cast("string")))
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, length: int = 10, max_share: float = 0.5) -> DataFrame:
    """docs without the words that benchmark windows hit.

    A document of which max_share of the words or more are hit goes; in the others the hit spans are cut, each word with
    the gap before it, and n_chars is counted again. Documents without hits stay untouched.
    """
    tagged = settle(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("key")), "rows")  # numbered once
    found = settle(hits(tagged.select("key", "row.text"), items, length, ["key"]).where(F.size("spans") > 0).select("key", "spans", "n_words"), "hits")
    hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    words, gaps = raw_words(F.col("row.text")), F.split("row.text", RAW_WORD)  # gap i stands before word i
    pieces = F.zip_with(gaps, F.concat(words, F.array(F.lit(""))), lambda g, w: F.concat(g, w))
    # bound once a row by a one-element array, as every slice would split the text again
    kept = F.element_at(F.transform(F.array(pieces), lambda p: _without(p, F.col("spans"))), 1)
    text = F.array_join(kept, "")
    joined = tagged.join(found, "key", "left").where(F.col("spans").isNull() | (hit < max_share * F.col("n_words")))
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return joined.select(F.when(F.col("spans").isNull(), F.col("row")).otherwise(row).alias("row")).select("row.*")
