"""Decontamination, fingerprints, language, toxicity, licences."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from creasework.llm import decontaminate, language, licences, sketches, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
words = lambda t: WORD.findall((t or "").translate(LOW))


def brute_hits(docs, items):
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            grams.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for g, own in grams.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    found |= own
        out.append((d, len(w), len(hit), sorted(found)))
    return out


def found_hits(df):
    return [(r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), sorted(r["items"])) for r in df.collect()]


def test_decontamination_against_brute_force(spark):
    rnd = random.Random(1)
    item = [" ".join(rnd.choice("abcdefghijklmnop") + rnd.choice("xyz") for _ in range(25)) for _ in range(4)]
    items = [(0, item[0]), (1, item[1].upper()), (2, "Short, ITEM é"), (3, "x9"), (4, ""), (5, None), (6, item[0])]
    docs = [(1, f"pre {item[0]} post"), (2, item[1]), (3, "a short-item é! b SHORT item é"), (4, "É short item É x9 x9"), (5, None), (6, ""), (7, " ".join(item[2].split()[3:12])), (8, " ".join((item[0] + " " + item[0]).split()[20:32])), (None, "x9"), (8, "x9 twice"), (8, "x9 twice"), (9, "K x9 ſ" * 500)]
    got = found_hits(decontaminate.hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(brute_hits(docs, items), key=key)


def test_shuffled_windows_equal_broadcast_ones(spark, monkeypatch):
    docs, items = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "z")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "z")], "item_id long, text string")
    want = sorted(found_hits(decontaminate.hits(docs, items)))
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert sorted(found_hits(decontaminate.hits(docs, items))) == want == [(1, 11, 11, [1]), (2, 1, 1, [2])]


def test_decontamination_cuts_spans_and_keeps_the_rest(spark):
    passage = "b1 b2 b3 b4 b5 b6 b7 b8 b9 b10 b11"
    clean = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"{clean}. {passage}! Then: {clean}", 0, "k"), (2, passage, 0, "k"), (3, "Clean,  text.", 7, "k"), (4, None, None, "k")], "doc_id long, text string, n_chars long, spans string")
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()}
    assert set(got) == {1, 3, 4} and got[3]["text"] == "Clean,  text." and got[3]["n_chars"] == 7 and got[4]["text"] is None
    assert "b5" not in got[1]["text"] and got[1]["text"].count("w29") == 2 and got[1]["n_chars"] == len(got[1]["text"]) and got[1]["spans"] == "k"


def test_spans_are_merged_and_cut_as_one_by_one(spark):
    draw = random.Random(5)
    rows = []
    for key in range(200):
        n = draw.randint(0, 60)
        spans = sorted({(a, min(n, a + draw.choice([1, 3, 10]))) for a in (draw.randrange(max(n, 1)) for _ in range(draw.randint(0, 12) if n else 0))})
        rows.append((key, list(range(n)), spans))
    df = spark.createDataFrame(rows, "key int, items array<int>, spans array<struct<start:int,end:int>>")
    df = df.withColumn("merged", decontaminate._merged(F.col("spans"), 10)).withColumn("kept", decontaminate._without(F.col("items"), F.col("merged")))
    got = {r["key"]: ([tuple(s) for s in r["merged"]], list(r["kept"])) for r in df.collect()}
    for key, items, spans in rows:
        want = []
        for a, e in spans:
            if want and a <= want[-1][1]:
                want[-1] = (want[-1][0], max(want[-1][1], e))
            else:
                want.append((a, e))
        assert got[key] == (want, [i for i in items if not any(a <= i < e for a, e in spans)])


def test_a_document_of_very_many_separate_hits(spark):
    n = 20_000
    docs = spark.createDataFrame([(1, " ".join(f"hit w{i}" for i in range(n)))], "doc_id long, text string")
    items = spark.createDataFrame([(7, "hit")], "item_id long, text string")
    assert found_hits(decontaminate.hits(docs, items)) == [(1, 2 * n, n, [7])]
    row = decontaminate.decontaminate(docs, items, max_share=0.6).first()
    assert row["text"] == "".join(f" w{i}" for i in range(n))  # a word goes with the gap before it


def test_no_benchmark(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert found_hits(decontaminate.hits(docs, none)) == [(1, 2, 0, [])]
    assert decontaminate.decontaminate(docs, none).count() == 1
    assert decontaminate.hits(docs.where("false"), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_sketches_recover_exactly_what_differs():
    rnd = random.Random(2)
    texts = ["", "a", "same line\n" * 30, "x" * 3000, *("".join(rnd.choice("abcdef \n") for _ in range(rnd.randint(1, 4000))) for _ in range(40))]
    left = [sketches.paragraph_digests(t) for t in texts]
    right = [sketches.paragraph_digests(rnd.choice(texts)[:500] + t[100:]) for t in texts]
    for a, b, d in zip(left, right, sketches.differences(left, right), strict=True):
        assert len(set(a.tolist())) == len(a) and set(d.tolist()) == set(a.tolist()) ^ set(b.tolist())


def test_fingerprints_follow_descending_ids(spark):
    rnd = random.Random(3)
    rows = [(i * 7 % 101, "".join(rnd.choice("abcé 😀\n") for _ in range(rnd.randint(0, 300)))) for i in range(101)] + [(None, "last"), (500, None), (500, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sketches.with_followers(df, rows_per_bucket=10).mapInArrow(sketches._fingerprinted, sketches.fingerprints(df).schema).collect()
    hashes = {r["text"]: r["h"] for r in df.selectExpr("text", "xxhash64(coalesce(text, '')) as h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]], r[1] or ""))
    want = sorted((r[0] is None, r[0] or 0, hashlib.sha256(sketches.edited(r[1] or "", n[1] or "").encode()).hexdigest()) for r, n in zip(order, order[1:] + order[:1], strict=True))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["edited_sha256"]) for r in got) == want
    assert sketches.fingerprints(df.where("false")).count() == 0
    one = sketches.fingerprints(df.where("doc_id = 7")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


LANGS = {"aa": "akara tamani solo kutu", "bb": "strench plurg knimm drofft", "cc": "éléa oui çavoi naïou"}


def language_docs(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(LANGS[k].split()) for _ in range(30)), k) for i in range(240) for k in [sorted(LANGS)[i % 3]]]
    return spark.createDataFrame([*rows, (900, None, "aa"), (901, "", "aa"), (902, "12 34!", "bb"), (903, "strench plurg", None), (None, "oui", "cc")], "doc_id long, text string, lang string")


def test_language(spark):
    docs = language_docs(spark)
    model = language.fit(docs)
    got = {r["doc_id"]: r for r in language.identify(docs, model, ["doc_id", "lang"]).collect()}
    assert all(r["lang_pred"] == r["lang"] for i, r in got.items() if i is not None and i < 240)
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "bb"] and all(0 <= r["score"] <= 1 for r in got.values())
    mixed = spark.createDataFrame([(1, " ".join([LANGS["aa"]] * 60 + [LANGS["bb"]] * 30))], "doc_id long, text string")
    shares = {m["lang"]: m["share"] for m in language.identify(mixed, model, ["doc_id"]).first()["mixture"]}
    assert set(shares) == {"aa", "bb"} and shares["aa"] > shares["bb"] > 0.15
    assert language.identify(docs, language.fit(docs.where("false")), ["doc_id"]).first()["lang_pred"] == "und"


def test_maximal_segments_against_definition():
    rnd = random.Random(5)
    for _ in range(300):
        n = rnd.randint(1, 14)
        scores = [rnd.randint(1, 6) if rnd.random() < 0.4 else -1 for _ in range(n)]
        want = []

        def cut(a, b, scores=scores, want=want):
            best = max(((sum(scores[i:j]), i - j, -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
            if best and best[0] > 0:
                best = max((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1))
                want.append((best[3], best[4], best[0]))
                cut(a, best[3])
                cut(best[4], b)

        cut(0, n)
        got = toxicity.maximal_segments([(i, s) for i, s in enumerate(scores) if s > 0], -1.0)
        assert sorted(x[2] for x in got) == sorted(x[2] for x in want)


def test_toxicity(spark):
    rnd = random.Random(6)
    plain = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(80)]
    rows, labels = [], []
    for i in range(600):
        text = [rnd.choice(plain) for _ in range(60)]
        bad = i % 10 == 0
        if bad:
            for k in range(20, 26):
                text[k] = rnd.choice(["zzid", "zzot", "zzum"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (5, None), (7, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    got = {r["doc_id"]: r for r in toxicity.scan_texts(docs, model, ["doc_id"]).collect()}
    assert all(got[i]["predicted"] == bad for i, bad in labels)
    assert got[900]["predicted"] == got[901]["predicted"] == 0
    span = got[0]["passages"][0]
    assert span["first"] == 20 and span["last"] == 25
    none = toxicity.fit(docs, marks.where("false"))
    assert all(r["predicted"] == 0 for r in toxicity.scan_texts(docs, none, ["doc_id"]).collect())


@pytest.mark.parametrize(("every", "sample"), [(2, 8000), (8, 60)])
def test_toxicity_of_a_balanced_sample(spark, every, sample):
    """As many texts of each label, in the input or by the bound of the sample: the weights stay, the odds are the input's."""
    rnd = random.Random(8)
    plain = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(80)]
    rows, labels = [], []
    for i in range(800):
        text = [rnd.choice(plain) for _ in range(60)]
        bad = i // 2 % every == 0
        if bad:
            for k in range(20, 26):
                text[k] = rnd.choice(["zzid", "zzot", "zzum"])
        elif i % 40 < 4:
            text[30] = "zzid"
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, sample)
    assert all(model.token(w) > 0 for w in ("zzid", "zzot", "zzum")) and not any(map(model.token, plain))
    got = {r["doc_id"]: r for r in toxicity.scan_texts(docs, model, ["doc_id"]).collect()}
    assert all(got[i]["predicted"] == bad for i, bad in labels)


def test_toxicity_odds_are_those_of_the_labels(spark):
    """Texts that tell nothing score the toxic share of the labels, not that of the sample."""
    docs = spark.createDataFrame([(i, "one two three four") for i in range(2000)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(2000)], "doc_id long, toxic int")
    for sample in (8000, 100):
        score = toxicity.scan_texts(docs.limit(1), toxicity.fit(docs, marks, sample), ["doc_id"]).first()["score"]
        assert 0.06 < score < 0.16, sample


def test_licences(spark):
    texts = ["Released under the MIT-License.\nApache license; mit license", "the GNU Genral Public Licence v3", "mitlicense commit license", "general public license general public license", None, "", "licensed under teh apache lisense, version 2.0", "permission is herby granted, free of charge, to any person"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licences.scan(docs, ["doc_id"]).collect()}
    phrases = {tuple(p.split()): label for p, label in licences.PHRASES.items()}
    for i, t in enumerate(texts):
        w = words(t)
        places = [(k, label) for p, label in phrases.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(places), ",".join(sorted({x for _, x in places})))
        assert (r["first_word"], r["last_word"]) == (min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
    assert got[1]["labels"] == "gpl" and got[1]["n_base"] == 0 and 0 < got[1]["score"] < 1
    assert got[2]["n_base"] == 0 and got[6]["labels"] == "apache" and got[7]["labels"] == "mit" and got[5]["score"] == 0


@pytest.mark.parametrize("line", ["apache license", "apache licnse", "x apache licensee y", "apaches license"])
def test_fuzzy_spans_lie_at_words(line):
    for label, a, e, edits in licences.fuzzy_notices(line):
        assert label == "apache" and edits <= 3 and (a == 0 or line[a - 1] == " ") and (e == len(line) or line[e] == " ")


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def tells(notice, errors, span):
    """Whether a span has a notice's telling words, by comparing all that stands near their places."""
    words, at = notice.split(), 0
    for w in words:
        if w == "version":
            break  # the number of a version tells no licence
        near = range(max(0, at - errors), min(len(span), at + len(w) + errors) + 1)
        parts = {(i, j): span[i:j] for i in near for j in near if i < j}
        if w in licences.TELLING:
            if w.isdigit():
                ok = any(x == w and not span[:i][-1:].isdigit() and not span[j : j + 1].isdigit() for (i, j), x in parts.items())
            elif len(words) == 2 and len(w) < 4:
                ok = w in span.split()
            else:
                ok = any(abs(len(x) - len(w)) <= 1 and levenshtein(x, w) <= 1 for x in parts.values())
            if not ok:
                return False
        at += len(w) + 1
    return True


def test_fuzzy_notices_against_edit_distance():
    """Planted notices with edits: every label that a scan of all word spans by edit distance gives, and no other."""
    rnd = random.Random(31)
    found = wanted = 0
    for _ in range(60):
        notice, _, errors = rnd.choice([n for n in licences.NOTICES if len(n[0]) < 45])
        edited = list(notice)
        for _ in range(rnd.randint(0, errors + 1)):
            at = rnd.randrange(len(edited))
            edited[at : at + rnd.randint(0, 1)] = rnd.choice(["", "x", "e"])
        line = " ".join(" ".join(["lorem", "".join(edited), "ipsum dolor"]).split())
        starts = [0, *(i + 1 for i, c in enumerate(line) if c == " ")]
        ends = [*(i for i, c in enumerate(line) if c == " "), len(line)]
        want = set()
        for text, label, most in licences.NOTICES:
            spans = (line[a:e] for a in starts for e in ends if abs(e - a - len(text)) <= most and a < e)
            if any(levenshtein(text, x) <= most and tells(text, most, x) for x in spans):
                want.add(label)
        got = {m[0] for m in licences.fuzzy_notices(line)}
        assert got <= want, line
        found, wanted = found + len(got), wanted + len(want)
    assert wanted > 40 and found >= 0.97 * wanted


@pytest.mark.parametrize("notice", licences.NOTICES, ids=lambda n: n[0])
def test_planted_edits_are_found(notice):
    """Of notices with one to as many random edits as they allow at least nine in ten are found; of "mit license", whose
    name must stand, half."""
    text, label, most = notice
    rnd, found = random.Random(text), 0
    for _ in range(100):
        edited = list(text)
        for _ in range(rnd.randint(1, most)):
            at, kind, letter = rnd.randrange(len(edited)), rnd.randrange(3), rnd.choice("abcdefghijklmnopqrstuvwxyz")
            edited[at : at + (kind > 0)] = letter if kind < 2 else ""
        line = " ".join(f"lorem ipsum {''.join(edited)} dolor sit".split())
        found += label in {m[0] for m in licences.fuzzy_notices(line)}
    assert found >= (50 if text == "mit license" else 90)


def test_near_misses_are_no_licences(spark):
    """Texts that look like notices; the spans and labels that a scan reports of those that are."""
    for line in ("permit licence", "permit license fee", "limit license", "released under the mpl license", "released under the bsd license", "bsd 23 clause license", "bsd 4 clause license", "general purpose license", "a patchy license"):
        assert not licences.fuzzy_notices(line), line
    rows = [(1, "We use: Apache Lisense, version 2. Bsd2 clause license"), (2, "permit license"), (3, None)]
    got = {r["doc_id"]: (r["labels"], [tuple(m) for m in r["matches"]]) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert got == {1: ("apache,bsd", [("apache", 2, 3, 1), ("bsd", 6, 8, 1)]), 2: ("", []), 3: ("", [])}


def test_words_that_tell_licences_apart_are_not_edited():
    for line in ("hit license", "it license", "the submit license", "bsd 4 clause license"):
        assert not {m[0] for m in licences.fuzzy_notices(line)} & {"mit", "bsd"}, line


def test_far_and_repeated_ids_share_no_bucket(spark):
    """One id far from all others, one id with a third of the rows, null ids: buckets stay small, nothing is lost."""
    rows = [(i, f"text {i}") for i in range(600)] + [(10**15, "far")] + [(7, f"seven {i}") for i in range(300)] + [(None, f"none {i}") for i in range(90)]
    dealt = sketches.with_followers(spark.createDataFrame(rows, "doc_id long, text string"), rows_per_bucket=30)
    sizes = [r["count"] for r in dealt.where("not halo").groupBy("bucket").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= 100 and len(sizes) > 20


def test_letters_beyond_the_first_plane_are_told_from_signs():
    """Emoji and mathematical digits are no letters, ideographs of extension B and mathematical letters are."""
    emoji, digit, ideograph, letter = chr(0x1F600), chr(0x1D7D9), chr(0x20000), chr(0x1D400)
    assert not len(language.trigram_cells(f"{emoji}{emoji} {chr(0x1F680)}")) and not len(language.trigram_cells(digit * 3))
    assert len(language.trigram_cells(ideograph)) == 1 and len(language.trigram_cells(letter)) == 1
    assert language.trigram_cells(f"abc{emoji}def").tolist() == language.trigram_cells("abc def").tolist()


def test_texts_of_signs_alone_have_no_language(spark):
    rows = [(i, "same words here", "a") for i in range(30)] + [(100, chr(0x1F600) * 5, None), (101, chr(0x1D7D9), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(docs, language.fit(docs), ["doc_id"]).where("doc_id >= 100").collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0), ("und", 0.0)]
