"""Search by trigrams against ilike on all names."""

import random

import pytest
from pyspark.sql import functions as F

from creasework.operators import name_search
from creasework.plans.api import Store

ODD = ["", "ab", "ABC", "a%b_c", "back\\slash", "Ünïcödé Ström", "ÉCOLE", chr(0x1F600) * 3 + "x", "aaa aaa", "İstanbul", "straße", None]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdeABC ") for _ in range(draw.randint(1, 12)))
    rows = [(i, n) for i, n in enumerate(ODD + [word() for _ in range(600)] + ["the same"] * 3)] + [(None, "no key")]
    names, path = spark.createDataFrame(rows, "key long, name string"), str(tmp_path_factory.mktemp("names"))
    name_search.add(names.where("key < 300"), "name", path)
    name_search.add(names.where("key >= 250 or key is null"), "name", path)  # fifty of them again
    return names.cache(), path


def pattern(draw, names):
    kind = draw.randrange(4)
    if kind == 0:
        return "%" + "".join(draw.choice("abcABC_%") for _ in range(draw.randint(1, 7))) + "%"
    whole = draw.choice([n for n in names if n])
    a = draw.randrange(len(whole))
    part = whole[a : a + draw.randint(1, 8)]
    return (name_search.literal(part), whole.upper().replace("\\", "\\\\"), "%" + whole[: a + 1].replace("\\", "\\\\").replace("a", "_"))[kind - 1]


@pytest.mark.parametrize("seed", range(12))
def test_search_equals_ilike(spark, index, seed):
    names, path = index
    draw = random.Random(seed)
    p = pattern(draw, [r["name"] for r in names.collect()])
    got = sorted(map(tuple, name_search.find(spark, path, "name", p).collect()), key=repr)
    want = sorted(map(tuple, names.where(F.col("name").ilike(p)).distinct().collect()), key=repr)
    assert got == want, p


@pytest.mark.parametrize("text", ["%b_", "\\sl", "ÜNÏ", "école", "STRASSE", "i̇st", "zzz", "", "a", chr(0x1F600) * 3])
def test_odd_names_and_texts(spark, index, text):
    names, path = index
    p = name_search.literal(text)
    got = {tuple(r) for r in name_search.find(spark, path, "name", p).collect()}
    assert got == {tuple(r) for r in names.where(F.col("name").ilike(p)).collect()}
    assert got or text in ("STRASSE", "zzz")


def test_only_the_folder_of_the_rarest_trigram_is_read(spark, index):
    names, path = index
    held = {g: n for g, n in names.where("name is not null").distinct().select(F.explode(name_search.trigrams(F.lower("name"))).alias("g")).groupBy("g").count().collect()}
    assert name_search.rarest(spark, path, "%slash%") in {"sla", "las", "ash"} and held["sla"] == 1
    plan = name_search.find(spark, path, "name", "%back\\\\slash%")._jdf.queryExecution().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    assert "PartitionFilters: [isnotnull(folder" in scan and "EqualTo(gram," in scan and "/grams" in scan
    files = {r[0].split("/")[-2] for r in name_search.find(spark, path, "name", "%slash%").select("name").limit(0).union(spark.read.parquet(f"{path}/grams").where("gram = 'sla'").select(F.input_file_name())).distinct().collect()}
    assert len(files) == 1


def test_patterns_fall_into_literal_parts():
    assert name_search.literal_parts("a\\%b%cd_e\\\\") == ["a%b", "cd", "e\\"] and name_search.literal_parts("%_%") == []


def test_a_store_finds_what_its_search_finds(spark, tmp_path):
    """Names of a second ingest come to the index by a second call; those of an ingest that failed never do."""
    store = Store(spark, str(tmp_path))
    for batch, names in (("one", [("u1", "AB Smith"), (None, "Smithson")]), ("two", [("u1", "AB Smith"), ("u2", "Blacksmith"), ("u3", "Smi%th")])):
        spark.createDataFrame([(u, n, batch) for u, n in [*names]], "uuid string, name string, batch string").write.mode("append").parquet(f"{tmp_path}/people")
        spark.createDataFrame([("u9", "Smith of none", "failed")], "uuid string, name string, batch string").write.mode("append").parquet(f"{tmp_path}/people")
        spark.createDataFrame([(batch, batch)], "source_id string, batch string").write.mode("append").parquet(f"{tmp_path}/matches")
        store.index_names()
    assert spark.read.parquet(f"{tmp_path}/name_index/names").count() == 4
    for text, n in (("sMITH", 3), ("ab s", 1), ("i%t", 1), ("smithsonian", 0), ("sm", 4)):
        found = {tuple(r) for r in store.find(text).select("uuid", "name").collect()}
        assert found == {tuple(r) for r in store.search(text).select("uuid", "name").collect()} and len(found) == n
