from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from skein.sources.jsonindex import MetadataIndex, contains

DOCS = [
    {"lang": "en", "year": 2020, "tags": ["a", "b"], "who": {"name": "X", "age": 3}}, {"lang": "en", "year": "2020"}, {"lang": None, "year": 2020.0}, {"year": True}, {"tags": [{"a": 1, "b": 2}, {"a": 3}]},
    {"tags": [{"a": 1}, {"b": 2}]}, {"who": {"name": None}}, {"who": []}, {"who": {}}, [1, 2, {"lang": "en"}], "en", 5, None, {"a.b": 1, "a": {"b": 2}}, {"lang": ["en"]}, {"lang": {"en": 1}}, {}, [], {"tags": [["a"], "b"]}, {"n": -0.5}, {"n": 10**20}, {"n": 1e308},
]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = [(i, json.dumps(d)) for i, d in enumerate(DOCS)] + [(100, None), (101, "{broken"), (102, ""), (103, json.dumps(DOCS[0])), (None, '{"lang": "en"}')]
    return MetadataIndex.build(spark.createDataFrame(rows, "id long, meta string"), "id", "meta", str(tmp_path_factory.mktemp("json")))


ALL = {**dict(enumerate(DOCS)), 103: DOCS[0]}


@pytest.mark.parametrize("part", [
    {"lang": "en"}, {"year": 2020}, {"year": "2020"}, {"year": True}, {"lang": None}, {"who": {"name": "X"}}, {"who": {}}, {"who": []}, {"tags": ["b"]}, {"tags": ["b", "a"]}, {"tags": [{"a": 1, "b": 2}]}, {"tags": [{"a": 1}, {"a": 3}]},
    {"lang": "en", "year": 2020}, {}, [], [2], [{"lang": "en"}], "en", 5, None, {"a.b": 1}, {"a": {"b": 2}}, {"lang": ["en"]}, {"tags": [["a"]]}, {"tags": ["a"]}, {"n": 10**20}, {"nothing": 1}, {"n": 1e308},
])
def test_containment(index, part):
    assert sorted(r.id for r in index.containing(part).collect()) == [i for i, d in ALL.items() if contains(d, part)]


def test_keys_and_ranges(index):
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(index.has_key("lang")) == [0, 1, 2, 9, 14, 15, 103] and ids(index.has_key("who", "name")) == [0, 6, 103] and ids(index.has_key("a.b")) == [13]
    assert ids(index.between(("year",), 2000, 2020)) == [0, 2, 103] and ids(index.between(("year",), "2", "3")) == [1]
    assert ids(index.between(("n",), high=0)) == [19] and ids(index.between(("tags",), "b")) == [0, 18, 103]
    with pytest.raises(ValueError):
        index.between(("year",), 1, "2")


def test_random_documents(spark, tmp_path):
    rng = random.Random(1)
    def value(depth):
        kind = rng.randrange(7 if depth else 4)
        if kind < 4:
            return rng.choice([None, True, 1, 2, "1", "x", 1.5])
        return [value(depth - 1) for _ in range(rng.randint(0, 3))] if kind == 4 else {rng.choice("abc"): value(depth - 1) for _ in range(rng.randint(0, 3))}

    docs = {i: value(3) for i in range(300)}
    index = MetadataIndex.build(spark.createDataFrame([(i, json.dumps(d)) for i, d in docs.items()], "id long, j string"), "id", "j", str(tmp_path))
    for _ in range(25):
        part = value(2)
        assert sorted(r.id for r in index.containing(part).collect()) == [i for i, d in docs.items() if contains(d, part)], part


def test_selective_filters_read_few_files(spark, tmp_path):
    rows = spark.range(20_000).select("id", F.to_json(F.struct((F.col("id") % 500).alias("k"), F.concat(F.lit("u"), F.col("id")).alias("user"))).alias("j"))
    index = MetadataIndex.build(rows.repartition(4), "id", "j", str(tmp_path), file_rows=1_000)
    files = len(index.values.inputFiles())
    assert files >= 60

    def read(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [" in plan and "EqualTo(path,k)" in plan
        return df.select(F.input_file_name()).distinct().count()

    one = index.values.where((F.col("path") == "k") & (F.col("kind") == "number") & (F.col("number") == 7.0))
    assert read(one) <= 2
    low, high = (index.values.where("path = 'k'").groupBy(F.input_file_name().alias("f")).agg(F.min("number").alias("a"), F.max("number").alias("z")).agg(F.sum(F.when((F.col("a") <= 7) & (F.col("z") >= 7), 1).otherwise(0)).alias("hit"), F.count("*").alias("n")).first())
    assert low <= 2 and low * 10 <= high and sorted(r.id for r in index.containing({"k": 7}).collect()) == list(range(7, 20_000, 500))
