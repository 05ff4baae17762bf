import pytest
from pyspark.sql import functions as F

from reqloom.sources.vectorstore import VectorStore, condition, metadata_value


def rows(spark, n=6):
    data = [(f"c{i}", f"text {i}", [1.0, float(i), 0.0], "NVA" if i % 2 else "OKT", "2025_feb", None, ["a", "b"]) for i in range(n)]
    return spark.createDataFrame(data, "id string, text string, embedding array<float>, mno string, release string, doc_type string, path array<string>")


META = ["mno", "release", "doc_type", "path"]


def test_add_scan_count_reset_build(spark, tmp_path):
    s = VectorStore(spark, f"{tmp_path}/store")
    assert s.count() == 0 and s.get_all().count() == 0
    s.add(rows(spark), META)
    s.add(rows(spark, 2).withColumn("text", F.lit("new")), META)
    assert s.count() == 6
    got = {r.id: r for r in s.get_all().collect()}
    assert got["c0"].text == "new" and got["c5"].text == "text 5"
    assert got["c0"].metadata == {"mno": "OKT", "release": "2025_feb", "doc_type": "", "path": '["a","b"]'}
    back = s.get_all().select(metadata_value(F.col("metadata")["path"], "array<string>").alias("p"), metadata_value(F.col("metadata")["mno"], "array<string>").alias("m")).first()
    assert back.p == ["a", "b"] and back.m is None
    assert not s.build(rows(spark), META) and s.build(rows(spark, 3), META) and s.count() == 3
    s.reset()
    assert s.count() == 0


def test_query_with_filters(spark, tmp_path):
    s = VectorStore(spark, f"{tmp_path}/store")
    asked = spark.createDataFrame([(1, [1.0, 2.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, None)], "qid long, embedding array<float>")
    assert s.query(asked, 2).count() == 0
    s.add(rows(spark), META)
    top = lambda where, k=6: {q: [r.id for r in s.query(asked, k, where, "l2").where(F.col("qid") == q).orderBy("rank").collect()] for q in (1, 2)}
    assert top(None, 2) == {1: ["c2", "c1"], 2: ["c0", "c1"]}
    assert top({"mno": "NVA"})[1] == ["c1", "c3", "c5"]
    assert top({"$and": [{"mno": "NVA"}, {"release": "2025_feb"}]}, 1)[2] == ["c1"]
    assert top({"$or": [{"mno": "none"}, {"mno": {"$in": ["OKT"]}}]})[1] == ["c2", "c0", "c4"]
    assert top({"mno": {"$ne": "OKT"}, "doc_type": {"$nin": ["x"]}}, 1)[1] == ["c1"]
    assert top({"lacking": "x"}) == {1: [], 2: []} and top({"mno": {"$in": []}}) == {1: [], 2: []}
    for bad in ({"$not": []}, {"mno": {"$gt": 1}}, {"$and": []}):
        with pytest.raises(ValueError):
            condition(bad)
    with pytest.raises(ValueError):
        s.query(asked, 1, None, "angle")
