"""The default stages on the smallest tables: all nine, whole tables, each reading what earlier ones wrote."""

import os

import pytest
from pyspark.sql import functions as F

from reqloom.operators import parser, references
from reqloom.plans import pipeline as L

BASE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")


def test_default_stages_do_the_whole_job(spark, tmp_path):
    out, docs = str(tmp_path / "out"), tmp_path / "input" / "nva" / "2025_jun"
    docs.mkdir(parents=True)
    (docs / "a.txt").write_text("1 Scope\nbody\n1.1 Terms\nmore\n")
    (docs / "bad.docx").write_bytes(b"no zip")
    stages = L.default_stages(documents=str(tmp_path / "input"))
    assert list(stages) == list(L.default_stages()) == ["extract", "profile", "parse", "resolve", "taxonomy", "standards", "graph", "vectorstore", "eval"]
    got = L.run(spark, BASE, out, stages)
    assert [o.status for o in got] == ["OK"] * 9, L.report(got)
    rows = {t: n for o in got for t, n in o.rows.items()}
    read = lambda t: spark.read.parquet(f"{out}/{t}")
    assert rows["profile"] and rows["req_id_patterns"] and rows["file_blocks"] == 5
    cross = references.resolve_cross_plan(spark, BASE)
    assert rows["refs_cross_plan_resolved"] == cross.count() > 0 and read("refs_cross_plan_resolved").exceptAll(cross).isEmpty()
    assert read("ref_summary").exceptAll(references.status_summary(spark, BASE)).isEmpty()
    files = read("parsed_sections").where("doc_id like '%.txt'").orderBy("ord").collect()
    assert [(r.section, r.title, r.text) for r in files] == [("1", "Scope", "body"), ("1.1", "Terms", "more")]
    assert rows["parsed_sections"] - 2 == parser.parse_documents(spark, BASE).count() > 0
    assert rows["vectors"] == rows["chunks"] + rows["glossary"] > 0 and read("vectors").where("size(vector) <> 64 or vector is null").isEmpty()

    # what resolve wrote is what standards and graph read
    read("refs_standards_resolved").withColumn("spec", F.lit("11.111")).write.parquet(f"{out}/other")
    read("other").write.mode("overwrite").parquet(f"{out}/refs_standards_resolved")
    assert [o.status for o in L.run(spark, BASE, out, stages, first="standards", last="graph")] == ["OK", "OK"]
    assert {r.spec for r in read("reference_index").where("ref_count > 0").collect()} == {"11.111"}
    assert not read("nodes").where("id like 'std:11.111:%'").isEmpty()


def test_after_a_failed_stage_nothing_old_is_read(spark, tmp_path):
    def bad(s, b, o):
        raise RuntimeError("no")

    seen = []
    stages = {"a": lambda s, b, o: seen.append(o) or {"t": s.range(3), "u": lambda: L.made(s, o, "t")}, "b": bad, "c": lambda s, b, o: seen.append(o) or {}}
    got = L.run(spark, "", str(tmp_path), stages, continue_on_error=True)
    assert got[0].rows == {"t": 3, "u": 3} and seen == [str(tmp_path), None] and L.made(spark, str(tmp_path), "none") is None
