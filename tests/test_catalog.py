"""References in texts and candidate files on small tables, counted by hand."""

import datetime as dt

from reqloom.operators import catalog as C

AT = dt.datetime(2025, 1, 1)
TEXTS = {
    1: "3GPP TS 24.301 and 3GPP TS 36.331 clause 5.2, 3GPP TS 36.331 clause 5.3; TS 24.301 again, see AB_REQ_P_1 and AB_REQ_Q_2",
    2: "In release 12 of the network 3GPP TS 24.301 section 5.5.3 applies.",
    3: "Release 9" + " " * 150 + "TS 38.101" + " " * 95 + "rel. 8" + " " * 100,
    4: "TS 38.101" + "." * 90 + " release 15",
    5: "3GPP TS 24.301 clause 1.1, 3GPP TS 24.301 clause 1.1 and TS\t24.301, Section 1.2",
    6: "nothing at all, 3GPP TS 62 .164",
    7: None,
}


def requirements(spark, base):
    rows = [(i, "P", t, AT) for i, t in TEXTS.items()]
    spark.createDataFrame(rows + rows[:2], "rec_id bigint, plan_id string, text string, ingested_at timestamp_ntz").write.parquet(f"{base}/requirements.parquet")


def test_cross_refs_specs_sections_and_release_around(spark, tmp_path):
    requirements(spark, tmp_path)
    got = {r.rec_id: r for r in C.cross_refs(spark, str(tmp_path)).collect()}
    said = {i: [tuple(s) for s in r.standards] for i, r in got.items()}
    assert said == {
        1: [("36.331", "5.2", None), ("36.331", "5.3", None), ("24.301", "", None)],
        2: [("24.301", "5.5.3", "12")],
        3: [("38.101", "", None)],
        4: [("38.101", "", None)],
        5: [("24.301", "1.1", None), ("24.301", "1.2", None)],
    }
    assert {i: (r.internal, r.external, r.specs, r.with_release) for i, r in got.items()} == {1: (1, 1, 3, 0), 2: (0, 0, 1, 1), 3: (0, 0, 1, 0), 4: (0, 0, 1, 0), 5: (0, 0, 2, 0)}


def test_release_is_read_up_to_100_characters_on_both_sides():
    for gap, near in ((90, "7"), (91, None)):
        assert C.standards_in("release 7" + " " * gap + " TS 38.101")[0]["release"] == near
        assert C.standards_in("TS 38.101 " + " " * gap + "release 7")[0]["release"] == near


def test_version_candidates_of_every_named_release(spark, tmp_path):
    refs = [(1, "A", "3GPP TS 24.301", "Release 11"), (2, "A", "TS 24.301", "Rel-9"), (3, "B", "36.331", ""), (4, "B", "99.999", "16"), (5, "A", "36.331", "Release 99"), (6, "A", "36.331", "")]
    rows = [(i, "m", "r", p, s, rel, AT) for i, p, s, rel in refs]
    spark.createDataFrame(rows + rows[:1], "ref_id bigint, mno string, release string, plan_id string, spec string, spec_release string, ingested_at timestamp_ntz").write.parquet(f"{tmp_path}/refs_standards.parquet")
    spark.createDataFrame([("m", "r", "A", {"36.331": "Release 10"}, AT)], "mno string, release string, plan_id string, referenced_standards_releases map<string,string>, loaded_at timestamp_ntz").write.parquet(f"{tmp_path}/plans.parquet")
    spark.createDataFrame([("24.301",), ("38.101",)], "spec string").write.parquet(f"{tmp_path}/spec_catalog.parquet")
    got = [tuple(r) for r in C.version_candidates(spark, str(tmp_path)).select("spec", "release_num", "attempt", "file").collect()]
    code = "0123456789abcdefghijklmnopqrstuvwxyz"
    pairs = [("24.301", 11), ("24.301", 9), ("36.331", 10), ("99.999", 16), ("24.301", 15), ("38.101", 15)]
    assert sorted(got) == sorted((s, n, 20 - m, f"{s.replace('.', '')}-{code[n]}{code[m]}0.zip") for s, n in pairs for m in range(21))


def test_acronym_questions_with_titles_of_one_word(spark, tmp_path):
    spark.createDataFrame([("Radio",), ("",), (None,), ("Bulk CSFB",), ("Bulk  VoLTE",)], "title string").write.parquet(f"{tmp_path}/requirements.parquet")
    asked = [(1, "What is CSFB?"), (1, "What is CSFB?"), (2, "What is VoLTE?"), (3, "What is Radio?"), (4, None)]
    spark.createDataFrame(asked, "id bigint, question string").write.parquet(f"{tmp_path}/test_feedback.parquet")
    assert [tuple(r) for r in C.acronym_questions(spark, str(tmp_path)).collect()] == [("csfb", 1)]
