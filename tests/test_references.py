"""The index of cited standards against a brute force over small tables."""

import datetime as dt
import re

from reqloom.operators import references as R

# The reference's three patterns, with `subclause`, which the test texts use too; (regex, spec group, section group).
PATTERNS = [
    (r"(?:3GPP\s+)?TS\s+(\d[\d.]*\d)\s*,?\s*(?:[Ss]ection|(?:[Ss]ub)?[Cc]lause|§)\s+([\d]+(?:\.[\d]+)*)", 1, 2),
    (r"(?:[Ss]ection|(?:[Ss]ub)?[Cc]lause|§)\s+([\d]+(?:\.[\d]+)*)\s+of\s+(?:3GPP\s+)?TS\s+(\d[\d.]*\d)", 2, 1),
    (r"(?:3GPP\s+)?TS\s+(\d[\d.]*\d)\s*(?:\(?\s*(?:reference\s*)?\[[\d]+\]\s*\)?)\s*,?\s*(?:[Ss]ection|(?:[Ss]ub)?[Cc]lause)\s+([\d]+(?:\.[\d]+)*)", 1, 2),
]
TEXTS = [
    ("A", "See 3GPP TS 24.301 clause 5.5.3 for this."),
    ("A", "TS 24.301, Section 5.6 and section 5.7.1 of 3GPP TS 24.301."),
    ("A", "Per TS 36.331 [5] section 6.2 and TS 36.331 (reference [12]), Clause 7."),
    ("A", "TS 38.101 § 4.2; Subclause 9 of TS 38.101"),
    ("B", "TS 24.301 clause 1.1"),
    ("B", "TS 99.999 without a section; clause 4 alone; TS 9 section 3"),
    ("C", None),
]
REFS = [(1, "A", "3GPP TS 24.301", "Release 11"), (2, "A", "TS 24.301", "Rel-9"), (3, "B", "TS 24.301", ""), (4, "B", "TS 36.331", "15")]


def write(spark, base):
    at = dt.datetime(2025, 1, 1)
    spark.createDataFrame([(i, p, t, at) for i, (p, t) in enumerate(TEXTS)], "rec_id bigint, plan_id string, text string, ingested_at timestamp_ntz").write.parquet(f"{base}/requirements.parquet")
    rows = [(i, "m", "r", p, s, rel, at) for i, p, s, rel in REFS]
    spark.createDataFrame(rows, "ref_id bigint, mno string, release string, plan_id string, spec string, spec_release string, ingested_at timestamp_ntz").write.parquet(f"{base}/refs_standards.parquet")
    spark.createDataFrame([], "mno string, release string, plan_id string, referenced_standards_releases map<string,string>, loaded_at timestamp_ntz").write.parquet(f"{base}/plans.parquet")


def test_standards_index_keeps_every_citation(spark, tmp_path):
    write(spark, tmp_path)
    release = {("A", "24.301"): 11, ("B", "36.331"): 15}
    want = {("24.301", 11): [1, set()], ("24.301", 9): [1, set()], ("24.301", 0): [1, set()], ("36.331", 15): [1, set()]}
    n = 0
    for plan, text in TEXTS:
        for pattern, spec, section in PATTERNS:
            for m in re.finditer(pattern, text or ""):
                if len(m[spec]) >= 4:
                    want.setdefault((m[spec], release.get((plan, m[spec]), 0)), [0, set()])[1].add(m[section])
                    n += 1
    got = R.standards_index(spark, str(tmp_path)).collect()
    assert {(r.spec, r.release_num): [r.ref_count, set(filter(None, r.sections.split(",")))] for r in got} == want
    assert sum(r.total_refs - r.ref_count for r in got) == n == 8
    assert want[("24.301", 0)][1] == {"1.1"} and want[("38.101", 0)][1] == {"4.2", "9"} and want[("36.331", 0)][1] == {"6.2", "7"}
