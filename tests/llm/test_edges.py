"""Empty tables, all-null columns and clashing extra columns for every training-data query."""

import pytest

from reqloom.llm import queries

SCHEMAS = {
    "requirements": "rec_id long, req_id string, title string, text string, ingested_at timestamp_ntz, id long, key string, m int, keys int",
    "spec_sections": "sec_id long, text string, piece string, item_id long, start long",
    "metrics": "id long, ts timestamp_ntz, category string, name string, value double, n long, sketch string, day string",
    "test_feedback": "id long, question string, answer string, defect string",
    "documents": "doc_id long, text string, lang string, source string, tokens string, grp int, language string, r string",
    "mix_targets": "mix_id string, source string, target_share double, max_repeats int, rate string",
    "pack_limits": "pack_id string, capacity_tokens int, grp string",
}


def tables(spark, path, rows):
    for name, schema in SCHEMAS.items():
        n = len(schema.split(", "))
        data = [] if rows == "empty" else [(None,) * n] * 3
        if rows == "nulls" and name == "pack_limits":
            data = []
        spark.createDataFrame(data, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module", params=["empty", "nulls"])
def base(request, spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp(request.param), request.param), request.param


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_rows(spark, base, name):
    path, kind = base
    got = queries.QUERIES[name](spark, path).collect()
    if kind == "nulls" and name == "p5_found":
        assert [(r.id, r.defect) for r in got] == [(None, "empty")]
    elif kind == "nulls" and name == "p9_documents":
        assert all(r.language is None for r in got) and len(got) == 3
    elif kind == "nulls" and name == "p9_labels":
        assert all(r.label is None for r in got) and len(got) == 3
    else:
        assert got == []
