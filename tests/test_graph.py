"""Hops over a chain of plans that is longer than any fixed number of steps."""

import datetime as dt

from reqloom.operators import graph as G

AT = dt.datetime(2025, 1, 1)


def test_hops_reach_the_end_of_a_long_chain(spark, tmp_path):
    n = 6
    name = lambda i: (f"M{i}", "r", f"P{i}")
    write = lambda rows, schema, t: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{t}.parquet")
    plan = "mno string, release string, plan_id string"
    # requirement i belongs to plan i and depends on plan i + 1: two hops from plan to plan; plan X is on its own
    write([(*name(i), {}, AT) for i in range(n)] + [("X", "r", "X", {}, AT)], f"{plan}, referenced_standards_releases map<string,string>, loaded_at timestamp_ntz", "plans")
    write([(i, *name(i), f"R{i}", None, "t", "x", "1") for i in range(n)], f"rec_id bigint, {plan}, req_id string, parent_req_id string, title string, text string, section_number string", "requirements")
    write([(i, *name(i), f"R{i}", f"P{i + 1}") for i in range(n - 1)], f"ref_id bigint, {plan}, source_req_id string, target_plan_id string", "refs_cross_plan")
    write([], f"ref_id bigint, {plan}, source_req_id string, target_req_id string", "refs_internal")
    write([], f"ref_id bigint, {plan}, source_req_id string, spec string, spec_section string, spec_release string", "refs_standards")
    got = {r.id: r.hops for r in G.hops_from(spark, str(tmp_path)).collect()}
    assert got == {f"plan:M{i}:r:P{i}": 2 * i for i in range(n)}
