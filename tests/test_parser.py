import itertools

import pytest

from reqloom.operators import parser as P


def rows(*blocks):
    out = []
    for i, b in enumerate(blocks):
        b = {"text": b} if isinstance(b, str) else b
        out.append({"idx": i, "page": 1, "type": "paragraph", "text": "", "struck": False, "size": None, "headers": [], "rows": []} | b)
    return out


def table(headers, *body, **more):
    return {"type": "table", "headers": headers, "rows": [list(r) for r in body], **more}


def numbers(sections):
    return [s.number for s in sections if s.number]


def test_sections_attach_in_order():
    s, d, _ = P.parse(rows("before", "1 One", "body a", "body b", "1.1 Sub", table(["h"], ["c"]), {"type": "image"}))
    assert numbers(s) == ["1", "1.1"] and s[0].text == ["body a", "body b"] and len(s[1].tables) == 1 and s[1].images == 1 and d == []


def test_revision_history_without_table():
    s, d, _ = P.parse(rows("1 Chapter", "Revision History", "1.1 Some other section", "body"))
    assert numbers(s) == ["1", "1.1"] and [x[2] for x in d] == ["revision_history"]


def test_revision_history_with_tables():
    s, d, _ = P.parse(rows("1 Chapter", "Revision History", table(["v"], ["1"]), table(["v"], ["2"]), "text", "1.1 Next"))
    assert [x[0] for x in d] == [1, 2, 3] and s[0].text == ["text"] and not s[0].tables


def test_cascade_ends_at_sibling_or_shallower():
    s, d, _ = P.parse(rows("1 A", {"text": "1.2 Struck", "struck": True}, "body", table(["x"], ["y"]), "1.2.1 Below", "1.3 Kept"))
    assert numbers(s) == ["1", "1.3"] and [x[0] for x in d] == [1, 2, 3, 4]
    assert [x[2] for x in d] == ["strikeout", *["strikeout_cascade"] * 3]


def test_cascade_to_the_end_and_struck_paragraph():
    s, d, _ = P.parse(rows("1 A", {"text": "1.1 Struck", "struck": True}, "body", "more"))
    assert numbers(s) == ["1"] and len(d) == 3
    s, d, _ = P.parse(rows("1 A", {"text": "gone", "struck": True}, "kept"))
    assert s[0].text == ["kept"] and [x[0] for x in d] == [1]


def test_nested_struck_headings_shallowest_wins():
    s, d, _ = P.parse(rows("1 A", {"text": "1.1 X", "struck": True}, {"text": "1.1.1 Y", "struck": True}, "1.1.2 Z", "1.2 B"))
    assert numbers(s) == ["1", "1.2"]


def test_toc():
    s, d, _ = P.parse(rows("1 A", "Title ........ 47"))
    assert [x[2] for x in d] == ["toc"]


def test_first_number_wins_and_phantoms():
    s, *_ = P.parse(rows("1 First", "body", "1 Second", "more"))
    assert numbers(s) == ["1"] and s[0].title == "First" and s[0].text == ["body", "1 Second", "more"]
    s, *_ = P.parse(rows("1.1 Phantom", "1.1 Real", "body"))
    assert [(x.number, x.title, x.text) for x in s] == [("1.1", "Real", ["body"])]


def test_continuation_after_a_deep_heading():
    s, *_ = P.parse(rows("1 A", "x", "1.1 Behaviour in release", "15 and later", "body"))
    assert numbers(s) == ["1", "1.1"] and s[1].title == "Behaviour in release 15 and later"


def test_requirement_ids():
    s, *_ = P.parse(rows({"text": "NV_REQ_AB_1", "size": 8.0}, "1 A", "1.1 B", {"text": "NV_REQ_AB_2", "size": 8.0}, "see NV_REQ_AB_9", "1.2 C", "inline NV_REQ_AB_3 here"))
    assert [x.req_id for x in s] == ["NV_REQ_AB_1", "NV_REQ_AB_2", "NV_REQ_AB_3"]


def test_table_anchored_requirements():
    t = table(["Req ID", "Description"], ["NV_REQ_A_1", "one"], ["NV_REQ_A_2", "two"], ["x", "NV_REQ_A_3"], ["NV_REQ_A_1", "again"])
    s, *_ = P.parse(rows("1.6 Some Section", t, {"text": "NV_REQ_A_2 gone", "struck": True}))
    kids = [(x.req_id, x.text[0], x.title) for x in s if x.merged]
    assert kids == [("NV_REQ_A_1", "Req ID: NV_REQ_A_1; Description: one", "1.6"), ("NV_REQ_A_3", "Req ID: x; Description: NV_REQ_A_3", "1.6")]
    s, *_ = P.parse(rows("1 A", "NV_REQ_A_1 in a paragraph", t))
    assert [x.req_id for x in s] == ["NV_REQ_A_1", "NV_REQ_A_2", "NV_REQ_A_3"]


def test_definitions():
    *_, terms = P.parse(rows("1 Glossary", "UE - user equipment", "NR: New Radio", "UE - another", table(["Term", "Definition"], ["LTE", "Long Term Evolution"], ["UE", "x"])))
    assert terms == {"UE": "user equipment", "NR": "New Radio", "LTE": "Long Term Evolution"}
    *_, terms = P.parse(rows("1 Acronyms", table(["AB", "first row"], ["CD", "second"])))
    assert terms == {"AB": "first row", "CD": "second"}


@pytest.mark.parametrize(("text", "want"), [("1 A", ("1", "A")), ("1.2.3. Title x", ("1.2.3", "Title x")), ("no", None), ("1 " + "x" * 300, None), ("3 of them are short.", ("3", "of them are short.")), ("3 " + "word " * 20 + "end.", None)])
def test_heading_shape(text, want):
    assert P.heading_of(text, P.Profile()) == want


def test_operator(spark):
    schema = "doc_id string, idx int, page int, type string, text string, struck boolean, size double, headers array<string>, rows array<array<string>>, title string"
    data = [("d", i, 1, "paragraph", t, False, None, None, None, "x") for i, t in enumerate(["1 A", "body", "1.1 B", None])] + [("e", None, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(data, schema)
    got = {(r.doc_id, r.section): r for r in P.parse_sections(df).collect()}
    assert set(got) == {("d", "1"), ("d", "1.1")} and got[("d", "1.1")].parent_section == "1" and got[("d", "1")].text == "body"
    assert P.parse_dropped(df).count() == 0 and P.parse_definitions(df).count() == 0
    assert P.parse_sections(df.limit(0)).count() == 0


def test_runs_of_dropped_blocks_cover_the_counters():
    _, d, _ = P.parse(rows("1 A", {"text": "1.1 S", "struck": True}, "b", "1.2 C", {"text": "x", "struck": True}))
    runs = [list(g) for _, g in itertools.groupby(enumerate(x[0] for x in d), lambda p: p[1] - p[0])]
    assert sum(len(r) for r in runs) == len(d) == 3
