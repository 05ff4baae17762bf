import datetime as dt
import json
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from reqloom.plans import pipeline as L
from reqloom.sources import documents as D
from reqloom.sources import sinks as S
from reqloom.sources.tables import Scratch

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(path, body):
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")


def para(text, style=None, strike=False, before=""):
    return f'<w:p>{f"""<w:pPr><w:pStyle w:val="{style}"/></w:pPr>""" if style else ""}<w:r>{"<w:rPr><w:strike/></w:rPr>" if strike else ""}{before}<w:t>{text}</w:t></w:r></w:p>'


def xlsx(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda r, t, s=0: f'<c r="{r}" t="inlineStr" s="{s}"><is><t>{t}</t></is></c>'
    sheet = f'<worksheet {ns}><sheetData><row r="1"><c r="A1"/></row><row r="2">{cell("A2", "Field")}{cell("B2", "Value")}</row><row r="3">{cell("A3", "x", 1)}{cell("B3", "old", 1)}</row><row r="4">{cell("A4", "y", 1)}{cell("C4", "new")}</row></sheetData></worksheet>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Cover" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><fonts><font/><font><strike/></font></fonts><cellXfs><xf fontId="0"/><xf fontId="1"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)


def test_read_blocks(spark, tmp_path):
    root = tmp_path / "input" / "nva" / "2025_jun"
    docx(root / "a.docx", para("1 Scope", "Heading1") + para("body") + para("gone", strike=True) + "<w:tbl><w:tr><w:tc>" + para("A") + "</w:tc><w:tc>" + para("B") + "</w:tc></w:tr><w:tr><w:tc>" + para("1") + "</w:tc><w:tc>" + para("2") + "</w:tc></w:tr></w:tbl>" + para("next", before='<w:br w:type="page"/>'))
    xlsx(root / "b.XLSX")
    (root / "c.json").write_text(json.dumps({"content_blocks": [{"type": "paragraph", "text": "second", "position": {"page": 2, "index": 1}}, {"type": "heading", "text": "first", "level": 1, "position": {"page": 1, "index": 0}}]}))
    (root / "bad.docx").write_bytes(b"no zip")
    (root / "d.txt").write_text("one\n\ntwo\fthree\n")
    (root / "e.pdf").write_bytes(b"%PDF")
    (root / "skip.bin").write_bytes(b"x")
    rows = sorted(D.read_blocks(spark, str(tmp_path)).collect(), key=lambda r: (r.path, r.idx or 0))
    by = {}
    for r in rows:
        by.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    assert set(by) == {"a.docx", "b.XLSX", "c.json", "bad.docx", "d.txt", "e.pdf"}
    assert [(r.type, r.page, r.struck) for r in by["a.docx"]] == [("heading", 1, False), ("paragraph", 1, False), ("paragraph", 1, True), ("table", 1, False), ("paragraph", 2, False)]
    assert by["a.docx"][3].headers == ["A", "B"] and by["a.docx"][3].rows == [["1", "2"]] and by["a.docx"][0].level == 1
    assert by["b.XLSX"][1].headers == ["Field", "Value"] and by["b.XLSX"][1].rows == [["y", "", "new"]]
    assert [r.text for r in by["c.json"]] == ["first", "second"]
    assert [(r.text, r.page) for r in by["d.txt"]] == [("one", 1), ("two", 1), ("three", 2)]
    assert by["bad.docx"][0].error and by["e.pdf"][0].error and by["bad.docx"][0].idx is None
    assert {(r.mno, r.release) for r in rows} == {("NVA", "2025_jun")}
    cols = D.path_metadata_columns(F.col("path"))
    assert {tuple(r) for r in D.read_blocks(spark, str(tmp_path)).select(*cols).collect()} == {("NVA", "2025_jun")}
    assert [r.size for r in D.listing(spark, str(root)).where("path like '%skip.bin'").collect()] == ["1 B"]


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"f{i}.txt").write_text(f"line {i}\nmore\n")
    q = D.stream_blocks(spark, str(tmp_path / "in")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((r.path, r.idx, r.text) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(D.read_blocks(spark, str(tmp_path / "in")))


def test_spec_sections(spark, tmp_path):
    docx(tmp_path / "s.docx", para("front") + para("1\tScope", "Heading1") + para("text a") + para("text b") + para("Annex A Extra", "Heading1") + para("note"))
    got = [(r.number, r.title, r.text) for r in D.spec_sections(D.read_blocks(spark, str(tmp_path))).orderBy("sec").collect()]
    assert got == [("1", "Scope", "text a\ntext b"), ("Annex A", "Extra", "note")]


def test_graphml_is_well_formed(spark, tmp_path):
    n = spark.createDataFrame([("a&b", "x<y", ["l1"]), ("c", None, None)], "id string, title string, labels array<string>")
    e = spark.createDataFrame([("a&b", "c", "t")], "src string, dst string, kind string")
    S.write_graphml(n, e, str(tmp_path / "g"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "g").glob("part-*")))
    g = ElementTree.fromstring(text)
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    assert {x.get("id") for x in g.iter(f"{ns}node")} == {"a&b", "c"} and len(list(g.iter(f"{ns}edge"))) == 1
    S.write_node_link(n, e, str(tmp_path / "nl"))
    assert spark.read.json(str(tmp_path / "nl/links")).columns == ["kind", "source", "target"]


def test_questions_and_audit(spark, tmp_path):
    (tmp_path / "q.csv").write_text('ID,Question,Expected_Plans\nq1,what?," A, B ,,"\nq2,why?,\n')
    got = {r.id: r.expected_plans for r in S.read_questions(spark, str(tmp_path / "q.csv")).collect()}
    assert got == {"q1": ["A", "B"], "q2": []}
    S.write_audit_csv(spark.createDataFrame([("d", "1.1")], "doc string, section string"), str(tmp_path / "a"))
    assert spark.read.option("header", True).csv(str(tmp_path / "a")).columns == ["doc", "section", "correct_section", "reviewer_note"]


def test_job_store(spark, tmp_path):
    j = S.JobStore(spark, str(tmp_path / "jobs"))
    t = lambda h: dt.datetime(2025, 1, 1) + dt.timedelta(hours=h)
    assert j.states().count() == 0 and not j.cancel("a", t(0))
    j.submit("a", t(0))
    j.update("a", t(1), "running", 10)
    assert j.cancel("a", t(2)) and not j.cancel("a", t(3))
    j.update("a", t(4), "completed", 100)  # a late worker does not change a cancelled job
    j.submit("b", t(30))
    s = {r.job_id: r for r in j.states().collect()}
    assert s["a"].status == "cancelled" and s["a"].started_at == t(1) and s["a"].completed_at == t(2) and s["b"].status == "submitted"
    with pytest.raises(ValueError):
        j.update("b", t(31), "odd")
    j.log("a", t(1), ["x", "y"])
    j.log("a", t(2), ["z"])
    assert [(r.line_number, r.message) for r in j.lines("a", 1).orderBy("line_number").collect()] == [(2, "y"), (3, "z")]
    assert j.events.retain(t(24)) == 1 and {r.job_id for r in j.states().collect()} == {"b"}


def test_event_store_latest(spark, tmp_path):
    f = S.EventStore(spark, str(tmp_path / "f"), "id long, ts timestamp_ntz, seq long, vote string")
    f.append([(1, dt.datetime(2025, 1, 1), 0, "up"), (2, dt.datetime(2025, 1, 1), 0, None)])
    f.append([(1, dt.datetime(2025, 1, 1), 1, None)])
    assert {r.id: r.vote for r in f.latest("id").collect()} == {1: None, 2: None}


def test_corrections_win(spark):
    out = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    fix = spark.createDataFrame([(2, "B", "x"), (3, "C", "y")], "k int, v string, why string")
    assert sorted(tuple(r) for r in S.with_corrections(out, fix, "k").collect()) == [(1, "a"), (2, "B"), (3, "C")]


def test_pipeline(spark, tmp_path):
    def bad(s, b):
        raise RuntimeError("no")

    stages = {"a": lambda s, b: {"t": s.range(3)}, "b": bad, "c": lambda s, b: {"u": s.range(2)}}
    r = L.run(spark, "", str(tmp_path), stages)
    assert [(o.stage, o.status, o.code) for o in r] == [("a", "OK", ""), ("b", "FAIL", "PIP-E001")]
    r = L.run(spark, "", str(tmp_path), stages, continue_on_error=True)
    assert [o.status for o in r] == ["OK", "FAIL", "OK"] and r[2].rows == {"u": 2}
    assert "PIP-E001" in L.report(r)
    assert L.stage_range(["a", "b", "c"], "b") == ["b", "c"] and L.stage_range(["a", "b", "c"], skip=["b"]) == ["a", "c"]
    for args in (("c", "a"), ("x", None)):
        with pytest.raises(ValueError):
            L.stage_range(["a", "b", "c"], *args)
    assert L.layered(None, "", 0, 5) == 0
    assert L.map_path("C:\\Docs\\x\\y.pdf", [("c:/docs", "/data")]) == "/data/x/y.pdf" and L.inside("/data/x/../y", ["/data"]) and not L.inside("/data/../etc", ["/data"])


def test_scratch_cleans_up(spark):
    tmp = Scratch(spark)
    df = tmp.save(spark.range(3))
    assert df.count() == 3
    where = list(tmp._where.values())[0]
    tmp.drop(df)
    assert not tmp._fs.exists(tmp._path(where))
