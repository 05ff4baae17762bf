import datetime as dt
import io
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from reqloom.functions import text as X
from reqloom.sources import documents as D
from reqloom.sources import sinks as S

AT = dt.datetime(2025, 3, 1, 12)


def later(m):
    return AT + dt.timedelta(minutes=m)


def test_feedback(spark, tmp_path):
    f = S.FeedbackStore(spark, str(tmp_path))
    f.insert("a", AT, "ask", "q?", "x", [{"req_id": "R1"}], "m", 12)
    f.insert("b", later(1), "lab", "q2?", None)
    f.vote("a", later(2), "up")
    f.vote("a", later(3), None, "took it back")
    got = {r.id: r for r in f.read().collect()}
    assert got["a"].vote is None and got["a"].free_form_feedback == "took it back" and got["b"].vote is None
    assert [r.id for r in f.read().collect()] == ["b", "a"] and [r.id for r in f.read("lab").collect()] == ["b"]
    with pytest.raises(ValueError):
        f.vote("a", AT, "sideways")


def test_metrics(spark, tmp_path):
    m = S.MetricStore(spark, f"{tmp_path}/m")
    m.request(AT, "/ask", 200, 15.5)
    m.stage(AT, "parse", 2.0, rows=7)
    m.model(AT, "small", 500.0, 100)
    m.resource(AT, 3 * 1024**3, 4 * 1024**3, 12.5)
    got = {(r.category, r.name): r for r in m.events.read().collect()}
    assert got[("llm", "tokens_per_second")].value == 200.0 and got[("resource", "memory_gb")].value == 3.0 and got[("resource", "memory_pct")].value == 75.0
    assert got[("request", "latency")].tags == '{"endpoint": "/ask", "status": 200}' and got[("stage", "rows")].value == 7.0


def test_one_of_several_callers_cancels(spark, tmp_path):
    j = S.JobStore(spark, str(tmp_path))
    j.submit("x", AT)
    won = []
    threads = [threading.Thread(target=lambda: won.append(j.cancel("x", later(1)))) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(won) == [False, False, False, True]
    assert j.states().first().status == "cancelled" and not j.cancel("x", later(2))


def test_front_matter_and_round_trip(spark, tmp_path):
    rows = [("p", i, k, t, None) for i, (k, t) in enumerate([("paragraph", "3GPP TS 24.301 V11.14.0 (2014-06)"), ("paragraph", "Non-access stratum"), ("paragraph", "(Release 11)"), ("heading", "1\tScope")])]
    rows += [("q", 0, "paragraph", "TS 36.331 V9.2.0", None), ("r", 0, "paragraph", None, None)]
    b = spark.createDataFrame(rows, "path string, idx int, type string, text string, error string")
    got = {r.path: (r.spec, r.version, r.release_num, r.title) for r in D.spec_front_matter(b).collect()}
    assert got == {"p": ("24.301", "11.14.0", 11, "Non-access stratum"), "q": ("36.331", "9.2.0", 9, None)}
    D.save_documents(b.drop("error"), f"{tmp_path}/ir")
    back = D.load_documents(spark, f"{tmp_path}/ir", "idx int, type string, text string")
    assert sorted(map(str, back.collect())) == sorted(map(str, b.drop("error").select("path", "idx", "type", "text").collect()))


def workbook(rows):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda r, c, t: f'<c r="{"ABCDE"[c]}{r + 1}" t="inlineStr"><is><t>{t}</t></is></c>'
    sheet = "".join(f'<row r="{r + 1}">{"".join(cell(r, c, t) for c, t in enumerate(row))}</row>' for r, row in enumerate(rows))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>")
    return out.getvalue()


def test_questions_from_a_workbook(spark, tmp_path):
    path = tmp_path / "q.xlsx"
    path.write_bytes(workbook([["Question", "Expected_Req_IDs"], ["What is it?", "R1, R2,,"], ["And?", ""]]))
    got = [(r.question, r.expected_req_ids) for r in S.read_question_workbook(spark, str(path)).collect()]
    assert got == [("What is it?", ["R1", "R2"]), ("And?", [])]


def test_list_literal(spark):
    df = spark.createDataFrame([("['a', 'b']",), ('["c"]',), ("nothing",), (None,)], "s string")
    assert [r[0] for r in df.select(X.list_literal(F.col("s"))).collect()] == [["a", "b"], ["c"], None, None]
