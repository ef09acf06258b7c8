import io
import json
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from tablesmith.operators import mapping, parsers, policy, provenance
from tablesmith.plans import model
from tablesmith.plans.guarded import SqlSession
from tablesmith.sources import delimited, ooxml, pages, routing
from tablesmith.sources.fixtures import document, workbook

OVERVIEW = {
    (0, 0): "Sales report",
    (2, 1): "Region", (2, 2): "Q1 2025", (2, 4): "Q2 2025", (3, 2): "Units", (3, 3): "Revenue", (3, 4): "Units", (3, 5): "Revenue",
    **{(4 + i, 1 + j): v for i, r in enumerate([["North", 1, 10, 2, 20], ["South", 3, 30, 4, 40], ["West", 5, 50, 6, 60]]) for j, v in enumerate(r)},
    **{(2 + i, 7 + j): v for i, r in enumerate([["Product", "Price"], ["Nut", 1.5], ["Bolt", 2.25]]) for j, v in enumerate(r)},
    **{(12 + i, 1 + j): v for i, r in enumerate([["Region", "Returns"], ["North", 7], ["South", 9]]) for j, v in enumerate(r)},
}
MERGED = [(0, 0, 0, 5), (2, 1, 3, 1), (2, 2, 2, 3), (2, 4, 2, 5)]


def test_islands():
    rows = list(ooxml.islands("x/sales.xlsx", workbook({"Overview": (OVERVIEW, MERGED), "Empty": ({}, [])})))
    tables = {r[1]: r for r in rows}
    assert list(tables) == [f"sales_overview_t{i}" for i in (1, 2, 3, 4)]
    assert tables["sales_overview_t1"][7] == ["region", "returns"]
    assert tables["sales_overview_t2"][7] == ["product", "price"]
    third = [r for r in rows if r[1] == "sales_overview_t3"]
    assert third[0][7] == ["region", "q1_2025_units", "q1_2025_revenue", "q2_2025_units", "q2_2025_revenue"]
    assert third[0][5] == ["multi_row_header"] and third[0][6][0] == "Overview!B"
    assert [r[9] for r in third] == [["North", "1", "10", "2", "20"], ["South", "3", "30", "4", "40"], ["West", "5", "50", "6", "60"]]
    assert [r[9] for r in rows if r[1] == "sales_overview_t4"] == [["Sales report"] * 6]


def test_boxes_match_a_flood_fill():
    import random

    rng = random.Random(3)
    for _ in range(60):
        filled = sorted({(rng.randrange(9), rng.randrange(9)) for _ in range(rng.randrange(1, 30))})
        left, groups = set(filled), []
        while left:
            todo, seen = [min(left)], set()
            while todo:
                p = todo.pop()
                if p in left:
                    left.remove(p)
                    seen.add(p)
                    todo += [(p[0] + i, p[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
            groups.append(seen)
        out = ooxml.boxes(filled)
        assert all(any(all(b[0] <= r <= b[2] and b[1] <= c <= b[3] for r, c in g) for b in out) for g in groups)
        assert all(a is b or a[2] < b[0] or b[2] < a[0] or a[3] < b[1] or b[3] < a[1] for a in out for b in out)


def test_office(spark):
    data = document([["id", "name"], ["1", "x"], ["2", "y"]], ["Intro.", "More."])
    rows, text = ooxml.office("a/report.docx", data)
    assert [r[9] for r in rows] == [["1", "x"], ["2", "y"]] and rows[0][1] == "report_t1" and text == ["Intro.", "More."]
    files = spark.createDataFrame([("a/report.docx", bytearray(data))], "path string, content binary")
    assert ooxml.office_rows(files).count() == 2
    assert [r.chunk for r in ooxml.office_chunks(files).collect()] == ["Intro.\n\nMore."]


def test_pages(spark):
    rows = [(90, 0.0, 0, "text"), (90, 0.6, 0, "mixed"), (10, 0.6, 0, "scanned"), (10, 0.1, 0, "text"), (0, 0.0, 21, "vector"), (None, None, None, "empty")]
    df = spark.createDataFrame(rows, "c int, v double, d int, want string")
    assert df.where(pages.page_kind(F.col("c"), F.col("v"), F.col("d")) != F.col("want")).count() == 0
    kinds = spark.createDataFrame([(1, "text"), (2, "scanned"), (3, "text")], "doc_id int, kind string")
    need = pages.needs_layout(kinds, spark.createDataFrame([(1,), (2,)], "doc_id int"))
    assert {r.doc_id: r.needs_layout for r in need.collect()} == {1: False, 2: True, 3: True}


def test_markdown(spark):
    body = "intro\n" + "".join(f"## h{i}\n" + "x" * (300 * i % 1700) + "\n" for i in range(12)) + "##### deep\n"
    got = [r.chunk for r in pages.markdown_chunks(spark.createDataFrame([(1, body), (2, None), (3, "")], "doc_id int, text string")).orderBy("chunk_no").collect()]
    assert "".join(got).replace("\n", "") == body.replace("\n", "")
    assert all(c.startswith("## ") for c in got[1:]) and len(got) > 2


def test_mapping_documents(tmp_path):
    (tmp_path / "a.yaml").write_text("name: orders\ncolumns:\n- {name: order_id, dtype: int, required: true}\n- {name: status, allowed: [O, F]}\n")
    (tmp_path / "b.yml").write_text("kind: DataContract\nid: My Parts\nstatus: draft\nschema: [{properties: [{name: p}]}]\n")
    found = mapping.targets(tmp_path)
    assert list(found) == ["orders"] and found["orders"].required == {"order_id"}
    again = mapping.target(mapping.contract_document(found["orders"]))
    assert [(f.name, f.dtype, f.required, f.may_be_null, f.allowed) for f in again.fields] == [(f.name, f.dtype, f.required, f.may_be_null, f.allowed) for f in found["orders"].fields]
    assert mapping.proposed(["orderid", "state", "status"], found)["mapping"] == {"order_id": {"source": "orderid"}, "status": {"source": "status"}}
    assert mapping.proposed(["q"], found) is None and mapping.target({"name": "x"}) is None
    low = mapping.sanitized({"mapping": {"status": "status", "bad": "x", "order_id": "absent"}, "confidence": 0.9}, found["orders"], ["status"])
    assert low["mapping"] == {"status": {"source": "status"}} and low["confidence"] == 0.4


def test_mapping_memory(spark):
    log = spark.createDataFrame([("a", "f", "t", 1, "approved", "{}", 1.0, 1), ("b", "f", "t", 2, "proposed", "{}", 1.0, 2), ("b", "f", "t", 2, "approved", "{}", 1.0, 3)], mapping.MAPPING)
    assert {r.mapping_id: r.status for r in mapping.current(log).collect()} == {"a": "superseded", "b": "approved"}
    prints = spark.createDataFrame([("f",), ("g",)], "fingerprint string")
    assert [r.mapping_id for r in mapping.approved(log, prints).collect()] == ["b"]
    assert [r.fingerprint for r in mapping.without_proposal(log, prints).collect()] == ["g"]
    new = spark.createDataFrame([("f", "t"), ("g", "t")], "fingerprint string, target string")
    assert {r.fingerprint: r.version for r in mapping.next_versions(log, new).collect()} == {"f": 3, "g": 1}


PARSER = """
import json, pathlib
import pyarrow as pa, pyarrow.parquet as pq
src = next(pathlib.Path('IN').iterdir())
rows = [x.split() for x in src.read_text().splitlines()]
pq.write_table(pa.table({'A b': [r[0] for r in rows], 'c': [int(r[1]) for r in rows]}), 'OUT/t.parquet')
tables = [{'name': 'T 1', 'path': 't.parquet'}, {'path': '../parser.py'}, {'path': 'no.parquet'}]
json.dump({'tables': tables}, open('OUT/manifest.json', 'w'))
"""


def test_replay(spark):
    files = spark.createDataFrame([("x/a.log", bytearray(b"u 1\nv 2")), ("x/b.log", bytearray(b"broken"))], "path string, content binary")
    got = parsers.replay(files, PARSER).orderBy("path", "row_no").collect()
    assert [(r.path, r["name"], r.header, r.cells, r.ok) for r in got[:2]] == [("x/a.log", "t_1", ["a_b", "c"], ["u", "1"], True), ("x/a.log", "t_1", ["a_b", "c"], ["v", "2"], True)]
    assert not got[2].ok and "IndexError" in got[2].error
    assert parsers.run_parser(PARSER, "a", b"u 1")["invalid"] == ["../parser.py: outside", "no.parquet: missing"]


def test_parser_matching(spark):
    files = spark.createDataFrame([(1, "ts level 2024 msg\n2025 warn x9"), (2, None)], "file_id int, text string").select("file_id", parsers.head_tokens(F.col("text")).alias("tokens"), parsers.name_pattern(F.lit("log12.txt")).alias("pattern"))
    assert files.where("file_id = 1").first().tokens == ["level", "msg", "ts", "warn", "x#"]
    registry = spark.createDataFrame([("s1", ["level", "msg", "ts"], "log#.txt"), ("s2", ["zz"], "log#.txt"), ("s3", ["level", "msg", "ts", "warn", "x#"], "other"), ("s4", ["level", "msg", "ts", "warn"], "other")], "script_id string, tokens array<string>, pattern string")
    got = [(r.file_id, r.script_id, r.similarity) for r in parsers.matching(files, registry).orderBy("file_id", F.desc("similarity")).collect()]
    assert got == [(1, "s3", 1.0), (1, "s1", 0.8)]


def test_events_and_attestations(spark, tmp_path):
    book = provenance.FileLedger(str(tmp_path / "ledger.jsonl"))
    for i in range(4):
        book.append(ts=f"2026-01-0{i + 1}", kind="ingest", ok=i != 2, project="p", inputs=[{"name": "a", "sha256": "00"}], outputs=[{"name": f"t{i}", "sha256": "11"}] if i else [])
    from tablesmith.operators import memory

    assert memory.first_break(book.lines()) is None and len(book.lines()) == 4
    entries = provenance.read_ledger(spark, book.path)
    events = {r.entry_hash: json.loads(r.event) for r in provenance.run_events(entries, "2026-01-02").collect()}
    assert len(events) == 3 and sorted(e["eventType"] for e in events.values()) == ["COMPLETE", "COMPLETE", "FAIL"]
    assert all(e["run"]["runId"] == str(uuid.uuid5(uuid.NAMESPACE_URL, h)) for h, e in events.items())
    key = provenance.SharedKey(b"k")
    envs = [json.loads(r.envelope) for r in provenance.attest(entries, key).collect()]
    assert len(envs) == 3 and {provenance.opened(e, key)["subject"][0]["name"] for e in envs} == {"t1", "t2", "t3"}
    assert provenance.opened(envs[0], provenance.SharedKey(b"other")) is None


def test_checked(spark):
    rec = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")], "name string, sha256 string")
    here = spark.createDataFrame([("a", "1"), ("b__x", "1"), ("c", "2"), ("d__1", "1"), ("d__2", "1")], "name string, sha256 string")
    assert {r["name"]: r.status for r in provenance.checked(rec, here).collect()} == {"a": "ok", "b": "ok", "c": "changed", "d": "missing"}


def test_policy(spark):
    rows = [("csv", 0.95, 1, True, []), ("script", 0.95, 1, True, ["malformed_rows"]), ("csv", 0.88, 1, True, None), ("csv", 0.95, 1, False, ["other"]), ("agent", 0.9, 0, False, [])]
    df = spark.createDataFrame(rows, "m string, c double, n int, seen boolean, flags array<string>")
    got = df.select(policy.should_verify(F.col("m"), F.col("c"), F.col("n"), F.col("seen"), "auto").alias("v"), policy.should_refine(F.col("flags"), F.lit(None).cast("boolean")).alias("r")).collect()
    assert [r.v for r in got] == [False, True, True, True, False] and [r.r for r in got] == [False, True, False, False, False]


class Scripted:
    available = True

    def __init__(self, *replies):
        self.replies = list(replies)

    def complete(self, prompt, system=""):
        return self.replies.pop(0)


def test_ask(spark):
    s = SqlSession(spark)
    s.register("numbers", spark.range(3))
    m = Scripted('```json\n{"sql": "SELECT sum(id) AS s FROM numbers"}\n```', '{"sql": "DROP TABLE numbers"}', "no json", 'so: {"answer": "3"} done')
    out = model.ask(m, s, "sum?", "numbers")
    assert (out.text, out.queries, out.tables) == ("3", ["SELECT sum(id) AS s FROM numbers"], {"numbers"})
    assert model.ask(model.NullModel(), s, "?", "").text == ""
    with pytest.raises(ValueError):
        model.json_in("nothing")


def test_as_zip_round_trip():
    with zipfile.ZipFile(io.BytesIO(routing.as_zip({"b": b"2", "a": b"1"}))) as z:
        assert z.namelist() == ["a", "b"] and z.read("b") == b"2"


def _largest_frame(table, files):
    """The most rows in one frame that a step of mapInPandas gives for ``files`` as one batch, and all its rows."""
    import pandas as pd

    class Held:
        def select(self, *_):
            return self

        def mapInPandas(self, run, _):
            return list(run(iter([pd.DataFrame(files, columns=["path", "content"])])))

    frames = table(Held())
    return max(map(len, frames)), pd.concat(frames)


def test_rows_of_many_files_are_never_held_together():
    csvs = [(f"d/{i:03d}.csv", ("key;name\n" + "".join(f"{i};row {j} of a file\n" for j in range(500))).encode()) for i in range(200)]
    most, rows = _largest_frame(delimited.parsed, csvs)
    assert most < 20_000 and len(rows) == 100_000 and rows.groupby("path").row_no.max().eq(499).all()
    inner = routing.as_zip({"a.csv": b"k;v\n" + b"1;x\n" * 100_000})
    most, rows = _largest_frame(routing.expand_archives, [(f"d/{i}.zip", inner) for i in range(20)])
    assert most < 10 and sorted(rows.path) == sorted(f"d/{i}.zip::a.csv" for i in range(20))


def test_ragged_rows_and_open_quotes_stay_as_read():
    _, rows = _largest_frame(delimited.parsed, [("a.csv", b'a,b,c\n1,2,3\n\n ,, \nx,y,z\n4,5\n6,7,8,9\n10,"two\nlines",11\n12,13,"open\n'), ("b.csv", b""), ("c.csv", b"1,2\n3,4\n")])
    got = [tuple(r) for r in rows[["path", "block", "row_no", "header", "cells", "malformed"]].itertuples(index=False)]
    assert [r[4] for r in got if r[0] == "c.csv"] == [["1", "2"], ["3", "4"]] and not [r for r in got if r[0] == "b.csv"]
    assert [r for r in got if r[0] == "a.csv"] == [
        ("a.csv", 0, 0, ["a", "b", "c"], ["1", "2", "3"], 0),
        ("a.csv", 1, 0, ["x", "y", "z"], ["4", "5", None], 2),
        ("a.csv", 1, 1, ["x", "y", "z"], ["6", "7", "8 | 9"], 2),
        ("a.csv", 1, 2, ["x", "y", "z"], ["10", "two\nlines", "11"], 2),
        ("a.csv", 1, 3, ["x", "y", "z"], ["12", "13", "open"], 2),
    ]
