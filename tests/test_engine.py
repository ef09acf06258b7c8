import json

import pytest

from tablesmith import cli
from tablesmith.engine import Engine, differences
from tablesmith.operators import mapping, quality
from tablesmith.sources.fixtures import document, workbook


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    (d / "customers.csv").write_bytes("Customer ID,Name,Region\nC1,Zoë,North\nC2,Bob,South\nC3,Eve,North\n".encode("latin-1"))
    (d / "transactions.csv").write_bytes("TxnID;CustomerID;Betrag CHF;Text\nT1;C1;1'250.50;a\nT2;C2;10.5;b;X\nT3;C3;7.0;c\n".encode("cp1252"))
    (d / "april.csv").write_text("TxnID;CustomerID;Betrag CHF;Text\nT4;C1;11.5;d\nT5;C2;12.5;e\n")
    cells = {(i, j): v for i, r in enumerate([["Region", "Returns"], ["North", 4], ["South", 5]]) for j, v in enumerate(r)}
    (d / "returns.xlsx").write_bytes(workbook({"S": (cells, [])}))
    (d / "memo.docx").write_bytes(document([["k", "v"], ["a", "1"], ["b", "2"]], ["A memo about rivers."]))
    (d / "note.txt").write_text("A note about rivers and rivers.\n\nThe end.")
    return str(d)


def test_ingest_to_answers(spark, corpus, tmp_path):
    e = Engine(spark, str(tmp_path / "w"), "p")
    r = e.ingest(corpus)
    assert r.documents == 6 and sorted(r.tables) == ["april", "customers", "memo_t1", "returns_s_t1", "transactions"]
    assert e.ingest(corpus).documents == 0
    rows = {t["name"]: t for t in e.tables().collect()}
    assert rows["customers"]["confidence"] == 0.95 and rows["transactions"]["confidence"] == 0.85 and rows["returns_s_t1"]["n_rows"] == 2
    assert {s["seen_count"] for s in e.catalog.seen().collect()} <= {1, 2}
    links = {(x["src_table"], x["src_col"], x["dst_table"], x["dst_col"]): x for x in e.links().collect()}
    assert links["customers", "customer_id", "transactions", "customerid"]["kind"] == "JOINABLE"
    total = e.sql("SELECT c.region, sum(t.betrag_chf) AS s FROM customers c JOIN transactions t ON c.customer_id = t.customerid GROUP BY 1 ORDER BY 1").collect()
    assert [x["region"] for x in total] == ["North", "South"] and total[0]["s"] == pytest.approx(1257.5)
    assert e.search("rivers").first()["score"] == 2
    t = mapping.Target("money", (quality.Field("customerid", "str", True), quality.Field("betrag_chf", "float", True)))
    p = next(x for x in e.propose({"money": t}) if x["target"] == "money" and "betrag_chf" in x["mapping"] and x["confidence"] == 1.0)
    assert not e.propose({"money": t})
    e.decide(p["mapping_id"], "approved")
    assert {x["n_rows"] for x in e.apply({"money": t})} and not e.apply({"money": t})
    assert e.sql("SELECT count(*) AS n FROM canonical_money").first()["n"] >= 2
    checked = e.verify(corpus)
    assert checked["first_break"] is None and "changed" not in checked and checked["ok"] == 5
    text, doc = e.context()
    assert "customers" in text and doc["joins"]
    snap = e.snapshot()
    assert not differences(snap, json.loads(json.dumps(snap))) and differences(snap, {})
    with pytest.raises(ValueError):
        e.decide("none", "approved")
    e.catalog.forget_document(rows["customers"]["doc_id"])
    assert "customers" not in {x["name"] for x in e.tables().collect()}
    assert not any("customers" in k for k in ((x["src_table"], x["dst_table"]) for x in e.links().collect()))


def test_command_line_names():
    p = cli.parser()
    assert p.parse_args(["--root", "x", "ingest", "y", "--force"]).force
    with pytest.raises(SystemExit):
        p.parse_args(["--root", "x", "nonsense"])
