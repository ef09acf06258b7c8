import datetime
import decimal
import json
import io
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.functions.columns import coarse_dtype, fingerprint, normalize_name, unique_names
from tablesmith.functions.infer import infer_types
from tablesmith.operators import mapping, memory, quality, text
from tablesmith.plans.catalog import Catalog, sources_of
from tablesmith.plans.guarded import SqlSession, is_query
from tablesmith.sources import delimited, routing


def test_names():
    assert normalize_name("  Zählbeginn (h) ") == "zählbeginn_h"
    assert normalize_name("--") == "col"
    out = unique_names(["a", "a", "a_1"])
    assert len(set(out)) == 3 and out[0] == "a"


def test_fingerprint_ignores_order():
    a, b = T.StructField("x", T.LongType()), T.StructField("y", T.StringType())
    assert fingerprint(T.StructType([a, b])) == fingerprint(T.StructType([b, a]))
    assert coarse_dtype(T.DecimalType(10, 2)) == "str" and coarse_dtype(T.TimestampNTZType()) == "date"


def test_infer(spark):
    rows = [("1'250", "1", "2024-01-02", "x"), ("2,5", "", "13/02/2024", "1d"), ("€5", "3", "3.4.2025", "1.0f")]
    df = infer_types(spark.createDataFrame(rows, "a string, b string, c string, d string"))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "timestamp", "string"]
    assert [r.a for r in df.collect()] == [1250, 25, 5]
    again = infer_types(df)
    assert again.dtypes == df.dtypes


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "t.csv").write_bytes("TxnID;Betrag CHF;Region\nT-1;1'250.50;Zürich\nT-2;10;Bern;EXTRA\nT-3;7;Genf\n".encode("cp1252"))
    (tmp_path / "two.csv").write_text("Name:;x\nDate:;y\n\na;b\n1;2\n3;4\n\nc;d;e\n1;2;3\n4;5;6\n")
    (tmp_path / ".hidden.csv").write_text("a,b\n1,2\n")
    return str(tmp_path)


def test_delimited(spark, folder):
    raw = delimited.raw_rows(spark, folder)
    tables = {(p.rsplit("/", 1)[1], b): df for (p, b), df in delimited.tables(raw).items()}
    assert set(tables) == {("t.csv", 0), ("two.csv", 1), ("two.csv", 2)}
    txn = tables["t.csv", 0]
    assert txn.dtypes == [("txnid", "string"), ("betrag_chf", "double"), ("region", "string")]
    assert {r.region for r in txn.collect()} == {"Zürich", "Bern | EXTRA", "Genf"}
    assert {r.malformed for r in raw.where("path like '%/t.csv'").collect()} == {1}
    txn.createOrReplaceTempView("txn")
    assert spark.sql("select sum(betrag_chf) from txn").first()[0] == pytest.approx(1267.5)


def test_archives(spark, tmp_path):
    def packed(**files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n, c in files.items():
                z.writestr(n.replace("__", "../"), c)
        return out.getvalue()

    inner = packed(a_csv="x,y\n1,2\n")
    (tmp_path / "one.zip").write_bytes(packed(in_zip=inner))
    (tmp_path / "bad.zip").write_bytes(packed(__x="1"))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r.path.rsplit("/", 1)[1] for r in routing.expand_archives(files).collect()}
    assert got == {"one.zip::in_zip::a_csv", "bad.zip"}
    with pytest.raises(ValueError):
        routing.entries(packed(__x="1"))
    kinds = {r["name"]: r.doc_type for r in routing.described(files).collect()}
    assert kinds == {"one.zip": "archive", "bad.zip": "archive"}


def test_enforce_loses_no_row(spark):
    df = spark.createDataFrame([("s1", "1.5", "a"), (None, "2", "b"), ("s3", "x", "z")], "id string, x string, kind string")
    fields = [quality.Field("id", "str", True), quality.Field("x", "float", True), quality.Field("kind", "str", False, None, ("a", "b")), quality.Field("n", "int")]
    out = quality.conformed(df, fields, {k: {"source": k} for k in ("id", "x", "kind")})
    good, bad = quality.good(out).collect(), quality.quarantine(out).collect()
    assert [(r.id, r.x) for r in good] == [("s1", 1.5)] and len(bad) == 2
    assert {(r.x, *json.loads(r.errors)["errors"]) for r in bad} == {("2", "id: null"), ("x", "x: not float", "kind: not allowed")}


def test_enforce_takes_no_fraction_for_an_integer(spark):
    df = spark.createDataFrame([("1",), ("1.5",), ("x",), (None,), ("2.0",), (" 3 ",), ("12345678901",), ("1e30",)], "v string")
    nullable = [quality.Field("n", "int")]
    out = quality.conformed(df, nullable, {"n": {"source": "v"}})
    assert [r.n for r in quality.good(out).collect()] == [1, None, 2, 3, 12345678901]
    assert [r.n for r in quality.quarantine(out).collect()] == ["1.5", "x", "1e30"]
    big = spark.createDataFrame([(2.0e7,), (0.5,), (None,)], "v double")
    held = quality.conformed(big, [quality.Field("n", "int", True)], {"n": {"source": "v"}})
    assert [r.n for r in quality.good(held).collect()] == [20_000_000] and quality.quarantine(held).count() == 2
    scaled = quality.conformed(df.where("v in ('1', 'x')"), [quality.Field("n", "float")], {"n": {"source": "v", "scale": 2.5}})
    assert [r.n for r in quality.good(scaled).collect()] == [2.5] and [r.n for r in quality.quarantine(scaled).collect()] == ["x"]
    assert quality.good(quality.conformed(df, [quality.Field("b", "bool"), quality.Field("c", "str")], {"c": {"const": "k"}})).distinct().collect() == [(None, "k")]


def test_drift(spark):
    old = spark.createDataFrame([(1, 1.0), (2, 2.0)], "a bigint, b double")
    new = spark.createDataFrame([(1, None, 1), (9, None, 2)], "a bigint, b double, c int")
    got = {(r.column, r.issue) for r in quality.drift(quality.profile(new), quality.contracts(quality.profile(old))).collect()}
    assert got == {("a", "out_of_range"), ("b", "null_ratio"), ("c", "new_column")}


def test_profile_counts_distinct_values_of_every_type_by_narrow_rows(spark):
    schema = "a bigint, `b.c` int, f float, d double, s string, t string, ok boolean, day date, n decimal(9, 2), l array<int>, r struct<x: int>, none string"
    day, cents = datetime.date(2024, 1, 2), decimal.Decimal
    rows = [
        (1, 1, 0.5, 0.0, "x", "1", True, day, cents("1.50"), [1], (1,), None),
        (2, 1, 0.5, -0.0, "X", "1", False, None, cents("1.5"), [1, 2], (1,), None),
        (None, 2, None, float("nan"), "", None, None, day, None, None, None, None),
        (9007199254740993, 1, 0.1, float("nan"), "x", "2", True, day, cents("2"), [1], (None,), None),
        (9007199254740992, 1, 0.1, 0.1, None, "2", True, day, cents("2"), [], (2,), None),
    ]
    df = spark.createDataFrame(rows, schema)
    got = quality.profile(df)
    want = df.agg(*[F.count_distinct(F.col(f"`{c}`")) for c in df.columns]).first()
    assert [(r.column, r.distinct) for r in got.collect()] == list(zip(df.columns, want)) and tuple(want)[-1] == 0
    assert [(r.rows, r.nulls, r.distinct, r.lo) for r in quality.profile(df.limit(0)).collect()] == [(0, 0, 0, None)] * 12
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "HashAggregate(keys=[i" in plan


def test_contracts_and_drift_take_the_narrow_profile(spark):
    known = quality.contracts(quality.profile(spark.createDataFrame([(1, "x", 2.0), (3, "x", None)], "a int, s string, d double")))
    found = quality.drift(quality.profile(spark.createDataFrame([(9, 1.0)], "a int, s double")), known)
    assert all("Expand" not in df._jdf.queryExecution().executedPlan().toString() for df in (known, found))
    assert [tuple(r) for r in known.collect()] == [("a", "int", 0.15, 0.0, 4.0), ("s", "str", 0.15, None, None), ("d", "float", 0.65, 1.0, 3.0)]
    assert {tuple(r) for r in found.collect()} == {("a", "out_of_range"), ("s", "dtype_changed"), ("d", "missing_column")}


def test_links_by_values_move_no_column_to_one_task(spark):
    a = spark.createDataFrame([(i, f" K{i} ", i % 3, None if i % 2 else "x") for i in range(40)], "k int, name string, few int, gap string")
    b = spark.createDataFrame([(i, f"k{i}", None) for i in range(10, 50)], "id bigint, label string, nothing string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        values = memory.column_values("a", a, a.columns, None).unionByName(memory.column_values("b", b, b.columns, None))
        assert "SortMergeJoin" not in values._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(r.tbl, r.col): r.n for r in values.groupBy("tbl", "col").agg(F.count("*").alias("n")).collect()} == {("a", "k"): 40, ("a", "name"): 40, ("b", "id"): 40, ("b", "label"): 40}
    assert sorted(map(tuple, memory.value_links(values).collect())) == [("a", "k", "b", "id", 0.6), ("a", "name", "b", "label", 0.6)]


def test_chunks_match_a_plain_fold(spark):
    body = "\n\n".join("p%d " % i + "x" * (i * 37 % 900) for i in range(40))
    got = [r.chunk for r in text.chunks(spark.createDataFrame([(1, body), (2, None)], "doc_id int, text string")).orderBy("chunk_no").collect()]
    buf, want = "", []
    for p in body.split("\n\n"):
        if buf and len(buf) + 2 + len(p) > text.CHUNK_CHARS:
            want.append(buf)
            buf = p
        else:
            buf = f"{buf}\n\n{p}" if buf else p
    assert got == [*want, buf]


def test_ledger():
    book = memory.Ledger()
    for i in range(5):
        book.append(kind="ingest", n=i, ä="ü")
    assert memory.first_break(book.lines) is None
    bad = list(book.lines)
    bad[2] = bad[2].replace('"n":2', '"n":7')
    assert memory.first_break(bad) == 2
    assert memory.first_break(book.lines[:2] + book.lines[3:]) == 2


def test_guard(spark):
    s = SqlSession(spark)
    s.register("some nation", spark.range(3))
    assert is_query(spark, "SELECT 'drop table t'") and is_query(spark, "WITH q AS (SELECT 1 a) SELECT * FROM q")
    for bad in ("DROP TABLE some_nation", "CREATE TABLE x AS SELECT 1", "INSERT INTO some_nation VALUES (1)", "WITH q AS (SELECT 1) INSERT INTO some_nation SELECT * FROM q", "CREATE TEMP VIEW v AS SELECT 1", "SET a=b"):
        with pytest.raises(ValueError):
            s.run(bad)
    assert s.run("SELECT * FROM some_nation").count() == 3
    assert s.touched("SELECT 'nation' FROM some_nation n") == {"some_nation"}


def test_name_ratio_is_asymmetric():
    assert memory.name_ratio("tide", "diet") == 0.25 and memory.name_ratio("diet", "tide") == 0.5


def test_guard_takes_only_queries_over_registered_tables(spark):
    s = SqlSession(spark)
    one = spark.createDataFrame([(1, "a")], "k int, v string")
    assert [s.register(n, one) for n in ("a/x", "a.x", "b")] == ["a_x", "a_x_2", "b"]
    good = ["SELECT * FROM b", "WITH q AS (SELECT k FROM b) SELECT * FROM q JOIN a_x USING (k)", "SELECT k FROM b WHERE k IN (SELECT k FROM a_x_2) AND EXISTS (SELECT 1 FROM a_x)", "SELECT explode(array(1, 2)) AS e", "SELECT k, sum(k) OVER (ORDER BY k) FROM b", "SELECT * FROM range(3)", "VALUES (1)", "SELECT v, count(*) FROM b GROUP BY ALL HAVING count(*) > 0 ORDER BY 1 LIMIT 3", "SELECT 'drop table b; reflect(1)' AS t"]
    for q in good:
        s.run(q).collect()
    bad = ["SELECT reflect('java.util.UUID', 'randomUUID')", "SELECT java_method('java.util.UUID', 'randomUUID')", "SELECT * FROM (SELECT try_reflect('java.util.UUID', 'randomUUID'))", "SELECT * FROM text.`/etc/hostname`", "SELECT k FROM b WHERE k = (SELECT max(value) FROM text.`/etc/hostname`)", "SELECT * FROM other", "WITH q AS (SELECT * FROM parquet.`/x`) SELECT * FROM q", "DROP VIEW b", "CREATE TABLE z AS SELECT 1", "INSERT INTO b VALUES (1, 'x')", "SET a = b", "SHOW TABLES", "DESCRIBE b", "CACHE TABLE b", "SELECT builtin.reflect('a', 'b')", "BEGIN SELECT 1; END"]
    for q in bad:
        with pytest.raises(Exception) as e:  # noqa: PT011
            s.run(q)
        assert isinstance(e.value, ValueError) or "PARSE" in str(e.value), q
    assert s.touched("WITH b2 AS (SELECT * FROM b) SELECT * FROM b2") == {"b"}


def test_closure_of_deep_and_cyclic_graphs(spark):
    edges = [(i, i + 1) for i in range(7)] + [(10, 11), (11, 12), (12, 10), (20, 21), (20, 22), (21, 23), (22, 23), (None, 1)]
    got = {(r.src, r.dst): r.depth for r in memory.closure(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    want = {}
    for s in {a for a, _ in edges if a is not None}:
        front, d = {s}, 0
        while front:
            d += 1
            front = {b for a, b in edges if a in front and (s, b) not in want}
            want |= {(s, b): d for b in front}
    assert got == want and got[0, 7] == 7 and got[10, 10] == 3


def test_targets_of_both_forms(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("name: sales\ncolumns:\n- {name: id, dtype: int, required: true}\n- {name: cur, allowed: [CHF, EUR], unit: money, description: the currency}\n")
    (tmp_path / "b.yaml").write_text("{broken: [")
    (tmp_path / "c.yml").write_text("kind: DataContract\nid: Big Orders\nversion: 2\nschema:\n- name: o\n  properties:\n  - {name: id, logicalType: integer, primaryKey: true, businessName: Number}\n  - {name: s, logicalType: string, required: true, quality: [{rule: validValues, validValues: [a, b]}], customProperties: [{property: unit, value: kg}]}\ncustomProperties: [{property: on_drift, value: freeze}]\n")
    (tmp_path / "d.yml").write_text("name: old\nstatus: retired\ncolumns: [{name: x}]\n")
    t = mapping.targets(tmp_path)
    assert list(t) == ["sales", "big_orders"]
    assert t["sales"].fields == (quality.Field("id", "int", True), quality.Field("cur", "str", False, None, ("CHF", "EUR"), "money", "the currency"))
    big = t["big_orders"]
    assert (big.version, big.on_drift, big.form) == ("2", "freeze", "odcs")
    assert big.fields == (quality.Field("id", "int", True, True, (), "", "", "Number"), quality.Field("s", "str", True, False, ("a", "b"), "kg"))
    assert mapping.target(mapping.contract_document(big)) == big
    assert mapping.target({"name": "x"}) is None and mapping.target([1]) is None
    p = mapping.sanitized({"mapping": {"id": "k", "s": {"source": "gone"}, "zz": "k", "cur": {"const": 1, "bad": 2}}, "confidence": 0.9}, t["sales"], ["k"])
    assert p == {"target": "sales", "mapping": {"id": {"source": "k"}, "cur": {"const": 1}}, "confidence": 0.9}
    assert mapping.sanitized({"mapping": {"cur": "k"}, "confidence": 0.9}, t["sales"], ["k"])["confidence"] == 0.4


def test_file_types_by_content(spark):
    packed = lambda **e: routing.as_zip({n: b"x" for n in e})
    book, text = packed(**{"xl/workbook.xml": "x"}), "é" * 3000
    files = {"a.bin": (book, "xlsx"), "b": (packed(**{"word/document.xml": "x"}), "office"), "c.zip": (packed(readme="x"), "archive"), "d.doc": (b"\xd0\xcf\x11\xe0..", "office"), "e.xls": (b"\xd0\xcf\x11\xe0..", "xls-legacy"), "f.mtx": (b"1", "visum-matrix"), "g.dbf": (b"1", "shapefile-part"), "h.DAT": (b"1", "txt"), "i": (text.encode(), "txt"), "j": (b"\xff\xfe\x00\x01", "unknown"), "k.exe": (b"abc", "unknown"), "l.tsv": (b"a", "csv"), "m.txt": (b"%PDF-1", "pdf"), "n.d/o": (b"plain", "txt")}
    df = spark.createDataFrame([(p, bytearray(c)) for p, (c, _) in files.items()], "path string, content binary")
    assert {r.path: r.doc_type for r in routing.described(df).collect()} == {p: k for p, (_, k) in files.items()}
    assert {r.path for r in routing.expand_archives(df).collect()} == {*files} - {"c.zip"} | {"c.zip::readme"}


def test_encodings():
    russian, greek, german, polish = "Счёт за услуги; Москва; июнь", "Λογαριασμός; Αθήνα; Ιούνιος", "Zählung; Straße; Größe", "plain"
    assert delimited.decode(german.encode("cp1252")) == (german, "cp1252")
    assert delimited.decode(("\ufeff" + german).encode("utf-8"))[0] == german
    for name in ("utf-16", "utf-16-le", "utf-16-be"):
        assert delimited.decode((german * 4).encode(name))[0] == german * 4
    assert delimited.decode((russian * 20).encode("cp1251")) == (russian * 20, "cp1251")
    assert delimited.decode((russian * 20).encode("koi8-r")) == (russian * 20, "koi8-r")
    assert delimited.decode((greek * 20).encode("cp1253")) == (greek * 20, "cp1253")
    assert delimited.decode(b"") == ("", "utf-8-sig") and delimited.decode(polish.encode())[0] == polish


def test_quotes_and_what_stands_beside_tables(spark):
    assert delimited.quote("a;'b;c'\n'd';e\n", ";") == "'" and delimited.quote('a,"b, c"\n', ",") == '"' and delimited.quote("it's,that's\n", ",") == '"'
    body = "Yearly report\n\nName:;North\nYear:;2020\n\nid;note\n1;'x;y'\n2;'z'\n"
    files = spark.createDataFrame([("r.csv", bytearray(body.encode()))], "path string, content binary")
    rows = delimited.parsed(files).orderBy("row_no").collect()
    assert [list(r.cells) for r in rows] == [["1", "x;y"], ["2", "z"]] and rows[0].block == 2 and rows[0].header == ["id", "note"]
    assert [(r.loc, r.chunk) for r in delimited.texts_beside(files).collect()] == [("block 0", "Yearly report"), ("block 1", "Name:;North\nYear:;2020")]


def test_catalog_calls(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    c.append("documents", [{"doc_id": d, "project": p, "filename": f"{d}.csv", "status": "ingested"} for d, p in (("d1", "p"), ("d2", "p"), ("d3", "q"))])
    c.append("tables", [{"table_id": "t1", "doc_id": "d1", "project": "p", "name": "sales"}])
    c.append("canonicals", [{"canonical_id": f"c{i}", "target": "orders", "table_id": f"t{i}", "n_rows": i} for i in (1, 2)])
    c.append("lineage", [{"output_kind": "table", "output_id": "t1", "relation": "extracted_from", "input_kind": "document", "input_id": "d1", "project": "p"}, {"output_kind": "canonical", "output_id": "c1", "relation": "mapped_from", "input_kind": "table", "input_id": "t1", "project": "p"}])
    for kind, entity, n in (("table", "t1", 2), ("table", "t1", 1), ("document", "d2", 1), ("canonical", "c1", 5), ("other", "z", 1)):
        c.use(kind, entity, n)
    assert [(r.display, r.uses) for r in c.top_uses().collect()] == [("orders", 5), ("sales", 3), ("d2.csv", 1), ("z", 1)] and c.top_uses(2).count() == 2
    assert {r.project for r in c.projects().collect()} == {"p", "q"}
    assert [(r.target, r.n_rows, r.sources) for r in c.canonical_totals().collect()] == [("orders", 3, ["t1", "t2"])]
    c.set_document_meta("d1", "{}")
    assert c.one("documents", doc_id="d1").meta == "{}" and c.one("documents", doc_id="d1").filename == "d1.csv" and c.current("documents").count() == 3
    with pytest.raises(ValueError):
        c.set_document_meta("nope", "{}")
    assert c.lineage_of("t1").count() == 2 and [tuple(r) for r in sources_of(c.current("tables"), c.current("lineage")).collect()] == [("t1", "document", "d1")]
    c.delete("documents", c.current("documents").where("doc_id = 'd3'"))
    c.forget_document("d1")
    assert c.current("documents").count() == 2 and c.current("tables").count() == 0
