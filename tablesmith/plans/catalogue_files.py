"""Registered queries of the file formats, policies, mappings, parsers and provenance.

The files are made from the driver's tables, a bounded number of rows each, so
that reading them back must give the tables again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import mapping, parsers, policy, provenance
from ..operators.quality import Field
from ..sources import delimited, ooxml, pages, routing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
ROWS_A_FILE = 500


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


FILE = "path string, content binary"


def _customer_files(spark: SparkSession, sf: str, ending: str, build: Callable) -> DataFrame:
    """A file for each ROWS_A_FILE customers; ``build`` makes it from rows of (key, name, balance)."""

    def make(key, pdf):
        import pandas as pd

        rows = [(int(k), str(n), repr(float(b))) for k, n, b in zip(pdf["c_custkey"], pdf["c_name"], pdf["c_acctbal"], strict=True)]
        return pd.DataFrame({"path": [f"customers/{key[0]}.{ending}"], "content": [build(rows)]})

    c = t(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", F.floor(F.col("c_custkey") / ROWS_A_FILE).alias("file"))
    return c.groupBy("file").applyInPandas(make, FILE)


def _csv(rows: list[tuple]) -> bytes:
    return ("Customer Key;Name;Balance\n" + "".join(f"{k};{n};{b}\n" for k, n, b in rows)).encode("cp1252")


def _workbook(rows: list[tuple]) -> bytes:
    from ..sources.fixtures import workbook

    grid = [("Customer Key", "Name", "Balance"), *[(k, n, float(b)) for k, n, b in rows]]
    cells = {(2 + i, 1 + j): v for i, r in enumerate(grid) for j, v in enumerate(r)} | {(0, 0): "Customers"}
    return workbook({"Customers": (cells, [])})


def _customers(rows: DataFrame) -> DataFrame:
    cell = [F.get("cells", F.lit(i)) for i in range(3)]
    return rows.select(cell[0].cast("bigint").alias("custkey"), cell[1].alias("name"), F.round(cell[2].cast("double"), 4).alias("balance"))


CUSTOMERS = "SELECT c_custkey AS custkey, c_name AS name, round(c_acctbal, 4) AS balance FROM customer"


@query(CUSTOMERS)
def csv_tables(spark, sf):
    return _customers(delimited.parsed(_customer_files(spark, sf, "csv", _csv)))


@query(CUSTOMERS)
def xlsx_islands(spark, sf):
    rows = ooxml.workbook_rows(_customer_files(spark, sf, "xlsx", _workbook))
    return _customers(rows.where(F.size("header") == 3))


@query(CUSTOMERS)
def archive_tables(spark, sf):
    """A workbook's rows as CSV inside an archive inside an archive."""
    nested = _customer_files(spark, sf, "zip", lambda rows: routing.as_zip({"in.zip": routing.as_zip({"a.csv": _csv(rows[::2]), "b.csv": _csv(rows[1::2] or rows[:0])})}))
    files = routing.described(routing.expand_archives(nested)).where("doc_type = 'csv'")
    return _customers(delimited.parsed(files))


@query("SELECT conv_id, role, text FROM conversations")
def office_tables(spark, sf):
    """A text document for each conversation, its turns in a table."""
    from ..sources.fixtures import document

    def make(key, pdf):
        import pandas as pd

        body = document([["Conv", "Role", "Text"], *[[str(key[0]), r, x] for r, x in zip(pdf["role"], pdf["text"], strict=True)]], ["A conversation."])
        return pd.DataFrame({"path": [f"conversations/{key[0]}.docx"], "content": [body]})

    files = t(spark, sf, "conversations").groupBy("conv_id").applyInPandas(make, FILE)
    return ooxml.office_rows(files).select(F.get("cells", F.lit(0)).cast("bigint").alias("conv_id"), F.get("cells", F.lit(1)).alias("role"), F.get("cells", F.lit(2)).alias("text"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity * 4 >= 80 AND l_discount * 10 >= 0.5 THEN 'mixed' WHEN l_quantity * 4 >= 80 THEN 'text' WHEN l_discount * 10 >= 0.5 THEN 'scanned'
WHEN floor(l_quantity / 10) > 0 THEN 'text' WHEN l_suppkey > 20 THEN 'vector' ELSE 'empty' END AS kind FROM (SELECT l_orderkey, l_linenumber, l_suppkey, l_discount, CASE WHEN l_quantity < 10 THEN 0 ELSE l_quantity END AS l_quantity FROM lineitem)""")
def page_kinds(spark, sf):
    """Lines of orders as pages: quantity as letters of text, discount as image coverage, supplier as drawings."""
    return _pages(t(spark, sf, "lineitem")).select("l_orderkey", "l_linenumber", "kind")


def _pages(li: DataFrame) -> DataFrame:
    chars = F.when(F.col("l_quantity") < 10, 0).otherwise(F.col("l_quantity") * 4)
    return li.withColumn("kind", pages.page_kind(chars, F.col("l_discount") * 10, F.col("l_suppkey")))


@query(f"""SELECT l_orderkey AS doc_id, (bool_or(kind IN ('scanned', 'vector')) OR NOT bool_or(done)) AND count(*) <= 40 AS needs_layout
FROM ({SQL["page_kinds"]}) JOIN (SELECT o_orderkey, o_orderstatus = 'F' AS done FROM orders) ON o_orderkey = l_orderkey GROUP BY 1""")
def layout_escalation(spark, sf):
    p = _pages(t(spark, sf, "lineitem")).select(F.col("l_orderkey").alias("doc_id"), "kind")
    return pages.needs_layout(p, t(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_id")))


@query(r"""
WITH RECURSIVE m AS (SELECT page_id AS doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<h[1-4][^>]*>', chr(10) || '# ', 'g'), '<[^>]*>', ' ', 'g'), '(?m)^(#{1,4} )', chr(1) || '\1', 'g'), chr(1)) AS ps FROM pages),
r AS (SELECT doc_id, 1 AS i, 0 AS no, ps[1] AS buf FROM m
  UNION ALL SELECT r.doc_id, i + 1, CASE WHEN length(buf) + length(ps[i + 1]) <= 2500 THEN no ELSE no + 1 END, CASE WHEN length(buf) + length(ps[i + 1]) <= 2500 THEN buf || ps[i + 1] ELSE ps[i + 1] END
  FROM r JOIN m ON m.doc_id = r.doc_id WHERE i < len(ps)),
c AS (SELECT doc_id, no, regexp_replace(arg_max(buf, i), '^\s+|\s+$', '', 'g') AS chunk FROM r GROUP BY doc_id, no)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS INTEGER) AS chunk_no, chunk FROM c WHERE chunk <> ''""")
def markdown_chunks(spark, sf):
    """Pages with their headings in markdown."""
    md = F.regexp_replace(F.regexp_replace("html", "(?i)<h[1-4][^>]*>", "\n# "), "<[^>]*>", " ")
    return pages.markdown_chunks(t(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), md.alias("text")))


_TOKENS = r"""list_slice(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(array_to_string(list_slice(string_split(coalesce(text, ''), chr(10)), 1, 40), chr(10)), '[\s;,|#=:]+'),
lambda w: substring(regexp_replace(lower(w), '[0-9]+', '#', 'g'), 1, 24)), lambda w: length(w) >= 2))), 1, 80)"""


@query(f"SELECT doc_id, array_to_string({_TOKENS}, ' ') AS tokens FROM documents")
def format_signature(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.array_join(parsers.head_tokens(F.col("text")), " ").alias("tokens"))


@query(f"""WITH f AS (SELECT doc_id, lang, source, {_TOKENS} AS tokens FROM documents), r AS (SELECT lang AS script_id, arg_min(tokens, doc_id) AS tokens, arg_min(source, doc_id) AS source FROM f WHERE lang IS NOT NULL GROUP BY 1),
m AS (SELECT doc_id, script_id, len(list_intersect(f.tokens, r.tokens)) AS shared, len(f.tokens) + len(r.tokens) AS n, f.source = r.source AS same FROM f, r),
s AS (SELECT doc_id, script_id, round(least(1, CASE WHEN shared > 0 THEN shared / (n - shared) ELSE 0 END + CASE WHEN same THEN 0.2 ELSE 0 END), 6) AS similarity FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, script_id) AS k FROM s WHERE similarity >= 0.45)
SELECT doc_id, script_id, similarity FROM k WHERE k <= 2""")
def parser_match(spark, sf):
    """The first document of each language as the format of a stored parser."""
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), "lang", parsers.head_tokens(F.col("text")).alias("tokens"), F.col("source").alias("pattern"))
    first = F.min_by(F.struct("tokens", "pattern"), "file_id").alias("s")
    registry = d.where("lang IS NOT NULL").groupBy(F.col("lang").alias("script_id")).agg(first).select("script_id", "s.*")
    return parsers.matching(d, registry).withColumnRenamed("file_id", "doc_id")


@query("SELECT event_type AS script_id, count(*) FILTER (WHERE value > 50) AS wins, count(*) FILTER (WHERE value <= 50 OR value IS NULL) AS losses FROM events GROUP BY 1")
def parser_scoreboard(spark, sf):
    return parsers.scoreboard(t(spark, sf, "events").select(F.col("event_type").alias("script_id"), (F.col("value") > 50).alias("ok")))


_CHECKS = "SELECT event_id, CASE event_type WHEN 'click' THEN 'script' WHEN 'view' THEN 'csv' ELSE 'xlsx-island' END AS method, round(0.5 + (event_id % 50) / 100.0, 2) AS conf, event_id % 7 AS n, event_id % 3 = 0 AS seen, CASE event_id % 4 WHEN 0 THEN NULL ELSE event_id % 4 = 1 END AS ok FROM events"


@query(f"""SELECT event_id, n > 0 AND (method = 'script' OR round(abs(conf - 0.8), 9) <= 0.08 OR NOT seen) AS verify, method = 'script' AS refine,
CAST(CASE WHEN ok THEN round(least(0.97, conf + 0.07), 6) WHEN NOT ok THEN least(conf, 0.75) ELSE conf END AS DOUBLE) AS confidence,
CASE WHEN n = 0 THEN 'none' WHEN seen THEN 'block' ELSE 'proceed' END AS drift FROM ({_CHECKS})""")
def ingest_policy(spark, sf):
    e, i = t(spark, sf, "events"), F.col("event_id")
    method = F.when(F.col("event_type") == "click", "script").when(F.col("event_type") == "view", "csv").otherwise("xlsx-island")
    c = e.select("event_id", method.alias("method"), F.round(0.5 + (i % 50) / 100.0, 2).alias("conf"), (i % 7).alias("n"), (i % 3 == 0).alias("seen"), F.when(i % 4 != 0, i % 4 == 1).alias("ok"))
    flags = F.when(F.col("method") == "script", F.array(F.lit("malformed_rows"))).otherwise(F.array(F.lit("other")))
    return c.select(
        "event_id",
        policy.should_verify(F.col("method"), F.col("conf"), F.col("n"), F.col("seen"), "auto").alias("verify"),
        policy.should_refine(flags, F.lit(False)).alias("refine"),
        policy.after_verdict(F.col("conf"), F.col("ok")).alias("confidence"),
        policy.drift_action(F.when(F.col("seen"), "freeze").otherwise("evolve"), F.col("n")).alias("drift"),
    )


_LOG = "SELECT 'm' || event_id AS mapping_id, 'f' || user_id AS fingerprint, 't' AS target, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS version, CASE WHEN value > 50 THEN 'approved' ELSE 'proposed' END AS status FROM events"


def _log(spark: SparkSession, sf: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    cols = [F.concat(F.lit("m"), "event_id").alias("mapping_id"), F.concat(F.lit("f"), "user_id").alias("fingerprint"), F.lit("t").alias("target"), n.alias("version"), F.when(F.col("value") > 50, "approved").otherwise("proposed").alias("status"), F.lit(1).alias("at")]
    return t(spark, sf, "events").select(*cols)


@query(f"SELECT mapping_id, version, CASE WHEN status = 'approved' AND version < max(version) FILTER (WHERE status = 'approved') OVER (PARTITION BY fingerprint) THEN 'superseded' ELSE status END AS status FROM ({_LOG})")
def mapping_states(spark, sf):
    return mapping.current(_log(spark, sf)).select("mapping_id", "version", "status")


@query("SELECT 'f' || c_custkey AS fingerprint, CAST(1 + coalesce(n, 0) AS INT) AS version FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ON user_id = c_custkey")
def mapping_versions(spark, sf):
    new = t(spark, sf, "customer").select(F.concat(F.lit("f"), "c_custkey").alias("fingerprint"), F.lit("t").alias("target"))
    return mapping.next_versions(_log(spark, sf), new).select("fingerprint", "version")


@query("SELECT 'f' || c_custkey AS fingerprint FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)")
def mapping_unproposed(spark, sf):
    new = t(spark, sf, "customer").select(F.concat(F.lit("f"), "c_custkey").alias("fingerprint"))
    return mapping.without_proposal(_log(spark, sf), new)


@query()
def mapping_candidates(spark, sf):
    """The three customer columns most like each column of a declared target."""
    goal = mapping.Target("client", tuple(Field(n) for n in ("custkey", "name", "nation", "balance", "segment")))
    rows = [(f, c, s) for f, hits in mapping.ranked(t(spark, sf, "customer").columns, goal).items() for c, s in hits]
    return spark.createDataFrame(rows, "target_column string, source string, score double")


@query("SELECT c_custkey, CAST(0 AS BIGINT) AS s_suppkey FROM customer UNION ALL SELECT 0, s_suppkey FROM supplier")
def canonical_files(spark, sf):
    return mapping.canonical_view(spark, [f"{sf}/customer.parquet", f"{sf}/supplier.parquet"]).select(F.coalesce("c_custkey", F.lit(0)).alias("c_custkey"), F.coalesce("s_suppkey", F.lit(0)).alias("s_suppkey"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'true' WHEN 'O' THEN 'false' ELSE 'none' END AS b FROM orders")
def cast_boolean(spark, sf):
    word = F.when(F.col("o_orderstatus") == "F", " Yes").when(F.col("o_orderstatus") == "O", "FALSE").otherwise("maybe")
    return t(spark, sf, "orders").select("o_orderkey", F.coalesce(mapping.reading(word, "bool").cast("string"), F.lit("none")).alias("b"))


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as ledger entries: open ones wrote nothing."""
    h = F.sha2(F.col("o_orderkey").cast("string"), 256)
    item = F.array(F.struct(F.concat(F.lit("order"), "o_orderkey").alias("name"), h.alias("sha256"), F.lit(None).cast("bigint").alias("bytes"), F.lit(1).cast("bigint").alias("rows")))
    none = F.array().cast(provenance.ITEM)
    return t(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("ts"), F.lit("ingest").alias("kind"), F.lit("p").alias("project"), F.lit(None).cast("string").alias("doc_id"), (F.col("o_orderstatus") != "P").alias("ok"),
        F.when(F.col("o_orderstatus") == "F", h).alias("code_sha"), item.alias("inputs"), F.when(F.col("o_orderstatus") == "O", none).otherwise(item).alias("outputs"), F.lit("{}").alias("detail"), F.lit("").alias("prev_hash"), h.alias("entry_hash"), "o_orderkey",
    )


def _got(column: str, path: str, name: str) -> F.Column:
    return F.get_json_object(column, path).alias(name)


@query("""SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS entry_hash, CASE WHEN o_orderstatus = 'P' THEN 'FAIL' ELSE 'COMPLETE' END AS event_type, strftime(o_orderdate, '%Y-%m-%d') AS event_time, 'tablesmith.ingest' AS job,
CASE WHEN o_orderstatus = 'F' THEN 'sha256:' || sha256(CAST(o_orderkey AS VARCHAR)) END AS code, 'order' || o_orderkey AS input, CASE WHEN o_orderstatus <> 'O' THEN 'order' || o_orderkey END AS output, r AS run_id FROM (SELECT *,
substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || CASE substr(h, 17, 1) WHEN '0' THEN '8' WHEN '4' THEN '8' WHEN '8' THEN '8' WHEN 'c' THEN '8' WHEN '1' THEN '9' WHEN '5' THEN '9' WHEN '9' THEN '9' WHEN 'd' THEN '9' WHEN '2' THEN 'a' WHEN '6' THEN 'a' WHEN 'a' THEN 'a' WHEN 'e' THEN 'a' ELSE 'b' END || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS r
FROM (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(sha256(CAST(o_orderkey AS VARCHAR)))) AS h FROM orders))""")
def run_events(spark, sf):
    e = provenance.run_events(_entries(spark, sf))
    paths = {"event_type": "$.eventType", "event_time": "$.eventTime", "job": "$.job.name", "code": "$.job.facets.sourceCode.sourceCode", "input": "$.inputs[0].name", "output": "$.outputs[0].name", "run_id": "$.run.runId"}
    return e.select("entry_hash", *[_got("event", p, n) for n, p in paths.items()])


@query("""SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS entry_hash, 'order' || o_orderkey AS subject, sha256(CAST(o_orderkey AS VARCHAR)) AS digest, 'order' || o_orderkey AS dependency,
CASE WHEN o_orderstatus = 'F' THEN 'extraction-code' END AS code, strftime(o_orderdate, '%Y-%m-%d') AS started FROM orders WHERE o_orderstatus <> 'O'""")
def attestation_statements(spark, sf):
    s = provenance.statements(_entries(spark, sf))
    build, run = "$.predicate.buildDefinition", "$.predicate.runDetails"
    paths = {"subject": "$.subject[0].name", "digest": "$.subject[0].digest.sha256", "dependency": f"{build}.resolvedDependencies[0].name", "code": f"{build}.resolvedDependencies[1].name", "started": f"{run}.metadata.startedOn"}
    return s.select("entry_hash", *[_got("statement", p, n) for n, p in paths.items()])


@query("SELECT doc_id, sha256('DSSEv1 28 application/vnd.in-toto+json ' || octet_length(encode(text)) || ' ' || text) AS covered FROM documents")
def envelope_digest(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.sha2(provenance.pre_authentication(F.col("text")), 256).alias("covered"))


@query("SELECT user_id AS chain, event_id AS seq, false AS own_ok, true AS link_ok FROM events WHERE value > 90")
def ledger_verify(spark, sf):
    """Users' events as chains; those of a high value were changed after they were hashed."""
    text = F.concat_ws(":", "event_type", F.col("event_id").cast("string"))
    e = t(spark, sf, "events").select(F.col("user_id").alias("chain"), F.col("event_id").alias("seq"), F.when(F.col("value") > 90, F.concat(text, F.lit("!"))).otherwise(text).alias("body"), F.sha2(text, 256).alias("entry_hash"))
    return provenance.chain_breaks(e.withColumn("prev_hash", F.lag("entry_hash").over(Window.partitionBy("chain").orderBy("seq"))))


@query("SELECT 'k' || c_custkey AS name, CASE WHEN s_suppkey IS NULL THEN 'missing' WHEN s_nationkey = c_nationkey THEN 'ok' ELSE 'changed' END AS status FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def artifact_check(spark, sf):
    """Customers as recorded files, suppliers as the present ones, half of them under their catalogue name."""
    h = [F.sha2(F.col(c).cast("string"), 256).alias("sha256") for c in ("c_nationkey", "s_nationkey")]
    name = F.when(F.col("s_nationkey") > 12, F.concat(F.lit("k"), "s_suppkey", F.lit("__id.parquet"))).otherwise(F.concat(F.lit("k"), "s_suppkey"))
    recorded = t(spark, sf, "customer").select(F.concat(F.lit("k"), "c_custkey").alias("name"), h[0])
    return provenance.checked(recorded, t(spark, sf, "supplier").select(name.alias("name"), h[1])).select("name", "status")


@query("SELECT l_orderkey, count(*) AS n, string_agg(l_linenumber || ':' || l_suppkey, ',' ORDER BY l_linenumber, l_suppkey) AS items FROM lineitem GROUP BY 1")
def nested_tables(spark, sf):
    """A document with its tables nested; a group is one order's lines."""
    g = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("x"))
    return g.select("l_orderkey", "n", F.array_join(F.transform("x", lambda s: F.concat(s["l_linenumber"], F.lit(":"), s["l_suppkey"])), ",").alias("items"))
