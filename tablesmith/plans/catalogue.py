"""The library's registered queries over the driver's tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import infer
from ..operators import memory as M
from ..operators import quality as Q
from ..operators import text as X
from ..sources import delimited, routing
from .catalog import sources_of, usage_totals
from .catalog import usage_display as displayed
from .guarded import SqlSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _document_files(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as files (path, content)."""
    return t(spark, sf, "documents").select(F.format_string("d/%012d.txt", "doc_id").alias("path"), F.col("text").cast("binary").alias("content"))


def _doc_id() -> Column:
    return F.regexp_extract("path", "([0-9]+)", 1).cast("bigint")


@query("SELECT doc_id, sha256(text) AS content_hash, substr(sha256('p|' || sha256(text)), 1, 12) AS short_id, 'txt' AS doc_type FROM documents")
def content_hash(spark, sf):
    files = routing.described(_document_files(spark, sf))
    return files.select(_doc_id().alias("doc_id"), "content_hash", C.short_id(F.lit("p"), F.col("content_hash")).alias("short_id"), "doc_type")


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1")
def dedup_by_hash(spark, sf):
    return routing.distinct_contents(routing.described(_document_files(spark, sf))).select("content_hash", _doc_id().alias("first_id"), "copies")


@query("SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id) WHERE quality = 1)")
def incremental_skip(spark, sf):
    """Documents whose text is not among the ingested ones: labelled documents of quality 1 count as ingested, the others as failed."""
    docs, labels = routing.described(_document_files(spark, sf)), t(spark, sf, "labels")
    seen = docs.withColumn("doc_id", _doc_id()).join(labels, "doc_id").select("content_hash", F.when(F.col("quality") == 1, "ingested").otherwise("failed").alias("status"))
    return routing.not_seen(docs, seen).select(_doc_id().alias("doc_id"))


@query(r"""
WITH l AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')[1:400] AS head FROM documents),
b AS (SELECT doc_id, len(head) AS n_lines, array_to_string(head, chr(10)) AS h, head FROM l),
m AS (SELECT doc_id, max(n) AS most FROM (SELECT doc_id, s, count(*) AS n FROM (SELECT doc_id, substr(unnest(head), 1, 2) AS s FROM b) GROUP BY 1, 2) GROUP BY 1),
r AS (SELECT b.doc_id, n_lines, length(regexp_replace(h, '\s', '', 'g')) AS solid, length(h) - length(regexp_replace(h, '\p{L}', '', 'g')) AS letters, coalesce(most, 0) AS most FROM b LEFT JOIN m USING (doc_id)),
f AS (SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CASE WHEN solid > 0 THEN round(letters / solid, 6) ELSE 0.0 END AS alpha_ratio, CASE WHEN n_lines > 0 THEN round(most / n_lines, 6) ELSE 0.0 END AS prefix_share FROM r)
SELECT *, CASE WHEN alpha_ratio < 0.7 OR prefix_share > 0.5 THEN 'records' ELSE 'prose' END AS kind FROM f""")
def text_triage(spark, sf):
    return X.triage(t(spark, sf, "documents"))


@query(r"""
WITH RECURSIVE l AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS ps FROM documents),
r AS (SELECT doc_id, 1 AS i, 0 AS no, ps[1] AS buf FROM l WHERE len(ps) > 0
  UNION ALL SELECT r.doc_id, i + 1, CASE WHEN length(buf) + 1 + length(ps[i + 1]) <= 2500 THEN no ELSE no + 1 END, CASE WHEN length(buf) + 1 + length(ps[i + 1]) <= 2500 THEN buf || chr(10) || ps[i + 1] ELSE ps[i + 1] END
  FROM r JOIN l ON l.doc_id = r.doc_id WHERE i < len(ps))
SELECT doc_id, CAST(no AS INTEGER) AS chunk_no, arg_max(buf, i) AS chunk FROM r WHERE no < 60 GROUP BY doc_id, no""")
def chunk_text(spark, sf):
    return X.chunks(t(spark, sf, "documents"), separator="\n")


@query("""
WITH s AS (SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'tion', ''))) / 4 AS BIGINT) + CAST((length(lower(text)) - length(replace(lower(text), 'there', ''))) / 5 AS BIGINT) AS score FROM documents)
SELECT doc_id, score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10""")
def search_topk(spark, sf):
    return X.search(t(spark, sf, "documents"), "tion of there", 10)


@query("""
WITH h AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS head FROM documents)
SELECT doc_id, len(head) BETWEEN 1 AND 8 AND len(list_filter(head, lambda x: suffix(trim(string_split(x, ';')[1]), ':'))) >= 0.6 * len(head) AS is_preamble FROM h""")
def label_preamble(spark, sf):
    return X.label_preamble(t(spark, sf, "documents"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
c AS (SELECT doc_id, len(string_split(line, ',')) AS width, count(*) AS n FROM l WHERE trim(line) <> '' GROUP BY 1, 2)
SELECT doc_id, CAST(arg_max(width, n * 1000000 - width) AS BIGINT) AS width, CAST(sum(n) AS BIGINT) AS n_lines FROM c GROUP BY 1""")
def modal_width(spark, sf):
    return X.modal_width(t(spark, sf, "documents"))


@query(r"""
WITH f AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\. ', chr(10) || chr(10), 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\. ', chr(10) || chr(10), 'g'), chr(10)), 1) AS pos FROM documents),
g AS (SELECT *, trim(line, ' ;,|' || chr(9) || chr(13)) = '' AS gap FROM f), b AS (SELECT *, sum(CAST(gap AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM g)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS run, CAST(count(*) AS INTEGER) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM b WHERE NOT gap GROUP BY doc_id, k""")
def block_split(spark, sf):
    """The runs of lines between blank ones, of documents with a blank line after each sentence."""
    files = _document_files(spark, sf).withColumn("content", F.regexp_replace(F.col("content").cast("string"), r"\. ", "\n\n").cast("binary"))
    runs = delimited.line_runs(files)
    return runs.select(_doc_id().alias("doc_id"), "run", F.size("lines").alias("n_lines"), F.length(F.array_join("lines", "")).cast("bigint").alias("chars"))


@query("SELECT o_orderkey, o_totalprice, o_orderdate, o_custkey FROM orders")
def type_inference(spark, sf):
    """Orders as strings, typed again from the values."""
    o = t(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), F.col("o_totalprice").cast("string").alias("o_totalprice"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"), F.col("o_custkey").cast("string").alias("o_custkey"))
    return infer.infer_types(o).withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@query(r"SELECT p_partkey, trim(regexp_replace(lower(trim(p_name || ' (' || p_brand || ')')), '[^\w]+', '_', 'g'), '_') AS name FROM part")
def normalize_names(spark, sf):
    return t(spark, sf, "part").select("p_partkey", C.normalized(F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(")"))).alias("name"))


_PROFILE_SQL = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS dtype, count(*) AS rows, count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) AS \"distinct\", {f'CAST(min({c}) AS DOUBLE)' if k != 'str' else 'CAST(NULL AS DOUBLE)'} AS lo, {f'CAST(max({c}) AS DOUBLE)' if k != 'str' else 'CAST(NULL AS DOUBLE)'} AS hi FROM customer" for c, k in (("c_custkey", "int"), ("c_name", "str"), ("c_nationkey", "int"), ("c_acctbal", "float"), ("c_mktsegment", "str")))


@query(_PROFILE_SQL)
def column_profile(spark, sf):
    return Q.profile(t(spark, sf, "customer"))


@query(f"""WITH p AS ({_PROFILE_SQL}) SELECT "column", dtype, round(least(1.0, nulls / rows + 0.15), 3) AS null_ratio_max,
round(lo - 0.5 * CASE WHEN hi > lo THEN hi - lo ELSE greatest(abs(hi), 1) END, 4) AS lo, round(hi + 0.5 * CASE WHEN hi > lo THEN hi - lo ELSE greatest(abs(hi), 1) END, 4) AS hi FROM p""")
def contract_stats(spark, sf):
    return Q.contracts(Q.profile(t(spark, sf, "customer"))).withColumns({"lo": F.round("lo", 4), "hi": F.round("hi", 4)})


@query("""WITH k AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem WHERE l_quantity <= 10), p AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem WHERE l_quantity > 10)
SELECT 'l_quantity' AS "column", 'out_of_range' AS issue FROM p, k WHERE p.lo < k.lo - 0.5 * (k.hi - k.lo) OR p.hi > k.hi + 0.5 * (k.hi - k.lo)
UNION ALL SELECT 'l_discount', 'null_ratio' FROM lineitem WHERE l_quantity > 10 HAVING count(*) FILTER (l_orderkey % 3 = 0) > 0.15 * count(*)
UNION ALL VALUES ('l_tax', 'missing_column'), ('l_linenumber', 'dtype_changed'), ('l_suppkey', 'new_column')""")
def drift_check(spark, sf):
    """Lines of small quantities as what is known, the others as a delivery with a column gone, one added, one of another type and one with nulls."""
    li = t(spark, sf, "lineitem")
    known = li.where("l_quantity <= 10").select("l_quantity", "l_discount", "l_tax", "l_linenumber")
    new = li.where("l_quantity > 10").select("l_quantity", F.when(F.col("l_orderkey") % 3 != 0, F.col("l_discount")).alias("l_discount"), F.col("l_linenumber").cast("string").alias("l_linenumber"), "l_suppkey")
    return Q.drift(Q.profile(new), Q.contracts(Q.profile(known)))


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_COLUMNS_SQL = f"SELECT table_name, column_name, data_type FROM information_schema.columns WHERE table_name IN {_TABLES}"


def _schemas(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(n, [c.split("_", 1)[-1] for c in t(spark, sf, n).columns]) for n in _TABLES]
    return spark.createDataFrame(rows, "schema_id string, names array<string>")


@query(f"""WITH s AS (SELECT table_name AS schema_id, CASE WHEN strpos(column_name, '_') > 0 THEN substr(column_name, strpos(column_name, '_') + 1) ELSE column_name END AS name FROM ({_COLUMNS_SQL})),
n AS (SELECT schema_id, count(*) AS n FROM s GROUP BY 1), m AS (SELECT a.schema_id AS a, b.schema_id AS b, count(*) AS c FROM s a JOIN s b ON a.name = b.name AND a.schema_id < b.schema_id GROUP BY 1, 2)
SELECT a, b, round(c / (x.n + y.n - c), 6) AS jaccard FROM m JOIN n x ON x.schema_id = a JOIN n y ON y.schema_id = b WHERE c / (x.n + y.n - c) >= 0.1""")
def schema_similarity(spark, sf):
    return M.similar_schemas(_schemas(spark, sf), 0.1)


@query(f"""SELECT table_name, substr(sha256(string_agg(part, '|' ORDER BY part)), 1, 16) AS fingerprint FROM (SELECT table_name, column_name || ':' || CASE WHEN data_type IN ('BIGINT', 'INTEGER') THEN 'int' WHEN data_type IN ('DOUBLE', 'FLOAT') THEN 'float' WHEN data_type LIKE 'TIMESTAMP%' THEN 'date' ELSE 'str' END AS part FROM ({_COLUMNS_SQL})) GROUP BY 1""")
def schema_fingerprint(spark, sf):
    return spark.createDataFrame([(n, C.fingerprint(t(spark, sf, n).schema)) for n in _TABLES], "table_name string, fingerprint string")


_LINK_COLUMNS = {
    "benchmark": ["item_id"],
    "conversations": ["conv_id", "turn", "role"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"],
    "documents": ["doc_id", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "label"],
    "events": ["event_id", "user_id", "event_type", "props"],
    "labels": ["doc_id", "quality", "toxic"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"],
    "pages": ["page_id", "url"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"],
    "region": ["r_regionkey", "r_name"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey"],
}
_VALUES_SQL = " UNION ALL ".join(f"SELECT '{n}' AS tbl, '{c}' AS col, CAST({c} AS VARCHAR) AS v FROM {n} WHERE {c} IS NOT NULL" for n, cols in _LINK_COLUMNS.items() for c in cols)


@query(f"""WITH v AS ({_VALUES_SQL}), k AS (SELECT tbl, col FROM v GROUP BY 1, 2 HAVING count(DISTINCT v) / count(*) >= 0.15),
d AS (SELECT DISTINCT tbl, col, lower(trim(v)) AS v FROM v JOIN k USING (tbl, col)), s AS (SELECT tbl, col, count(*) AS n FROM d GROUP BY 1, 2),
m AS (SELECT a.tbl AS src_table, a.col AS src_col, b.tbl AS dst_table, b.col AS dst_col, count(*) AS both_n FROM d a JOIN d b ON a.v = b.v AND a.tbl < b.tbl GROUP BY 1, 2, 3, 4)
SELECT src_table, src_col, dst_table, dst_col, round(both_n / (x.n + y.n - both_n), 6) AS overlap FROM m JOIN s x ON x.tbl = src_table AND x.col = src_col JOIN s y ON y.tbl = dst_table AND y.col = dst_col WHERE round(both_n / (x.n + y.n - both_n), 6) >= 0.3""")
def value_overlap_links(spark, sf):
    """Over every key and text column of the catalogue but whole texts."""
    vals = [M.column_values(n, t(spark, sf, n), cols, sample=None) for n, cols in _LINK_COLUMNS.items()]
    return M.value_links(reduce(DataFrame.unionByName, vals))


@query()
def name_similarity_links(spark, sf):
    cols = [(n, c) for n in _TABLES for c in t(spark, sf, n).columns]
    return spark.createDataFrame(M.name_links(cols, 0.7), "src_table string, src_col string, dst_table string, dst_col string, ratio double")


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events")
    method = F.when(F.col("event_id") % 3 == 0, "csv").when(F.col("event_id") % 3 == 1, "pdf-table").otherwise("other")
    flags = F.when(F.col("event_id") % 5 == 0, F.array(F.lit("malformed_rows"))).otherwise(F.array().cast("array<string>"))
    return e.select("event_id", method.alias("method"), F.array(F.lit("a"), F.when(F.col("event_id") % 2 == 0, "col_1").otherwise("b")).alias("names"), F.array(F.lit("1"), F.lit("2")).alias("first_row"), (F.col("event_id") % 4).cast("int").alias("null_heavy"), flags.alias("flags"), F.lit(10).alias("rows"))


_SCORE_SQL = """SELECT event_id, round(greatest(0, least(1, CASE event_id % 3 WHEN 0 THEN 0.95 WHEN 1 THEN 0.8 ELSE 0.7 END - CASE WHEN event_id % 2 = 0 THEN 0.075 ELSE 0 END - least(0.15, 0.04 * (event_id % 4)) - CASE WHEN event_id % 5 = 0 THEN 0.1 ELSE 0 END)), 6) AS confidence FROM events"""


@query(f"SELECT event_id, CAST(confidence AS DOUBLE) AS confidence, confidence < 0.8 AS needs_review FROM ({_SCORE_SQL})")
def confidence_score(spark, sf):
    return Q.confidence(_candidates(spark, sf)).select("event_id", "confidence", "needs_review")


@query(f"SELECT event_id, CAST(confidence AS DOUBLE) AS confidence FROM ({_SCORE_SQL}) WHERE confidence < 0.8")
def review_queue(spark, sf):
    return Q.confidence(_candidates(spark, sf)).where("needs_review").select("event_id", "confidence")


_ORDER = [Q.Field("order_id", "int", True), Q.Field("amount", "float", True), Q.Field("status", "str", False, None, ("O", "F")), Q.Field("currency", "str"), Q.Field("note", "str")]
_MAPPING = {"order_id": {"source": "o_orderkey"}, "amount": {"source": "o_totalprice", "scale": 0.5}, "status": {"source": "o_orderstatus"}, "currency": {"const": "CHF"}}


@query("SELECT o_orderkey AS order_id, round(o_totalprice * 0.5, 4) AS amount, o_orderstatus AS status, 'CHF' AS currency, CAST(NULL AS VARCHAR) AS note FROM orders")
def map_project(spark, sf):
    return Q.apply_mapping(t(spark, sf, "orders"), _ORDER, _MAPPING).withColumn("amount", F.round("amount", 4))


@query("SELECT o_orderkey AS order_id, o_orderstatus AS status FROM orders WHERE o_orderstatus IN ('O', 'F')")
def enforce_good(spark, sf):
    return Q.good(Q.conformed(t(spark, sf, "orders"), _ORDER, _MAPPING)).select("order_id", "status")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS order_id, '{"errors":["status: not allowed"]}' AS errors FROM orders WHERE o_orderstatus NOT IN ('O', 'F')""")
def enforce_quarantine(spark, sf):
    return Q.quarantine(Q.conformed(t(spark, sf, "orders"), _ORDER, _MAPPING)).select("order_id", "errors")


_EVENT = [Q.Field("event_id", "int", True), Q.Field("amount", "int"), Q.Field("kind", "bool", True)]
_EVENT_MAPPING = {"event_id": {"source": "event_id"}, "amount": {"source": "value"}, "kind": {"source": "kind"}}
_EVENT_ROWS = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'x' || event_id WHEN 1 THEN event_id || '.5' WHEN 2 THEN NULL ELSE event_id || '.0' END AS value, CASE event_id % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN '0' ELSE 'maybe' END AS kind FROM events"


def _events_to_hold(spark: SparkSession, sf: str) -> DataFrame:
    """Events as text: integers, fractions, words and nulls in one column, words that are no booleans in another."""
    i = F.col("event_id")
    value = F.when(i % 5 == 0, F.concat(F.lit("x"), i)).when(i % 5 == 1, F.concat(i, F.lit(".5"))).when(i % 5 > 2, F.concat(i, F.lit(".0")))
    kind = F.when(i % 3 == 0, "Yes").when(i % 3 == 1, "0").otherwise("maybe")
    return t(spark, sf, "events").select("event_id", value.alias("value"), kind.alias("kind"))


@query(f"SELECT event_id, coalesce(CAST(CAST(value AS DOUBLE) AS BIGINT), -1) AS amount, kind = 'Yes' AS kind FROM ({_EVENT_ROWS}) WHERE event_id % 5 >= 2 AND kind <> 'maybe'")
def enforce_types_good(spark, sf):
    return Q.good(Q.conformed(_events_to_hold(spark, sf), _EVENT, _EVENT_MAPPING)).withColumn("amount", F.coalesce("amount", F.lit(-1)))


@query(f"""SELECT CAST(event_id AS VARCHAR) AS event_id, value AS amount, kind, '{{"errors":[' || CASE WHEN event_id % 5 < 2 THEN '"amount: not int"' ELSE '' END || CASE WHEN event_id % 5 < 2 AND kind = 'maybe' THEN ',' ELSE '' END || CASE WHEN kind = 'maybe' THEN '"kind: not bool"' ELSE '' END || ']}}' AS errors FROM ({_EVENT_ROWS}) WHERE event_id % 5 < 2 OR kind = 'maybe'""")
def enforce_types_quarantine(spark, sf):
    """What a cast cannot take goes to quarantine as it came, with its errors."""
    return Q.quarantine(Q.conformed(_events_to_hold(spark, sf), _EVENT, _EVENT_MAPPING))


@query("SELECT CAST(n_regionkey AS VARCHAR) AS schema_id, count(*) AS n, string_agg(n_name, ',' ORDER BY n_name) AS tables FROM nation GROUP BY 1 HAVING count(*) > 1")
def schema_families(spark, sf):
    return M.families(t(spark, sf, "nation").select(F.col("n_regionkey").cast("string").alias("schema_id"), F.col("n_name").alias("name")))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def mapping_latest(spark, sf):
    return M.latest(t(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


def _usage(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a usage log: an entity is the customer, the supplier or the part that has the user's number."""
    kind = F.when(F.col("event_id") % 3 == 0, "customer").when(F.col("event_id") % 3 == 1, "supplier").otherwise("part")
    return t(spark, sf, "events").select(kind.alias("entity_kind"), F.col("user_id").cast("string").alias("entity_id"), F.lit(1).cast("bigint").alias("n"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


_USAGE_SQL = "SELECT CASE event_id % 3 WHEN 0 THEN 'customer' WHEN 1 THEN 'supplier' ELSE 'part' END AS entity_kind, CAST(user_id AS VARCHAR) AS entity_id, count(*) AS uses, epoch_us(max(ts)) AS last_used FROM events GROUP BY 1, 2"


@query(_USAGE_SQL)
def usage_counts(spark, sf):
    return usage_totals(_usage(spark, sf))


@query(f"""SELECT u.*, coalesce(c_name, s_name, p_name, entity_id) AS display FROM ({_USAGE_SQL}) u LEFT JOIN customer ON entity_kind = 'customer' AND CAST(c_custkey AS VARCHAR) = entity_id
LEFT JOIN supplier ON entity_kind = 'supplier' AND CAST(s_suppkey AS VARCHAR) = entity_id LEFT JOIN part ON entity_kind = 'part' AND CAST(p_partkey AS VARCHAR) = entity_id""")
def usage_display(spark, sf):
    names = {n: t(spark, sf, n).select(F.col(k).alias("id"), F.col(c).alias("name")) for n, k, c in (("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"))}
    return displayed(usage_totals(_usage(spark, sf)), names)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS table_id, 'part' AS input_kind, CAST(l_partkey AS VARCHAR) AS input_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'R'")
def provenance_join(spark, sf):
    """Orders as tables, their lines as edges of lineage; returned ones are extractions."""
    edges = t(spark, sf, "lineitem").select(F.lit("table").alias("output_kind"), F.col("l_orderkey").cast("string").alias("output_id"), F.when(F.col("l_returnflag") == "R", "extracted_from").otherwise("mapped_from").alias("relation"), F.lit("part").alias("input_kind"), F.col("l_partkey").cast("string").alias("input_id"))
    return sources_of(t(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("table_id")), edges)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION SELECT DISTINCT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
r AS (SELECT src, dst, 1 AS depth FROM e UNION ALL SELECT r.src, e.dst, depth + 1 FROM r JOIN e ON r.dst = e.src WHERE depth < 100) SELECT src, dst, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY 1, 2""")
def lineage_closure(spark, sf):
    n = t(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    s = t(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"))
    return M.closure(n.union(s), "src", "dst")


@query("SELECT event_id, sha256(coalesce(lag(event_type || ':' || event_id) OVER (PARTITION BY user_id ORDER BY event_id), '') || '>' || event_type || ':' || event_id) AS entry_hash FROM events")
def ledger_chain(spark, sf):
    e = t(spark, sf, "events").withColumn("line", F.concat_ws(":", "event_type", F.col("event_id").cast("string")))
    prev = F.coalesce(F.lag("line").over(Window.partitionBy("user_id").orderBy("event_id")), F.lit(""))
    return e.select("event_id", F.sha2(F.concat(prev, F.lit(">"), F.col("line")), 256).alias("entry_hash"))


@query("""SELECT coalesce(s_suppkey, c_custkey) AS k, CASE WHEN s_suppkey IS NULL THEN 'added' WHEN c_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM supplier FULL JOIN customer ON s_suppkey = c_custkey WHERE s_suppkey IS NULL OR c_custkey IS NULL OR s_nationkey <> c_nationkey""")
def snapshot_diff(spark, sf):
    """Suppliers as the old state of the customers with their keys."""
    old, new = t(spark, sf, "supplier").selectExpr("s_suppkey AS k", "s_nationkey AS v"), t(spark, sf, "customer").selectExpr("c_custkey AS k", "c_nationkey AS v")
    return M.snapshot_diff(old, new, "k", ["v"])


def sql_query(name: str, text: str, duck: str | None = None) -> None:
    """A query that a user would hand to the guarded session, with the same text for the oracle unless the dialects differ."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        s = SqlSession(spark)
        for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations"):
            s.register(n, t(spark, sf, n))
        return s.run(text, rows=None)

    _QUERIES[name], _SQL[name] = run, duck or text


sql_query("set_ops", "SELECT c_custkey AS k, 'u' AS op FROM customer WHERE c_acctbal < 0 UNION SELECT o_custkey, 'u' FROM orders WHERE o_orderstatus = 'F' UNION ALL (SELECT c_custkey, 'i' FROM customer INTERSECT SELECT o_custkey, 'i' FROM orders) UNION ALL (SELECT c_custkey, 'e' FROM customer EXCEPT SELECT o_custkey, 'e' FROM orders)")
sql_query("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, CAST(grouping(l_returnflag) AS INT) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
sql_query("rollup_agg", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql_query("cube_agg", "SELECT l_returnflag, l_linestatus, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
sql_query("filtered_agg", "SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS n, round(sum(l_extendedprice) FILTER (WHERE l_tax > 0.02), 2) AS s FROM lineitem GROUP BY l_returnflag")
sql_query("pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 4) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 4) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus")
sql_query("window_rank", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS rn, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS INT) AS dr FROM orders")
sql_query("window_frame", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS avg3 FROM orders")
sql_query("semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
sql_query("anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
sql_query("theta_join", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql_query("unpivot_columns", "SELECT l_orderkey, l_linenumber, k, v FROM lineitem UNPIVOT (v FOR k IN (l_discount, l_tax))")
sql_query("pivot_columns", "SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem) PIVOT (round(sum(l_quantity), 2) FOR l_linestatus IN ('O' AS o, 'F' AS f))", "SELECT l_returnflag, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 2) AS o, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 2) AS f FROM lineitem GROUP BY 1")
sql_query("json_props", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
sql_query("scalar_subquery", "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)")
sql_query("lateral_join", "SELECT n_name, c.c_custkey FROM nation, LATERAL (SELECT c_custkey FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9000) c")


@query("SELECT e.event_id, o.o_orderkey FROM (SELECT event_id, user_id, ts FROM events) e ASOF LEFT JOIN (SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k = 1) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate")
def asof_join(spark, sf):
    """The last order before each event, by one sort of both sides together: no pair of rows is ever formed."""
    e = t(spark, sf, "events").select(F.col("user_id").alias("k"), F.col("ts").alias("at"), "event_id", F.lit(None).cast("bigint").alias("o_orderkey"), F.lit(1).alias("side"))
    o = t(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at"), F.lit(None).cast("bigint").alias("event_id"), "o_orderkey", F.lit(0).alias("side"))
    w = Window.partitionBy("k").orderBy("at", "side", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    both = e.unionByName(o).withColumn("o_orderkey", F.last("o_orderkey", ignorenulls=True).over(w))
    return both.where("side = 1").select("event_id", "o_orderkey")


@query("SELECT conv_id, count(*) AS turns, string_agg(role || ':' || text, chr(10) ORDER BY turn, role, text) AS dialogue FROM conversations GROUP BY conv_id")
def conversation_rollup(spark, sf):
    turn = F.struct("turn", "role", "text")
    rows = t(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sort_array(F.collect_list(turn)).alias("all"))
    return rows.select("conv_id", "turns", F.array_join(F.transform("all", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n").alias("dialogue"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM pages")
def page_text_extract(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " ")).alias("body"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    from ..streaming.ingest import event_counts

    return event_counts(t(spark, sf, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT o_orderkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def suggested_join(spark, sf):
    """The join of a link between orders and customers, as a reader of the context would run it."""
    s = SqlSession(spark)
    for n in ("orders", "customer"):
        s.register(n, t(spark, sf, n))
    return s.run(M.join_query("orders", "o_custkey", "customer", "c_custkey"), rows=None).select("o_orderkey", "c_custkey", "c_name")


def queries() -> dict[str, Query]:
    from . import catalogue_files

    return _QUERIES | catalogue_files.QUERIES


def oracle_sql() -> dict[str, str]:
    from . import catalogue_files

    return _SQL | catalogue_files.SQL
