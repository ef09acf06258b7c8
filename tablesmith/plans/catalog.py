"""The state of a project: twelve relations as append-only Parquet logs, read as the latest row of each key."""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

#: relation -> (key columns, columns). Every row also has ``at`` (microseconds of its write), ``seq`` (its place in the write) and ``gone``.
RELATIONS: dict[str, tuple[tuple[str, ...], str]] = {
    "documents": (("doc_id",), "doc_id string, project string, filename string, path string, content_hash string, filetype string, bytes bigint, status string, meta string"),
    "tables": (("table_id",), "table_id string, doc_id string, project string, name string, path string, n_rows bigint, n_cols int, columns array<struct<name:string,dtype:string,origin:string>>, method string, source_ref string, confidence double, needs_review boolean, issues array<string>"),
    "schemas": (("schema_id",), "schema_id string, columns array<struct<name:string,dtype:string>>, contracts string"),
    "sightings": ((), "schema_id string, table_id string, project string, reused boolean, drift array<string>"),
    "links": (("project", "src_table", "src_col", "dst_table", "dst_col"), "project string, src_table string, src_col string, dst_table string, dst_col string, kind string, confidence double, evidence string"),
    "chunks": (("chunk_id",), "chunk_id string, doc_id string, project string, loc string, text string"),
    "runs": ((), "run_id string, project string, kind string, doc_id string, ok boolean, entry_hash string, inputs array<string>, outputs array<string>, detail string"),
    "lineage": ((), "output_kind string, output_id string, relation string, input_kind string, input_id string, project string"),
    "usage": ((), "entity_kind string, entity_id string, n bigint"),
    "mappings": (("mapping_id",), "mapping_id string, fingerprint string, target string, version int, status string, mapping string, confidence double"),
    "canonicals": (("canonical_id",), "canonical_id string, project string, target string, table_id string, path string, n_rows bigint, n_quarantined bigint"),
    "scripts": (("script_id",), "script_id string, format_id string, description string, tokens array<string>, pattern string, code string"),
}
STAMP = "at bigint, seq int, gone boolean"


def usage_totals(log: DataFrame) -> DataFrame:
    """(entity_kind, entity_id, uses, last_used) of a usage log (entity_kind, entity_id, n, at)."""
    return log.groupBy("entity_kind", "entity_id").agg(F.sum("n").alias("uses"), F.max("at").alias("last_used"))


def usage_display(totals: DataFrame, names: dict[str, DataFrame]) -> DataFrame:
    """``totals`` with ``display``: the name that its kind's relation (id, name) of ``names`` has for the entity, else the id itself."""
    out, found = totals, []
    for i, (kind, known) in enumerate(sorted(names.items())):
        k = known.select(F.lit(kind).alias(f"kind{i}"), F.col("id").cast("string").alias(f"id{i}"), F.col("name").alias(f"name{i}"))
        out = out.join(k, (F.col("entity_kind") == F.col(f"kind{i}")) & (F.col("entity_id") == F.col(f"id{i}")), "left")
        found.append(f"name{i}")
    return out.select(*totals.columns, F.coalesce(*found, "entity_id").alias("display"))


def sources_of(tables: DataFrame, lineage: DataFrame) -> DataFrame:
    """(table_id, input_kind, input_id): what each table was extracted from."""
    edge = lineage.where("output_kind = 'table' AND relation = 'extracted_from'").select(F.col("output_id").alias("table_id"), "input_kind", "input_id")
    return tables.select("table_id").join(edge, "table_id")


class Catalog:
    """Appends never rewrite a file, so a lost writer leaves what was there; a deletion is a row that says so."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def schema(self, relation: str) -> str:
        return f"{RELATIONS[relation][1]}, {STAMP}"

    def log(self, relation: str) -> DataFrame:
        """All rows ever written; none before the first write."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{relation}")
        there = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path)
        if not there:
            return self.spark.createDataFrame([], self.schema(relation))
        return self.spark.read.schema(self.schema(relation)).parquet(f"{self.root}/{relation}")

    def append_frame(self, relation: str, rows: DataFrame, gone: bool = False) -> None:
        """Rows as a frame; of one key's rows in a write, none is after another unless ``rows`` has ``seq``."""
        if "seq" not in rows.columns:
            rows = rows.withColumn("seq", F.lit(0))
        full = rows.withColumns({"at": F.lit(time.time_ns() // 1000), "gone": F.lit(gone)})
        want = self.spark.createDataFrame([], self.schema(relation)).schema
        out = full.select(*[(F.col(f"`{f.name}`") if f.name in full.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want.fields])
        out.write.mode("append").parquet(f"{self.root}/{relation}")

    def append(self, relation: str, rows: Iterable[dict]) -> None:
        """A few rows from the driver; a column that is left out is null. Later rows of a key win."""
        fields = self.spark.createDataFrame([], self.schema(relation)).schema
        data = [tuple(({"seq": i, "gone": False} | r).get(f.name) for f in fields.fields) for i, r in enumerate(rows)]
        if data:
            self.append_frame(relation, self.spark.createDataFrame(data, fields).drop("at", "gone"))

    def current(self, relation: str) -> DataFrame:
        """The rows that hold now, with ``at``; a relation without a key holds all of them."""
        keys, log = RELATIONS[relation][0], self.log(relation)
        if keys:
            w = Window.partitionBy(*keys).orderBy(F.desc("at"), F.desc("seq"), F.desc("gone"))
            log = log.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
        return log.where("NOT gone").drop("seq", "gone")

    def delete(self, relation: str, rows: DataFrame) -> None:
        self.append_frame(relation, rows.drop("at", "seq", "gone"), gone=True)

    def forget_document(self, doc_id: str) -> None:
        """Deletes a document's tables and chunks and the links of those tables; lineage and canonical tables stay as history."""
        tables = self.current("tables").where(F.col("doc_id") == doc_id)
        names = [r["name"] for r in tables.select("name").collect()]
        links = self.current("links").where(F.col("src_table").isin(names) | F.col("dst_table").isin(names)) if names else None
        if links is not None:
            self.delete("links", links)
            self.delete("tables", tables)
        self.delete("chunks", self.current("chunks").where(F.col("doc_id") == doc_id))

    def replace_links(self, project: str, links: DataFrame) -> None:
        """The project's links are from now on those of ``links``."""
        kept = links.select(F.lit(project).alias("project"), "src_table", "src_col", "dst_table", "dst_col", "kind", "confidence", "evidence")
        old = self.current("links").where(F.col("project") == project).drop("at")
        stale = old.join(kept, list(RELATIONS["links"][0]), "left_anti").withColumn("gone", F.lit(True))
        both = kept.withColumn("gone", F.lit(False)).unionByName(stale)
        want = self.schema("links")
        out = both.withColumns({"at": F.lit(time.time_ns() // 1000), "seq": F.lit(0)})
        out.select(*[x.split()[0] for x in want.split(", ")]).write.mode("append").parquet(f"{self.root}/links")

    def use(self, kind: str, entity: str, n: int = 1) -> None:
        self.append("usage", [{"entity_kind": kind, "entity_id": entity, "n": n}])

    def uses(self) -> DataFrame:
        """(entity_kind, entity_id, uses, last_used)."""
        return usage_totals(self.current("usage"))

    def top_uses(self, k: int = 15) -> DataFrame:
        """The most used entities with their names (a top-k report)."""
        names = {"table": self.current("tables").select(F.col("table_id").alias("id"), "name"), "document": self.current("documents").select(F.col("doc_id").alias("id"), F.col("filename").alias("name")), "canonical": self.current("canonicals").select(F.col("canonical_id").alias("id"), F.col("target").alias("name"))}
        return usage_display(self.uses(), names).orderBy(F.desc("uses"), "entity_kind", "entity_id").limit(k)

    def projects(self) -> DataFrame:
        """(project) of all documents."""
        return self.current("documents").select("project").distinct()

    def set_document_meta(self, doc_id: str, meta: str) -> None:
        """A new version of the document with another ``meta``; ValueError if there is none."""
        d = self.one("documents", doc_id=doc_id)
        if d is None:
            raise ValueError(f"no document {doc_id}")
        self.append("documents", [{k: v for k, v in d.asDict().items() if k != "at"} | {"meta": meta}])

    def canonical_totals(self) -> DataFrame:
        """(target, n_rows, sources): the canonical rows of each target and the tables they came from."""
        return self.current("canonicals").groupBy("target").agg(F.sum("n_rows").alias("n_rows"), F.array_sort(F.collect_set("table_id")).alias("sources"))

    def seen(self) -> DataFrame:
        """(schema_id, seen_count, first_seen, last_seen)."""
        return self.current("sightings").groupBy("schema_id").agg(F.count("*").alias("seen_count"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))

    def lineage_of(self, entity: str) -> DataFrame:
        return self.current("lineage").where((F.col("output_id") == entity) | (F.col("input_id") == entity))

    def runs_for(self, entity: str, newest: int = 20) -> DataFrame:
        """The newest runs that touch an entity (a top-k report)."""
        hit = (F.col("doc_id") == entity) | (F.col("run_id") == entity) | F.array_contains("inputs", entity) | F.array_contains("outputs", entity)
        return self.current("runs").where(hit).orderBy(F.desc("at"), "run_id").limit(newest)

    def one(self, relation: str, **key: object) -> Row | None:
        df = self.current(relation)
        for k, v in key.items():
            df = df.where(F.col(k) == v)
        return df.first()
