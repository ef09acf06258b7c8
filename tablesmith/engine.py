"""The whole way from a folder of files to tables, links, mappings and answers."""

from __future__ import annotations

import datetime
import hashlib
import json
import os
import time
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.columns import coarse_dtype, fingerprint, normalize_name
from .functions.infer import infer_types
from .operators import mapping as M
from .operators import memory, provenance, quality, text
from .plans.catalog import Catalog
from .plans.guarded import SqlSession, view_name
from .plans.model import Answer, Model, NullModel, ask
from .sources import delimited, ooxml, routing

TABLE_KINDS = {"csv": "csv", "xlsx": "xlsx-island", "office": "office"}


@dataclass
class Report:
    documents: int = 0
    skipped: int = 0
    tables: list[str] = field(default_factory=list)
    review: list[str] = field(default_factory=list)


_is_table_text = F.udf(lambda c: c is not None and delimited.looks_delimited(delimited.decode(bytes(c))[0]), T.BooleanType(), useArrow=True)
_decoded = F.udf(lambda c: None if c is None else delimited.decode(bytes(c))[0], T.StringType(), useArrow=True)


class Engine:
    """A project below ``root`` (a folder that driver and executors share; the ledger's file is the driver's)."""

    def __init__(self, spark: SparkSession, root: str, project: str = "default", model: Model | None = None):
        self.spark, self.project, self.root = spark, project, root.rstrip("/")
        self.model, self.catalog = model or NullModel(), Catalog(spark, f"{self.root}/catalog")
        os.makedirs(self.root, exist_ok=True)
        self.ledger = provenance.FileLedger(f"{self.root}/ledger.jsonl")

    def _log(self, kind: str, **entry: object) -> dict:
        e = self.ledger.append(ts=datetime.datetime.now(datetime.UTC).isoformat(), kind=kind, project=self.project, **entry)
        self.catalog.append("runs", [{"run_id": e["entry_hash"][:12], "project": self.project, "kind": kind, "ok": entry.get("ok", True), "entry_hash": e["entry_hash"], "inputs": [i["name"] for i in entry.get("inputs", [])], "outputs": [o["name"] for o in entry.get("outputs", [])], "detail": json.dumps(entry.get("detail", {}), default=str)}])
        return e

    def ingest(self, path: str, force: bool = False) -> Report:
        """Reads new files below ``path``; each table is typed, scored, compared with known schemas and written."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        files = files.where(~F.element_at(F.split("path", "/"), -1).startswith("."))
        found = routing.distinct_contents(routing.described(routing.expand_archives(files))).drop("copies")
        known = self.catalog.current("documents").where(F.col("project") == self.project)
        new = routing.not_seen(found, known, force).withColumn("doc_id", F.substring(F.sha2(F.concat_ws("|", F.lit(self.project), "content_hash"), 256), 1, 12))
        as_table = (F.col("doc_type") == "txt") & _is_table_text("content")
        batch = f"{self.root}/batches/{time.time_ns()}"
        new.withColumn("doc_type", F.when(as_table, "csv").otherwise(F.col("doc_type"))).write.parquet(f"{batch}/files")
        new = self.spark.read.parquet(f"{batch}/files")
        csv = delimited.parsed(new.where("doc_type = 'csv'"))
        many = F.when(F.col("block") > 0, F.concat(F.lit("_block"), F.col("block").cast("string"))).otherwise("")
        stem = F.regexp_replace(F.element_at(F.split("path", "/|::"), -1), r"\.[^.]*$", "")
        flags = F.array_compact(F.array(F.when(F.col("malformed") > 0, "malformed_rows"), F.when(F.get("header", F.lit(0)) == "col_0", "no_obvious_header")))
        grids = csv.select("path", F.concat(stem, many).alias("name"), F.col("block").alias("table_no"), "path", F.lit("csv").alias("method"), flags.alias("flags"), F.transform("header", lambda _, i: F.concat(F.lit("field "), (i + 1).cast("string"))).alias("origins"), "header", "row_no", "cells").toDF(*[x.split()[0] for x in ooxml.GRID.split(", ")])
        for kind, reader in (("xlsx", ooxml.workbook_rows), ("office", ooxml.office_rows)):
            grids = grids.unionByName(reader(new.where(F.col("doc_type") == kind)))
        grids.write.parquet(f"{batch}/grids")
        grids = self.spark.read.schema(ooxml.GRID).parquet(f"{batch}/grids")
        docs = {r["path"]: r for r in new.select("path", "name", "doc_id", "content_hash", "doc_type", F.octet_length("content").alias("bytes")).collect()}
        report = Report(len(docs), found.count() - len(docs))
        if force:
            for r in docs.values():
                self.catalog.forget_document(r["doc_id"])
        inventory = grids.groupBy("path", "name").agg(F.max("header").alias("header"), F.max("origins").alias("origins"), F.max("method").alias("method"), F.max("ref").alias("ref"), F.max("flags").alias("flags"), F.count("*").alias("rows")).orderBy("path", "name").collect()
        for t in inventory:
            self._table(docs[t["path"]], t, grids.where((F.col("path") == t["path"]) & (F.col("name") == t["name"])), report)
        self._chunks(new)
        with_table = {t["path"] for t in inventory}
        label = {"pdf": "needs a page plug-in", "xls-legacy": "unsupported: old spreadsheet", "unknown": "unsupported"}
        self.catalog.append("documents", [{"doc_id": r["doc_id"], "project": self.project, "filename": r["name"], "path": p, "content_hash": r["content_hash"], "filetype": r["doc_type"], "bytes": r["bytes"], "status": "unsupported" if r["doc_type"] in label else "ingested", "meta": json.dumps({"tables": p in with_table, "reason": label.get(r["doc_type"])})} for p, r in docs.items()])
        self.link()
        return report

    def _chunks(self, new: DataFrame) -> None:
        prose = new.where("doc_type = 'txt'").select("doc_id", _decoded("content").alias("text"))
        parts = text.chunks(prose).select("doc_id", F.concat(F.lit("chunk "), F.col("chunk_no").cast("string")).alias("loc"), F.col("chunk").alias("text"))
        office = ooxml.office_chunks(new.where("doc_type = 'office'")).join(new.select("path", "doc_id"), "path").select("doc_id", "loc", F.col("chunk").alias("text"))
        beside = delimited.texts_beside(new.where("doc_type = 'csv'")).join(new.select("path", "doc_id"), "path").select("doc_id", "loc", F.col("chunk").alias("text"))
        every = parts.unionByName(office).unionByName(beside).withColumn("project", F.lit(self.project))
        self.catalog.append_frame("chunks", every.withColumn("chunk_id", F.substring(F.sha2(F.concat_ws("|", "doc_id", "loc", F.substring("text", 1, 64)), 256), 1, 12)))

    def _table(self, doc, t, rows: DataFrame, report: Report) -> None:
        df = infer_types(rows.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(t["header"])]))
        name = t["name"] if t["method"] == "xlsx-island" else normalize_name(t["name"])
        table_id = hashlib.sha256(f"{doc['doc_id']}|{name}".encode()).hexdigest()[:12]
        path = f"{self.root}/tables/{name}__{table_id}.parquet"
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        df.write.mode("overwrite").parquet(path)
        profile = [r.asDict() for r in quality.profile(df).collect()]
        first = df.limit(1).collect()
        df.unpersist()
        heavy = sum(p["nulls"] > 0.6 * p["rows"] for p in profile)
        one = self.spark.createDataFrame([(t["method"], df.columns, [None if v is None else str(v) for v in first[0]] if first else [], heavy, list(t["flags"]), t["rows"])], "method string, names array<string>, first_row array<string>, null_heavy int, flags array<string>, rows bigint")
        score = quality.confidence(one).first()
        issues, fp = list(t["flags"]), fingerprint(df.schema)
        profiled = self.spark.createDataFrame(profile, "column string, dtype string, rows bigint, nulls bigint, distinct bigint, lo double, hi double")
        known = self.catalog.one("schemas", schema_id=fp)
        drift: list[str] = []
        if known:
            learned = self.spark.createDataFrame(json.loads(known["contracts"]), "column string, dtype string, null_ratio_max double, lo double, hi double")
            drift = sorted(f"{r['column']}: {r['issue']}" for r in quality.drift(profiled, learned).collect())
        else:
            contracts = [r.asDict() for r in quality.contracts(profiled).collect()]
            self.catalog.append("schemas", [{"schema_id": fp, "columns": [(f.name, coarse_dtype(f.dataType)) for f in df.schema], "contracts": json.dumps(contracts)}])
        self.catalog.append("sightings", [{"schema_id": fp, "table_id": table_id, "project": self.project, "reused": bool(known), "drift": drift}])
        columns = [(f.name, f.dataType.simpleString(), o) for f, o in zip(df.schema, t["origins"])]
        self.catalog.append("tables", [{"table_id": table_id, "doc_id": doc["doc_id"], "project": self.project, "name": name, "path": path, "n_rows": t["rows"], "n_cols": len(columns), "columns": columns, "method": t["method"], "source_ref": t["ref"], "confidence": score["confidence"], "needs_review": score["needs_review"], "issues": issues + drift}])
        self.catalog.append("lineage", [{"output_kind": "table", "output_id": table_id, "relation": "extracted_from", "input_kind": "document", "input_id": doc["doc_id"], "project": self.project}])
        self._log("ingest", doc_id=doc["doc_id"], ok=True, inputs=[{"name": doc["name"], "sha256": doc["content_hash"]}], outputs=[{"name": name, "rows": t["rows"]}], detail={"method": t["method"], "drift": drift})
        report.tables.append(name)
        if score["needs_review"]:
            report.review.append(name)

    def tables(self) -> DataFrame:
        return self.catalog.current("tables").where(F.col("project") == self.project).orderBy("name")

    def review(self) -> DataFrame:
        return self.tables().where("needs_review").orderBy("confidence", "name")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.tables().where(F.col("name") == name).first()["path"])

    def link(self) -> DataFrame:
        """Links between columns by shared values or alike names; they replace the project's links."""
        held = self.tables().collect()
        links = self.spark.createDataFrame([], "src_table string, src_col string, dst_table string, dst_col string, kind string, confidence double, evidence string")
        if len(held) > 1:
            values = [memory.column_values(t["name"], self.spark.read.parquet(t["path"]), [c["name"] for c in t["columns"]]) for t in held]
            every = values[0]
            for v in values[1:]:
                every = every.unionByName(v)
            by_name = self.spark.createDataFrame(memory.name_links([(t["name"], c["name"]) for t in held for c in t["columns"]]), "src_table string, src_col string, dst_table string, dst_col string, ratio double")
            both = memory.value_links(every).join(by_name, ["src_table", "src_col", "dst_table", "dst_col"], "full")
            overlap, ratio = F.coalesce("overlap", F.lit(0.0)), F.coalesce("ratio", F.lit(0.0))
            links = both.select("src_table", "src_col", "dst_table", "dst_col", F.when(overlap >= memory.VALUE_JACCARD, "JOINABLE").otherwise("SAME_AS").alias("kind"), F.round(F.greatest(overlap, 0.85 * ratio), 2).alias("confidence"), F.format_string("overlap %.3f name %.3f", overlap, ratio).alias("evidence"))
        self.catalog.replace_links(self.project, links)
        return self.links()

    def links(self) -> DataFrame:
        return self.catalog.current("links").where(F.col("project") == self.project).orderBy(F.desc("confidence"), "src_table", "src_col", "dst_table", "dst_col")

    def sql_session(self) -> SqlSession:
        s = SqlSession(self.spark)
        for t in self.tables().orderBy("name", "table_id").collect():
            s.register(t["name"], self.spark.read.parquet(t["path"]))
        for target, paths in self._canonical_paths().items():
            s.register(f"canonical_{target}", M.canonical_view(self.spark, paths))
        return s

    def sql(self, query: str, rows: int | None = 40) -> DataFrame:
        s = self.sql_session()
        out = s.run(query, rows)
        for t in sorted(s.touched(query)):
            self.catalog.use("table", t)
        return out

    def search(self, query: str, k: int = 10) -> DataFrame:
        chunks = self.catalog.current("chunks").where(F.col("project") == self.project)
        return text.search(chunks, query, k, "chunk_id", "text").withColumnRenamed("doc_id", "chunk_id").join(chunks.select("chunk_id", "doc_id", "loc", "text"), "chunk_id").orderBy(F.desc("score"), "chunk_id")

    def ask(self, question: str) -> Answer:
        return ask(self.model, self.sql_session(), question, self.context()[0], self.search)

    def propose(self, targets: dict[str, M.Target]) -> list[dict]:
        """Proposals, without a model, for the schemas that have none yet; what fits no target is remembered as such."""
        log, out = self.catalog.log("mappings"), []
        versions = {(r["fingerprint"], r["target"]): r["v"] for r in log.groupBy("fingerprint", "target").agg(F.max("version").alias("v")).collect()}
        fresh = {r["fingerprint"] for r in M.without_proposal(log, self.catalog.current("schemas").select(F.col("schema_id").alias("fingerprint"))).collect()}
        for s in self.catalog.current("schemas").collect():
            if s["schema_id"] not in fresh:
                continue
            p = M.proposed([c["name"] for c in s["columns"]], targets)
            row = {"fingerprint": s["schema_id"], "target": p["target"] if p else None, "version": versions.get((s["schema_id"], p["target"] if p else None), 0) + 1, "status": "proposed" if p else "no_match", "mapping": json.dumps(p["mapping"]) if p else None, "confidence": p["confidence"] if p else 0.0}
            out.append(row | {"mapping_id": hashlib.sha256(f"{row['fingerprint']}|{row['target']}|{row['version']}".encode()).hexdigest()[:12]})
        self.catalog.append("mappings", out)
        return out

    def decide(self, mapping_id: str, status: str) -> None:
        """Approves or rejects a mapping; an older approved version of its key is superseded."""
        m = self.catalog.one("mappings", mapping_id=mapping_id)
        if m is None or status not in ("approved", "rejected"):
            raise ValueError(f"cannot set {mapping_id} to {status}")
        self.catalog.append("mappings", [m.asDict() | {"status": status}])
        self._log("mapping", ok=True, detail={"mapping_id": mapping_id, "status": status})

    def apply(self, targets: dict[str, M.Target]) -> list[dict]:
        """Writes the canonical and quarantine rows of every table whose schema has an approved mapping and that has not been mapped by it."""
        log = self.catalog.current("mappings")
        seen = self.catalog.current("sightings").select("schema_id", "table_id", "drift")
        live = M.approved(log, seen.select(F.col("schema_id").alias("fingerprint")))
        done = self.catalog.current("canonicals").select("canonical_id")
        todo = seen.join(live, seen["schema_id"] == live["fingerprint"]).join(self.tables().select("table_id", "name", "path"), "table_id")
        todo = todo.withColumn("canonical_id", F.substring(F.sha2(F.concat_ws("|", "table_id", "mapping_id"), 256), 1, 12)).join(done, "canonical_id", "left_anti")
        out = []
        for m in todo.dropDuplicates(["canonical_id"]).collect():
            t = targets.get(m["target"])
            if t is None or (t.on_drift == "freeze" and m["drift"]):
                continue
            rows = quality.conformed(self.spark.read.parquet(m["path"]), list(t.fields), json.loads(m["mapping"]))
            base = f"{self.root}/canonical/{view_name(t.name)}"
            path, bad = f"{base}/{m['name']}__{m['canonical_id']}.parquet", f"{self.root}/quarantine/{m['name']}__{m['canonical_id']}.parquet"
            quality.good(rows).write.mode("overwrite").parquet(path)
            quality.quarantine(rows).write.mode("overwrite").parquet(bad)
            n, q = self.spark.read.parquet(path).count(), self.spark.read.parquet(bad).count()
            out.append({"canonical_id": m["canonical_id"], "project": self.project, "target": t.name, "table_id": m["table_id"], "path": path, "n_rows": n, "n_quarantined": q})
            self.catalog.append("lineage", [{"output_kind": "canonical", "output_id": m["canonical_id"], "relation": r, "input_kind": k, "input_id": i, "project": self.project} for r, k, i in (("mapped_from", "table", m["table_id"]), ("conforms_to", "target", t.name))])
            self._log("map", ok=True, inputs=[{"name": m["name"]}], outputs=[{"name": f"canonical_{t.name}", "rows": n}], detail={"quarantined": q})
        self.catalog.append("canonicals", out)
        return out

    def _canonical_paths(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for r in self.catalog.current("canonicals").where(F.col("project") == self.project).orderBy("target", "path").collect():
            out.setdefault(r["target"], []).append(r["path"])
        return out

    def context(self) -> tuple[str, dict]:
        """(markdown, document): what the project holds, for a reader or a model."""
        tables, links = self.tables().collect(), self.links().collect()
        doc = {"project": self.project, "tables": [{"name": t["name"], "rows": t["n_rows"], "columns": [f"{c['name']} {c['dtype']}" for c in t["columns"]], "confidence": t["confidence"], "review": t["needs_review"]} for t in tables], "links": [{"from": f"{x['src_table']}.{x['src_col']}", "to": f"{x['dst_table']}.{x['dst_col']}", "kind": x["kind"], "confidence": x["confidence"]} for x in links]}
        doc["joins"] = [memory.join_query(view_name(x["src_table"]), x["src_col"], view_name(x["dst_table"]), x["dst_col"]) for x in links if x["kind"] == "JOINABLE"][:8]
        lines = [f"# {self.project}", "", "## Tables", ""]
        lines += [f"- `{t['name']}` ({t['rows']} rows, confidence {t['confidence']}{', to review' if t['review'] else ''}): {', '.join(t['columns'])}" for t in doc["tables"]]
        lines += ["", "## Links", "", *[f"- {x['from']} ~ {x['to']} {x['kind']} {x['confidence']}" for x in doc["links"]], "", "## Joins", "", *[f"- `{j}`" for j in doc["joins"]]]
        return "\n".join(lines) + "\n", doc

    def verify(self, sources: str) -> dict:
        """The ledger's first break (None: whole) and how many recorded inputs are ok, changed or missing below ``sources``."""
        lines = self.ledger.lines()
        recorded = sorted({(i["name"], i["sha256"]) for e in map(json.loads, lines) for i in e.get("inputs", []) if i.get("sha256")})
        status = {}
        if recorded:
            rows = provenance.checked(self.spark.createDataFrame(recorded, "name string, sha256 string"), provenance.file_hashes(self.spark, sources))
            status = {r["status"]: r["count"] for r in rows.groupBy("status").count().collect()}
        return {"first_break": memory.first_break(lines), **status}

    def snapshot(self) -> dict:
        """{file name: type, status, tables}, by which two ingests are compared."""
        out = {d["filename"]: {"filetype": d["filetype"], "status": d["status"], "tables": {}, "doc_id": d["doc_id"]} for d in self.catalog.current("documents").where(F.col("project") == self.project).collect()}
        owner = {d.pop("doc_id"): d for d in out.values()}
        for t in self.tables().collect():
            if t["doc_id"] in owner:
                owner[t["doc_id"]]["tables"][t["name"]] = {"rows": t["n_rows"], "columns": {c["name"]: c["dtype"] for c in t["columns"]}, "method": t["method"]}
        return out


def differences(expected: dict, actual: dict, where: str = "") -> list[str]:
    """The places at which two snapshots differ."""
    out = []
    for k in sorted(expected.keys() | actual.keys()):
        at = f"{where}/{k}" if where else k
        if k not in actual or k not in expected:
            out.append(f"{at}: {'missing' if k not in actual else 'unexpected'}")
        elif isinstance(expected[k], dict) and isinstance(actual[k], dict):
            out += differences(expected[k], actual[k], at)
        elif expected[k] != actual[k]:
            out.append(f"{at}: {actual[k]!r} instead of {expected[k]!r}")
    return out
