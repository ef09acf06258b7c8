"""Ledger entries as lineage events and attestations; signatures; checks of files against recorded hashes."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .memory import canonical_json

PRODUCER, NAMESPACE = "urn:tablesmith", "tablesmith"
# Fixed values of the public formats.
EVENT_SCHEMA = "https://openlineage.io/spec/2-0-2/OpenLineage.json"
VERSION_FACET = "https://openlineage.io/spec/facets/1-0-1/DatasetVersionDatasetFacet.json"
CODE_FACET = "https://openlineage.io/spec/facets/1-0-1/SourceCodeJobFacet.json"
STATEMENT, PROVENANCE, PAYLOAD = "https://in-toto.io/Statement/v1", "https://slsa.dev/provenance/v1", "application/vnd.in-toto+json"
URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"

ITEM = "array<struct<name:string,sha256:string,bytes:bigint,rows:bigint>>"
#: An entry as columns. ``line`` is the stored text, which is what is hashed.
ENTRY = f"ts string, kind string, project string, doc_id string, ok boolean, code_sha string, inputs {ITEM}, outputs {ITEM}, detail string, prev_hash string, entry_hash string"


def uuid5(name: Column, space: str = URL_SPACE) -> Column:
    """The version 5 identifier of ``name``: bits of a SHA-1, by expressions only."""
    h = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat_ws("-", *parts)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """ENTRY columns and ``line`` of a ledger in JSON lines; blank lines are skipped."""
    e = F.from_json("value", ENTRY)
    return spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("line"), e.alias("e")).select("line", "e.*")


def _datasets(items: str) -> Column:
    def one(i: Column) -> Column:
        version = F.when(i["sha256"].isNotNull(), F.struct(F.lit(PRODUCER).alias("_producer"), F.lit(VERSION_FACET).alias("_schemaURL"), i["sha256"].alias("datasetVersion")))
        return F.struct(F.concat(F.lit(f"{NAMESPACE}://"), F.coalesce("project", F.lit("unknown"))).alias("namespace"), F.coalesce(i["name"], F.lit("?")).alias("name"), F.struct(version.alias("version")).alias("facets"))

    return F.coalesce(F.transform(F.col(items), one), F.array())


def run_events(entries: DataFrame, since: str | None = None) -> DataFrame:
    """(entry_hash, event): one run event in JSON for each entry not before ``since``; a replay gives the same ids."""
    if since is not None:
        entries = entries.where(F.col("ts") >= since)
    space = F.concat(F.lit(f"{NAMESPACE}://"), F.coalesce("project", F.lit("unknown")))
    code = F.when(F.col("code_sha").isNotNull(), F.struct(F.lit(PRODUCER).alias("_producer"), F.lit(CODE_FACET).alias("_schemaURL"), F.lit("python").alias("language"), F.concat(F.lit("sha256:"), "code_sha").alias("sourceCode")))
    proof = F.struct(F.lit(PRODUCER).alias("_producer"), F.col("entry_hash").alias("entryHash"), F.col("prev_hash").alias("prevHash"), F.col("code_sha").alias("codeSha256"), F.col("detail"))
    event = F.struct(
        F.when(F.coalesce("ok", F.lit(True)), "COMPLETE").otherwise("FAIL").alias("eventType"),
        F.col("ts").alias("eventTime"),
        F.lit(PRODUCER).alias("producer"),
        F.lit(EVENT_SCHEMA).alias("schemaURL"),
        F.struct(uuid5(F.col("entry_hash")).alias("runId"), F.struct(proof.alias("provenance")).alias("facets")).alias("run"),
        F.struct(space.alias("namespace"), F.concat(F.lit(f"{NAMESPACE}."), F.coalesce("kind", F.lit("run"))).alias("name"), F.struct(code.alias("sourceCode")).alias("facets")).alias("job"),
        _datasets("inputs").alias("inputs"),
        _datasets("outputs").alias("outputs"),
    )
    return entries.select("entry_hash", F.to_json(event).alias("event"))


def statements(entries: DataFrame) -> DataFrame:
    """(entry_hash, statement): a provenance statement for each entry with a hashed output."""

    def hashed(items: str) -> Column:
        some = F.filter(F.coalesce(F.col(items), F.array().cast(ITEM)), lambda i: i["sha256"].isNotNull())
        return F.transform(some, lambda i: F.struct(F.coalesce(i["name"], F.lit("?")).alias("name"), F.struct(i["sha256"].alias("sha256")).alias("digest")))

    code = F.struct(F.lit("extraction-code").alias("name"), F.struct(F.col("code_sha").alias("sha256")).alias("digest"))
    needs = F.concat(hashed("inputs"), F.when(F.col("code_sha").isNotNull(), F.array(code)).otherwise(F.slice(F.array(code), 1, 0)))
    kind = F.concat(F.lit(f"{PRODUCER}:buildtype:"), F.coalesce("kind", F.lit("run")), F.lit("@v1"))
    build = F.struct(kind.alias("buildType"), F.struct("project", F.col("doc_id").alias("docId"), "detail").alias("externalParameters"), needs.alias("resolvedDependencies"))
    before = F.struct(F.lit("ledger:prevHash").alias("name"), F.struct(F.coalesce("prev_hash", F.lit("")).alias("sha256")).alias("digest"))
    run = F.struct(F.struct(F.lit(PRODUCER).alias("id")).alias("builder"), F.struct(F.col("entry_hash").alias("invocationId"), F.col("ts").alias("startedOn")).alias("metadata"), F.array(before).alias("byproducts"))
    body = F.struct(F.lit(STATEMENT).alias("_type"), F.col("subject"), F.lit(PROVENANCE).alias("predicateType"), F.struct(build.alias("buildDefinition"), run.alias("runDetails")).alias("predicate"))
    return entries.withColumn("subject", hashed("outputs")).where(F.size("subject") > 0).select("entry_hash", F.to_json(body).alias("statement"))


def pre_authentication(payload: Column, kind: str = PAYLOAD) -> Column:
    """The bytes that an envelope's signature covers, as a string."""
    return F.concat(F.lit(f"DSSEv1 {len(kind)} {kind} "), F.octet_length(payload).cast("string"), F.lit(" "), payload)


class Signer(Protocol):
    key_id: str

    def sign(self, data: bytes) -> bytes: ...

    def verify(self, data: bytes, signature: bytes) -> bool: ...


@dataclass(frozen=True)
class SharedKey:
    """A keyed hash. A public-key signer has the same two methods and is a plug-in."""

    key: bytes
    key_id: str = "hmac-sha256"

    def sign(self, data: bytes) -> bytes:
        return hmac.new(self.key, data, hashlib.sha256).digest()

    def verify(self, data: bytes, signature: bytes) -> bool:
        return hmac.compare_digest(self.sign(data), signature)


def _covered(payload: bytes, kind: str) -> bytes:
    return b"DSSEv1 %d %s %d %s" % (len(kind), kind.encode(), len(payload), payload)


def envelope(statement: str, signer: Signer) -> dict:
    payload = statement.encode()
    sig = base64.b64encode(signer.sign(_covered(payload, PAYLOAD))).decode()
    return {"payload": base64.b64encode(payload).decode(), "payloadType": PAYLOAD, "signatures": [{"keyid": signer.key_id, "sig": sig}]}


def opened(env: dict, signer: Signer) -> dict | None:
    """The statement of an envelope whose signature holds."""
    payload = base64.b64decode(env["payload"])
    signed = any(signer.verify(_covered(payload, env["payloadType"]), base64.b64decode(s["sig"])) for s in env["signatures"])
    return json.loads(payload) if signed else None


def attest(entries: DataFrame, signer: Signer) -> DataFrame:
    """(entry_hash, envelope): signed statements in JSON, signed where the rows are."""
    sign = F.udf(lambda s: json.dumps(envelope(s, signer)), "string")
    return statements(entries).select("entry_hash", sign("statement").alias("envelope"))


def chain_breaks(entries: DataFrame) -> DataFrame:
    """(chain, seq, own_ok, link_ok) of the entries (chain, seq, body, prev_hash, entry_hash) that break their chain.

    ``body`` is the hashed text without the entry's own hash; each hash is
    recomputed in parallel, and only the link needs the entry before.
    """
    before = F.lag("entry_hash").over(Window.partitionBy("chain").orderBy("seq"))
    own = F.sha2("body", 256).eqNullSafe(F.col("entry_hash"))
    link = F.coalesce("prev_hash", F.lit("")).eqNullSafe(F.coalesce(before, F.lit("")))
    return entries.select("chain", "seq", own.alias("own_ok"), link.alias("link_ok")).where("NOT own_ok OR NOT link_ok")


def checked(recorded: DataFrame, present: DataFrame) -> DataFrame:
    """(name, sha256, status) of recorded files (name, sha256) against present ones (name, sha256): ok, changed or missing.

    A file is found by its name, or else by the only present name that begins with the recorded one and two underscores.
    """
    stem = F.regexp_extract("name", r"^(.+?)__", 1)
    names = present.select("name", F.col("sha256").alias("now")).dropDuplicates(["name"])
    exact = names.select(F.col("name").alias("n"), F.col("now").alias("by_name"))
    lone = names.where(F.col("name").contains("__")).groupBy(stem.alias("p")).agg(F.count("*").alias("k"), F.max("now").alias("by_stem")).where("k = 1").drop("k")
    j = recorded.join(exact, recorded["name"] == exact["n"], "left").join(lone, recorded["name"] == lone["p"], "left")
    now = F.coalesce("by_name", "by_stem")
    return j.select("name", "sha256", F.when(now.isNull(), "missing").when(now == F.col("sha256"), "ok").otherwise("changed").alias("status"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256) of every file below ``path``, hashed where it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def sealed(body: dict) -> str:
    """``body`` with its hash, as one ledger line."""
    return canonical_json(body | {"entry_hash": hashlib.sha256(canonical_json(body).encode()).hexdigest()})


class FileLedger:
    """A ledger in a local file: an append locks the file, reads its last line only, and writes one."""

    def __init__(self, path: str):
        self.path = path

    def append(self, **entry: object) -> dict:
        import fcntl
        import os

        with open(self.path, "a+b") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            end, tail, step = f.seek(0, os.SEEK_END), b"", 4096
            while end > 0 and b"\n" not in tail.strip():
                at = max(0, end - step)
                f.seek(at)
                tail, end = f.read(end - at) + tail, at
            last = tail.strip().rsplit(b"\n", 1)[-1]
            line = sealed(entry | {"prev_hash": json.loads(last)["entry_hash"] if last else ""})
            f.write(line.encode() + b"\n")
            f.flush()
            os.fsync(f.fileno())
        return json.loads(line)

    def lines(self) -> list[str]:
        try:
            with open(self.path, encoding="utf-8") as f:
                return [x.rstrip("\n") for x in f if x.strip()]
        except FileNotFoundError:
            return []
