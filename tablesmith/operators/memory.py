"""Schemas, links, mappings, usage, lineage and ledger as relations."""

from __future__ import annotations

import hashlib
import json
from difflib import SequenceMatcher
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

SCHEMA_JACCARD, VALUE_JACCARD, NAME_RATIO = 0.6, 0.30, 0.78
MIN_UNIQUENESS, SAMPLE_VALUES = 0.15, 300


def similar_schemas(schemas: DataFrame, least: float = SCHEMA_JACCARD) -> DataFrame:
    """(a, b, jaccard) of schemas (schema_id, names array) that share that many names. Pairs meet on a shared name, never all with all."""
    one = schemas.select("schema_id", F.size("names").alias("n"), F.explode("names").alias("name"))
    a, b = one.alias("a"), one.alias("b")
    met = a.join(b, (F.col("a.name") == F.col("b.name")) & (F.col("a.schema_id") < F.col("b.schema_id")))
    counts = met.groupBy(F.col("a.schema_id").alias("a"), F.col("b.schema_id").alias("b")).agg(F.count("*").alias("both"), F.max(F.col("a.n") + F.col("b.n")).alias("sum"))
    return counts.withColumn("jaccard", F.round(F.col("both") / (F.col("sum") - F.col("both")), 6)).where(F.col("jaccard") >= least).select("a", "b", "jaccard")


def column_values(table: str, df: DataFrame, columns: list[str], sample: int | None = SAMPLE_VALUES) -> DataFrame:
    """(tbl, col, v): the distinct values of key-like columns; the ``sample`` values of least hash, or all of them.

    The least hashes of two columns are the least of their union, so the share
    that they have in common estimates the likeness of the whole columns.
    """
    pair = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("v")) for c in columns])
    found = df.select(F.inline(pair)).where("v is not null").distinct()
    filled = df.agg(*[F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(columns)]).select(F.inline(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"n{i}").alias("n")) for i, c in enumerate(columns)])))
    keys = found.groupBy("col").agg(F.count("*").alias("d")).join(F.broadcast(filled), "col").where(F.col("d") / F.col("n") >= MIN_UNIQUENESS)
    vals = found.join(F.broadcast(keys), "col", "left_semi").select(F.lit(table).alias("tbl"), "col", F.lower(F.trim("v")).alias("v")).distinct()
    if sample is not None:
        vals = vals.withColumn("_k", F.row_number().over(Window.partitionBy("col").orderBy(F.xxhash64("v"), "v"))).where(F.col("_k") <= sample).drop("_k")
    return vals


def value_links(values: DataFrame, least: float = VALUE_JACCARD) -> DataFrame:
    """(src_table, src_col, dst_table, dst_col, overlap) by an inverted index on the values, of which those that stand in the same columns count as one."""
    held = values.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("tbl", "col"))).alias("held")).groupBy("held").agg(F.count("*").alias("n"))
    one = held.select("held", "n", F.explode("held").alias("a"))
    sizes = one.groupBy("a.tbl", "a.col").agg(F.sum("n").alias("n"))
    met = one.select("n", "a", F.explode("held").alias("b")).where("a.tbl < b.tbl").groupBy(F.col("a.tbl").alias("src_table"), F.col("a.col").alias("src_col"), F.col("b.tbl").alias("dst_table"), F.col("b.col").alias("dst_col")).agg(F.sum("n").alias("both"))
    left = sizes.select(F.col("tbl").alias("src_table"), F.col("col").alias("src_col"), F.col("n").alias("na"))
    right = sizes.select(F.col("tbl").alias("dst_table"), F.col("col").alias("dst_col"), F.col("n").alias("nb"))
    j = met.join(left, ["src_table", "src_col"]).join(right, ["dst_table", "dst_col"])
    j = j.withColumn("overlap", F.round(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")), 6)).where(F.col("overlap") >= least)
    return j.select("src_table", "src_col", "dst_table", "dst_col", "overlap")


def join_query(src_table: str, src_col: str, dst_table: str, dst_col: str) -> str:
    """The join that a link suggests, as a query of the guarded session."""
    return f"SELECT * FROM {src_table} a JOIN {dst_table} b ON a.{src_col} = b.{dst_col}"


def name_ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio; it depends on the order of its arguments."""
    return SequenceMatcher(None, a, b).ratio()


def name_links(columns: list[tuple[str, str]], least: float = NAME_RATIO) -> list[tuple[str, str, str, str, float]]:
    """Links by name between columns (table, column) of a catalogue, which is small."""
    return [(t, c, u, d, round(name_ratio(c, d), 6)) for t, c in columns for u, d in columns if t < u and name_ratio(c, d) >= least]


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def families(members: DataFrame) -> DataFrame:
    """(schema_id, n, tables) of schemas with more than one table."""
    return members.groupBy("schema_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("name")), ",").alias("tables")).where("n > 1")


def closure(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(src, dst, depth) of all that a lineage graph connects, at any depth, cycles too; depth is the length of the shortest path.

    Each round extends only the pairs that the round before found, and keeps
    those not known yet, so a pair is met once whatever the number of its paths.
    """
    one = durable(edges.select(F.col(source).alias("src"), F.col(target).alias("dst")).where("src is not null and dst is not null").distinct())
    known, fresh, depth = [one.withColumn("depth", F.lit(1))], one, 1
    step = one.select(F.col("src").alias("dst"), F.col("dst").alias("far"))
    while fresh.limit(1).count():
        depth += 1
        met = fresh.join(step, "dst").select("src", F.col("far").alias("dst")).distinct()
        seen = reduce(DataFrame.unionByName, known).select("src", "dst")
        fresh = durable(met.join(seen, ["src", "dst"], "left_anti"))
        known.append(fresh.withColumn("depth", F.lit(depth)))
    return reduce(DataFrame.unionByName, known)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, change): added, removed or changed."""
    o, n = old.alias("o"), new.alias("n")
    same = reduce(lambda a, b: a & b, [F.col(f"o.{v}").eqNullSafe(F.col(f"n.{v}")) for v in values])
    change = F.when(F.col(f"o.{key}").isNull(), "added").when(F.col(f"n.{key}").isNull(), "removed").when(~same, "changed")
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), change.alias("change")).where("change is not null")


def canonical_json(entry: dict) -> str:
    return json.dumps(entry, sort_keys=True, separators=(",", ":"), default=str)


class Ledger:
    """Append-only chain: each entry carries the hash of the one before. The last hash is kept, so an append reads nothing."""

    def __init__(self, lines: list[str] | None = None):
        self.lines = list(lines or [])

    def append(self, **entry: object) -> dict:
        prev = json.loads(self.lines[-1])["entry_hash"] if self.lines else ""
        body = entry | {"prev_hash": prev}
        body["entry_hash"] = hashlib.sha256(canonical_json(body).encode()).hexdigest()
        self.lines.append(canonical_json(body))
        return body


def first_break(lines: list[str]) -> int | None:
    """The number of the first entry whose hash or link is wrong."""
    prev = ""
    for i, line in enumerate(lines):
        try:
            e = json.loads(line)
            own = e.pop("entry_hash")
        except (ValueError, KeyError):
            return i
        if e.get("prev_hash") != prev or hashlib.sha256(canonical_json(e).encode()).hexdigest() != own:
            return i
        prev = own
    return None
