"""Helpers shared by the corpus operators: scratch tables, sampling, key columns."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is missing a local session gets a folder of its own; a
    cluster must name one, because a machine-local path would lose data there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file:///tmp/checkpoints/tablesmith"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """Written tables that cut lineage and outlive executors.

    Tables that a result still reads stay until the interpreter ends; those
    that only an intermediate step read go with :meth:`drop`.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self._path(name))
        return self.spark.read.schema(df.schema).parquet(self._path(name))

    def _delete(self, path: str) -> None:
        jvm, jsc = self.spark._jvm, self.spark.sparkContext._jsc
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)

    def drop(self, name: str) -> None:
        self._delete(self._path(name))

    def clear(self) -> None:
        if self.spark.sparkContext._jsc is not None and self.spark.getActiveSession() is not None:
            self._delete(self.root)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone, whatever the locale."""
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text falls on the remainder; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus)) == remainder, F.lit(False))


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with as many underscores before it as set it apart from the columns of ``df``, whatever their case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def one_row_each(kept: DataFrame, docs: DataFrame, id_cols: list[str], content: Column, text_col: str) -> DataFrame:
    """``kept`` with one row, that of least text, for each id and content, if any id of ``docs`` repeats.

    The row is found by a partial aggregate, so a key with any number of rows
    is combined where they are read.
    """
    if not docs.groupBy(*id_cols).count().where("count > 1").limit(1).count():
        return kept
    row = F.struct(*[kept[f"`{c}`"] for c in kept.columns])
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(id_cols)]
    first = kept.select(*keys, content.alias("content"), F.coalesce(F.col(text_col), F.lit("")).alias("order"), row.alias("row"))
    least = first.groupBy(*[f"k{i}" for i in range(len(id_cols))], "content").agg(F.min_by("row", "order").alias("row"))
    return least.select("row.*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int | tuple[int, int], seed: int = 7) -> DataFrame:
    """(text, y, u) of at most ``per_class`` labelled documents of either class (or a bound for 0 and one for 1).

    The ids are drawn from the labels alone, by the smallest seeded hash, and
    only those (their number is bounded) are broadcast to the scan of the texts.
    ``u`` is a seeded number from 0 to 99 that splits the sample further.
    """
    pool = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).alias("y"))
    rank = F.xxhash64(F.col("doc_id"), F.lit(seed))
    drawn, bounds = None, per_class if isinstance(per_class, tuple) else (per_class, per_class)
    for y in (0, 1):
        part = pool.where(F.col("y") == y).dropDuplicates(["doc_id"]).orderBy(rank, "doc_id").limit(bounds[y])
        drawn = part if drawn is None else drawn.unionByName(part)
    drawn = drawn.withColumn("u", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed + 1)), F.lit(100)))
    ids = docs.sparkSession.createDataFrame(drawn.toPandas(), "doc_id bigint, y int, u bigint")
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    # Of rows that share an id one is drawn, so that the bound holds.
    return found.groupBy("doc_id", "y", "u").agg(F.min("text").alias("text")).select("text", "y", "u")
