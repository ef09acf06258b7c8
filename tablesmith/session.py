"""A session with the settings that the plans are written for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tablesmith", master: str | None = None, **conf: str) -> SparkSession:
    """AQE on, UTC, ANSI; shuffle partitions are left to the cluster unless given."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def durable(df: DataFrame) -> DataFrame:
    """``df`` written where ``spark.checkpoint.dir`` says, its lineage cut; a local session without that setting gets a folder of its own."""
    spark = df.sparkSession
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(path or "file:///tmp/checkpoints/tablesmith")
    return df.checkpoint()
