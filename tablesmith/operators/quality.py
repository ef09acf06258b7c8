"""Profiles, confidence, learned contracts, drift, declared contracts."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import coarse_dtype

# Confidence by extraction method and penalties by flag.
PRIORS = {"csv": 0.95, "xlsx-island": 0.90, "script": 0.90, "office": 0.85, "pdf-docling": 0.85, "pdf-table": 0.80, "agent": 0.85, "vision": 0.65}
OTHER_PRIOR = 0.70
PENALTIES = {"malformed_rows": 0.10, "merged_header_uncertain": 0.08, "multi_row_header": 0.03, "no_obvious_header": 0.10, "weak_header_names": 0.05, "single_row_island": 0.15}
OTHER_PENALTY = 0.05
REVIEW_BELOW = 0.80
NULL_SLACK, RANGE_SLACK = 0.15, 0.5


def _numeric(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType))


def _slotted(c: Column, kind: T.DataType) -> tuple[str, Column]:
    """The slot in which a column's values are counted with those of others, and the values in its type: whole numbers, floating ones, or each type by itself."""
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return "bigint", c.cast("bigint")
    return ("double", c.cast("double")) if isinstance(kind, (T.FloatType, T.DoubleType)) else (kind.simpleString(), c)


def profile(df: DataFrame) -> DataFrame:
    """(column, dtype, rows, nulls, distinct, lo, hi) of every column; lo and hi of numbers as double.

    Distinct values are counted as rows of (column, value), one scan for each
    slot of types, so that a task's table has no wide key for each of them.
    """
    aggs, parts, slots = [F.count(F.lit(1)).alias("rows")], [], {}
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        number = c.cast("double") if _numeric(f.dataType) else F.lit(None).cast("double")
        aggs += [F.count_if(c.isNull()).alias(f"n{i}"), F.min(number).alias(f"l{i}"), F.max(number).alias(f"h{i}")]
        parts.append(F.struct(F.lit(f.name).alias("column"), F.lit(coarse_dtype(f.dataType)).alias("dtype"), F.col("rows"), F.col(f"n{i}").alias("nulls"), F.coalesce(F.try_element_at("d", F.lit(i)), F.lit(0).cast("bigint")).alias("distinct"), F.col(f"l{i}").alias("lo"), F.col(f"h{i}").alias("hi")))
        slot, value = _slotted(c, f.dataType)
        slots.setdefault(slot, []).append(F.struct(F.lit(i).alias("i"), value.alias("v")))
    values = [df.select(F.inline(F.array(*s))).where("v is not null").distinct().groupBy("i").agg(F.count("*").alias("d")) for s in slots.values()]
    counts = reduce(DataFrame.unionByName, values).agg(F.map_from_entries(F.collect_list(F.struct("i", "d"))).alias("d"))
    return df.agg(*aggs).crossJoin(F.broadcast(counts)).select(F.inline(F.array(*parts)))


def contracts(profiled: DataFrame) -> DataFrame:
    """(column, dtype, null_ratio_max, lo, hi): what later deliveries are held to."""
    ratio = F.when(F.col("rows") > 0, F.col("nulls") / F.col("rows")).otherwise(0.0)
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.greatest(F.abs("hi"), F.lit(1.0)))
    return profiled.select("column", "dtype", F.round(F.least(F.lit(1.0), ratio + NULL_SLACK), 3).alias("null_ratio_max"), (F.col("lo") - RANGE_SLACK * span).alias("lo"), (F.col("hi") + RANGE_SLACK * span).alias("hi"))


def drift(profiled: DataFrame, known: DataFrame) -> DataFrame:
    """(column, issue): missing or new columns, another coarse type, too many nulls, values out of range."""
    p, k = profiled.alias("p"), known.alias("k")
    j = p.join(k, F.col("p.column") == F.col("k.column"), "full")
    ratio = F.when(F.col("p.rows") > 0, F.col("p.nulls") / F.col("p.rows")).otherwise(0.0)
    here = F.col("p.column").isNotNull() & F.col("k.column").isNotNull()
    issues = F.array_compact(
        F.array(
            F.when(F.col("p.column").isNull(), "missing_column"),
            F.when(F.col("k.column").isNull(), "new_column"),
            F.when(here & (F.col("p.dtype") != F.col("k.dtype")), "dtype_changed"),
            F.when(here & (ratio > F.col("k.null_ratio_max")), "null_ratio"),
            F.when(here & ((F.col("p.lo") < F.col("k.lo")) | (F.col("p.hi") > F.col("k.hi"))), "out_of_range"),
        )
    )
    return j.select(F.coalesce("p.column", "k.column").alias("column"), F.explode(issues).alias("issue"))


def flag_penalty(flag: Column) -> Column:
    cases = F.lit(OTHER_PENALTY)
    for name, cost in PENALTIES.items():
        cases = F.when(flag == name, cost).otherwise(cases)
    return cases


def confidence(tables: DataFrame) -> DataFrame:
    """Adds confidence and needs_review to (method, names, first_row, null_heavy, flags, rows): one row for each table.

    names and first_row are arrays of strings, null_heavy counts columns that
    are over 60 % null. A table without rows has confidence 0.
    """
    prior = F.lit(OTHER_PRIOR)
    for m, p in PRIORS.items():
        prior = F.when(F.col("method") == m, p).otherwise(prior)
    n = F.size("names")
    weak = F.size(F.filter("names", lambda c: c.rlike("^(col_|unnamed)"))) / F.greatest(n, F.lit(1))
    same = F.size(F.filter(F.arrays_zip("names", "first_row"), lambda z: F.lower(F.trim(z["first_row"])) == F.lower(z["names"])))
    repeats = F.when(same >= F.greatest(F.lit(2), F.floor(n / 2)), 0.15).otherwise(0.0)
    heavy = F.least(F.lit(0.15), 0.04 * F.col("null_heavy"))
    flags = F.aggregate(F.coalesce("flags", F.array().cast("array<string>")), F.lit(0.0), lambda acc, f: acc + flag_penalty(f))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), prior - 0.15 * weak - repeats - heavy - flags))
    score = F.when(F.col("rows") > 0, F.round(score, 6)).otherwise(0.0)
    return tables.withColumn("confidence", score).withColumn("needs_review", F.col("confidence") < REVIEW_BELOW)


@dataclass(frozen=True)
class Field:
    """A column of a declared contract."""

    name: str
    dtype: str = "str"
    required: bool = False
    nullable: bool | None = None
    allowed: tuple = field(default_factory=tuple)
    unit: str = ""
    description: str = ""
    title: str = ""

    @property
    def may_be_null(self) -> bool:
        return not self.required if self.nullable is None else self.nullable


SPARK_TYPES = {"str": "string", "int": "bigint", "float": "double", "date": "timestamp", "bool": "boolean"}


def _mapped(df: DataFrame, f: Field, spec: dict) -> Column:
    """A declared column's value before it is held to its type: text keeps what a cast cannot take."""
    if "const" in spec:
        return F.lit(spec["const"])
    if spec.get("source") not in df.columns:
        return F.lit(None).cast(SPARK_TYPES[f.dtype])
    raw = F.col(f"`{spec['source']}`")
    if "cast" not in spec and "scale" not in spec:
        return raw
    kind = SPARK_TYPES.get(spec.get("cast", f.dtype), SPARK_TYPES[f.dtype])
    read = typed(raw, kind)
    if "scale" in spec:
        read = (read.cast("double") if kind in ("bigint", "double") else raw.try_cast("double")) * F.lit(spec["scale"])
        return F.coalesce(read.cast("string"), raw.cast("string")) if isinstance(df.schema[spec["source"]].dataType, T.StringType) else read
    return F.coalesce(read.cast("string"), raw.cast("string"))


def typed(c: Column, kind: str) -> Column:
    """A value as a declared type, null if it is none of it; a number with a fraction is no integer, ``yes`` and ``0`` are booleans."""
    word = F.trim(c.cast("string"))
    if kind == "bigint":
        number = word.try_cast("double")
        return F.when(word.rlike("^[+-]?[0-9]+$"), word.try_cast("bigint")).when(number == F.floor(number), number.try_cast("bigint"))
    if kind == "boolean":
        low = F.lower(word)
        return F.when(low.isin("true", "t", "yes", "y", "1"), True).when(low.isin("false", "f", "no", "n", "0"), False)
    return c.cast("string") if kind == "string" else word.try_cast(kind)


def apply_mapping(df: DataFrame, fields: list[Field], mapping: dict[str, dict]) -> DataFrame:
    """One projection to the declared columns. mapping: target -> {source | const, cast, scale}; unmapped columns are null.

    A value that its declared type cannot take is null here; :func:`conformed`
    keeps it and sends its row to quarantine.
    """
    return df.select(*[typed(_mapped(df, f, mapping.get(f.name, {})), SPARK_TYPES[f.dtype]).alias(f.name) for f in fields])


def enforce(df: DataFrame, fields: list[Field]) -> DataFrame:
    """The declared columns in their types, and ``errors``: what a row breaks of its contract.

    A value that is none of its type, a null where none may be, and a value
    that is not allowed are errors; the first two exclude each other. Good rows
    have no error; the others go to quarantine with the values they came with,
    so none is lost. A column that is missing counts as null.
    """
    checks, out = [], []
    for f in fields:
        raw = F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None).cast("string")
        read = typed(raw, SPARK_TYPES[f.dtype])
        checks.append(F.when(raw.isNotNull() & read.isNull(), f"{f.name}: not {f.dtype}"))
        if not f.may_be_null:
            checks.append(F.when(raw.isNull(), f"{f.name}: null"))
        if f.allowed:
            checks.append(F.when(raw.isNotNull() & ~raw.cast("string").isin(*map(str, f.allowed)), f"{f.name}: not allowed"))
        out.append(F.struct(read.alias("value"), raw.cast("string").alias("raw")).alias(f.name))
    return df.select(*out, F.array_compact(F.array(*checks)).alias("errors"))


def conformed(df: DataFrame, fields: list[Field], mapping: dict[str, dict]) -> DataFrame:
    """A table mapped to its declared columns and held to them, as :func:`enforce` gives it."""
    return enforce(df.select(*[_mapped(df, f, mapping.get(f.name, {})).alias(f.name) for f in fields]), fields)


def good(annotated: DataFrame) -> DataFrame:
    """The rows without errors, in their declared types."""
    return annotated.where(F.size("errors") == 0).select(*[F.col(f"`{c}`.value").alias(c) for c in annotated.columns if c != "errors"])


def quarantine(annotated: DataFrame) -> DataFrame:
    """The rows with errors, as text, and their errors as a JSON document."""
    bad = annotated.where(F.size("errors") > 0)
    return bad.select(*[F.col(f"`{c}`.raw").alias(c) for c in annotated.columns if c != "errors"], F.to_json(F.struct("errors")).alias("errors"))
