"""Type inference: one aggregate over all string columns, one projection."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Share of the present values that must parse.
SHARE = 0.9
#: Share of the present values that must look like a date.
DATE_SHARE = 0.8
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?[iI][nN][fF]([iI][nN][iI][tT][yY])?$"
DATE_SHAPE = r"^[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}"
DATE_FORMATS = ("yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s")


def cleaned(v: Column) -> Column:
    """Without blanks, thousands marks and one currency sign at either end."""
    return F.regexp_replace(F.regexp_replace(v, r"[\s,']", ""), "^[€$£]|[€$£]$", "")


def present(v: Column) -> Column:
    return v.isNotNull() & ~F.lower(F.regexp_replace(v, r"^\s+|\s+$", "")).isin("", "none", "nan")


def as_number(v: Column) -> Column:
    c = cleaned(v)
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def _shape(fmt: str) -> str:
    """What text of a date format looks like: four digits for the year, one or two for any other part."""
    parts = re.sub(r"[MdHms]", "[0-9]{1,2}", fmt.replace("'T'", "T").replace(".", r"\."))
    return "^" + parts.replace("yyyy", "[0-9]{4}") + "$"


def as_date(v: Column) -> Column:
    """The first format of DATE_FORMATS that fits, month before day. A format is tried only on text of its shape, for a failed parse is dear."""
    t = F.regexp_replace(v, r"^\s+|\s+$", "")
    return F.coalesce(*[F.when(t.rlike(_shape(f)), F.try_to_timestamp(t, F.lit(f))) for f in DATE_FORMATS])


def infer_types(df: DataFrame) -> DataFrame:
    """``df`` with its string columns cast to bigint, double or timestamp where SHARE of the present values parse.

    An integer column needs an integer in every row; a value that does not
    parse becomes null. An empty or all-missing column stays a string.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return df
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, n in enumerate(names):
        v = F.col(f"`{n}`")
        some = present(v)
        aggs += [
            F.count_if(some).alias(f"n{i}"),
            F.count_if(some & as_number(v).isNotNull()).alias(f"num{i}"),
            F.count_if(cleaned(v).rlike("^[+-]?[0-9]{1,18}$")).alias(f"int{i}"),
            F.count_if(some & as_date(v).isNotNull()).alias(f"date{i}"),
            F.count_if(some & v.rlike(DATE_SHAPE)).alias(f"shape{i}"),
        ]
    s = df.agg(*aggs).first()
    out = {}
    for i, n in enumerate(names):
        v, k = F.col(f"`{n}`"), s[f"n{i}"]
        if not k:
            continue
        if s[f"num{i}"] >= SHARE * k:
            out[n] = cleaned(v).try_cast("bigint") if s[f"int{i}"] == s["rows"] else as_number(v)
        elif s[f"date{i}"] >= SHARE * k and s[f"shape{i}"] > DATE_SHARE * k:
            out[n] = as_date(v)
    return df.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in df.columns])
