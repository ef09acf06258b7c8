"""Names, coarse types, ids and schema fingerprints."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalize_name(name: str) -> str:
    """Lower-case words joined by single underscores; ``col`` if nothing is left."""
    return re.sub(r"_+", "_", re.sub(r"[^\w]+", "_", name.strip().lower())).strip("_") or "col"


def normalized(name: Column) -> Column:
    """:func:`normalize_name` as an expression."""
    words = F.regexp_replace(F.lower(F.regexp_replace(name, r"^\s+|\s+$", "")), r"(?U)[^\w]+", "_")
    bare = F.regexp_replace(F.regexp_replace(words, "_+", "_"), "^_|_$", "")
    return F.when(bare == "", "col").otherwise(bare)


def unique_names(names: Iterable[str]) -> list[str]:
    """Repeats get the first free suffix ``_1``, ``_2``, ..; the result has no repeat, whatever the input."""
    names, taken, out = list(names), set(), []
    for n in names:
        new, k = n, 0
        while new in taken or (k and new in names):
            k += 1
            new = f"{n}_{k}"
        taken.add(new)
        out.append(new)
    return out


def coarse_dtype(kind: T.DataType) -> str:
    if isinstance(kind, T.IntegralType):
        return "int"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "str"


def fingerprint(schema: T.StructType) -> str:
    """16 hex digits that do not depend on the order of the columns."""
    parts = sorted(f"{f.name}:{coarse_dtype(f.dataType)}" for f in schema.fields)
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:16]


def short_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12)
