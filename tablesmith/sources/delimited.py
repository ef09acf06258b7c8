"""Delimited text of unknown encoding and dialect: binary files to raw rows."""

from __future__ import annotations

import codecs
import csv
import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import normalize_name, unique_names
from ..functions.infer import infer_types
from .pieces import in_pieces

DELIMITERS = ",;\t|"
SAMPLE_CHARS = 64_000
#: Share of high bytes from which a code page is sought, and those that are tried.
HIGH_BYTES = 0.2
CODE_PAGES = ("cp1252", "cp1251", "cp1253", "cp1250", "koi8-r", "cp1255", "cp1256")


def decode(data: bytes) -> tuple[str, str]:
    """(text, encoding): by a byte order mark, UTF-8 if valid, UTF-16 by its zero bytes, then the code page that makes the likeliest letters.

    Few high bytes mean cp1252; where they are dense, each code page is judged
    by how many of its letters stand in words of one script and of plain case.
    """
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace"), name
    try:
        text = data.decode("utf-8")
        if "\0" not in text:
            return text, "utf-8-sig"
    except UnicodeDecodeError:
        pass
    head = data[:SAMPLE_CHARS]
    for k, name in ((1, "utf-16-le"), (0, "utf-16-be")):
        if len(head) > 3 and head[k::2].count(0) > 0.4 * len(head[k::2]) and not head[1 - k :: 2].count(0):
            return data.decode(name, "replace"), name
    dense = sum(x > 127 for x in head) >= HIGH_BYTES * max(1, len(head))
    names = max(CODE_PAGES, key=lambda n: (_likely(head.decode(n, "replace")), -CODE_PAGES.index(n))) if dense else "cp1252"
    for name in (names, "latin-1"):
        try:
            return data.decode(name), name
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace"), "utf-8"


def _likely(text: str) -> float:
    """The share of non-ASCII characters that are letters and go with the letter before: same script, and no capital after a small one."""
    good = bad = 0
    for a, b in itertools.pairwise(text):
        if b < "\x80":
            continue
        if not b.isalpha():
            bad += 1
        elif a.isalpha():
            same = unicodedata.name(a, "").split(" ")[0] == unicodedata.name(b, "").split(" ")[0]
            good, bad = (good + 1, bad) if same and not (a.islower() and b.isupper()) else (good, bad + 1)
    return good / max(1, good + bad)


def delimiter(text: str) -> str:
    """The candidate whose count of fields is steadiest over the lines, the most fields on a tie; a comma if none splits."""
    lines = [x for x in text[:SAMPLE_CHARS].splitlines() if x.strip()][:400]
    best, score = ",", 0.0
    for d in DELIMITERS:
        widths = Counter(len(r) for r in csv.reader(lines, delimiter=d))
        if not widths:
            continue
        width, n = max(widths.items(), key=lambda x: (x[1], x[0]))
        s = n / sum(widths.values()) * (1 - 1 / width) if width > 1 else 0.0
        if s > score:
            best, score = d, s
    return best


def quote(text: str, d: str) -> str:
    """The sign that opens and closes most fields: a double quote unless single quotes do so more often."""
    sides = {q: len(re.findall(rf"(?:^|{re.escape(d)})\s*{q}[^{q}\n]*{q}\s*(?={re.escape(d)}|$)", text[:SAMPLE_CHARS], re.M)) for q in "\"'"}
    return "'" if sides["'"] > sides['"'] else '"'


def looks_delimited(text: str, least: float = 0.7) -> bool:
    """Whether at least ``least`` of the first lines split into one same number of fields above one."""
    lines = [x for x in text[:SAMPLE_CHARS].splitlines() if x.strip()][:400]
    widths = Counter(len(r) for r in csv.reader(lines, delimiter=delimiter(text)))
    width, n = max(widths.items(), key=lambda x: (x[1], x[0]), default=(0, 0))
    return width > 1 and len(lines) > 1 and n >= least * len(lines)


@dataclass
class Block:
    """A run of lines between blank ones; ``no`` is its place among all runs of the file."""

    no: int
    lines: list[str]

    def is_preamble(self, d: str) -> bool:
        """A few ``Label:;value`` lines above a table."""
        first = [x.split(d)[0].strip() for x in self.lines]
        return len(first) <= 8 and sum(x.endswith(":") for x in first) >= 0.6 * len(first)


def runs(text: str) -> list[Block]:
    """The runs of lines between blank ones; signs that only separate fields count as blank."""
    out: list[Block] = []
    for filled, lines in itertools.groupby(text.splitlines(), key=lambda x: bool(x.strip(" \t\r;,|"))):
        if filled:
            out.append(Block(len(out), list(lines)))
    return out


def sorted_blocks(text: str, d: str) -> tuple[list[Block], list[Block]]:
    """(tables, texts): runs of one line, and preambles, are text; if all are, or there is one run, the whole is one table."""
    found = runs(text)
    tables = [b for b in found if len(b.lines) > 1 and not b.is_preamble(d)]
    if len(found) > 1 and tables:
        return tables, [b for b in found if b not in tables]
    return ([Block(0, [x for b in found for x in b.lines])] if found else []), []


def blocks(text: str, d: str) -> list[Block]:
    """The runs that can be tables; the whole text as one block if there is one run or none of them can."""
    return sorted_blocks(text, d)[0]


def _by_file(files: DataFrame, schema: str, rows: Callable[[str, str], Iterator[tuple]]) -> DataFrame:
    """Of (path, content): the rows that ``rows`` gives for each path and decoded text."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator) -> Iterator:
        for pdf in frames:
            yield from in_pieces((r for p, data in zip(pdf["path"], pdf["content"], strict=True) for r in rows(p, decode(bytes(data or b""))[0])), names)

    return files.select("path", "content").mapInPandas(run, schema)


def line_runs(files: DataFrame) -> DataFrame:
    """(path, run, lines) of the runs of each file (path, content)."""
    return _by_file(files, "path string, run int, lines array<string>", lambda p, text: ((p, b.no, b.lines) for b in runs(text)))


def texts_beside(files: DataFrame) -> DataFrame:
    """(path, loc, chunk) of what stands in delimited files beside their tables: titles and preambles, which are kept as text."""
    return _by_file(files, "path string, loc string, chunk string", lambda p, text: ((p, f"block {b.no}", "\n".join(b.lines)) for b in sorted_blocks(text, delimiter(text))[1]))


def repaired(read: Callable[[], Iterator[list[str]]]) -> tuple[Iterator[list[str | None]], int]:
    """Rows of the modal width (the first on a tie), and how many were not: longer ones fold into their last cell, shorter ones are padded.

    ``read`` gives the rows anew: they are read once for their widths and once to be repaired, and not held.
    """

    def filled() -> Iterator[list[str]]:
        return (r for r in read() if any(map(str.strip, r)))

    widths = Counter(map(len, filled()))
    if not widths:
        return iter(()), 0
    width, n = widths.most_common(1)[0]
    fixed = ([*r[: width - 1], " | ".join(r[width - 1 :])] if len(r) > width else [*r, *[None] * (width - len(r))] for r in filled())
    return fixed, sum(widths.values()) - n


def is_number(cell: str | None) -> bool:
    try:
        float((cell or "").replace(",", "").replace("'", ""))
    except ValueError:
        return False
    return True


RAW = "path string, block int, row_no bigint, header array<string>, cells array<string>, malformed int, encoding string"


def raw_rows(spark: SparkSession, path: str, recursive: bool = True, max_bytes: int = 256 << 20) -> DataFrame:
    """One row for each data row of each table of each file below ``path``; dot files are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return parsed(files.where(~F.element_at(F.split("path", "/"), -1).startswith(".")), max_bytes)


def parsed(files: DataFrame, max_bytes: int = 256 << 20) -> DataFrame:
    """One row for each data row of each table of each file (path, content); larger files are refused, not cut."""

    def rows_of(p: str, data: bytes) -> Iterator[tuple]:
        if len(data) > max_bytes:
            raise ValueError(f"{p} has {len(data)} bytes; at most {max_bytes} are read as one file")
        text, encoding = decode(bytes(data))
        d = delimiter(text)
        q = quote(text, d)
        for b in blocks(text, d):
            rows, bad = repaired(lambda b=b: csv.reader(itertools.chain((x + "\n" for x in b.lines[:-1]), b.lines[-1:]), delimiter=d, quotechar=q))
            first = next(rows, None)
            if first is None:
                continue
            if 2 * sum(map(is_number, first)) > len(first):
                head, rows = [f"col_{i}" for i in range(len(first))], itertools.chain([first], rows)
            else:
                head = unique_names(normalize_name(c or "") for c in first)
            yield from ((p, b.no, i, head, r, bad, encoding) for i, r in enumerate(rows))

    def run(frames: Iterator) -> Iterator:
        for pdf in frames:
            yield from in_pieces((r for p, data in zip(pdf["path"], pdf["content"], strict=True) for r in rows_of(p, data)), [x.split()[0] for x in RAW.split(", ")])

    return files.select("path", "content").mapInPandas(run, RAW)


def tables(raw: DataFrame) -> dict[tuple[str, int], DataFrame]:
    """Typed tables by (path, block). The inventory of tables is small and goes to the driver; their rows do not."""
    found = raw.groupBy("path", "block").agg(F.max("header").alias("header")).collect()
    out = {}
    for r in found:
        rows = raw.where((F.col("path") == r["path"]) & (F.col("block") == r["block"]))
        cols = rows.orderBy("row_no").select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(r["header"])])
        out[r["path"], r["block"]] = infer_types(cols)
    return out
