"""File type from name and first bytes, hashes, archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pieces import in_pieces

MAX_ENTRIES, MAX_BYTES, MAX_DEPTH = 500, 500 << 20, 3


# Endings by kind, and entries by which a zip archive is an office file.
ENDINGS = {
    "office": ("doc", "docx", "ppt", "pptx", "odt", "ods", "odp", "rtf"),
    "visum-matrix": ("mtx",),
    "shapefile-part": ("shp", "shx", "dbf", "prj", "cpg", "ctf", "qix", "sbn", "sbx"),
    "archive": ("zip",),
    "csv": ("csv", "tsv"),
    "txt": ("txt", "log", "md", "text", "dat"),
}
ENTRIES = {"xlsx": ("xl/workbook.xml",), "office": ("word/document.xml", "ppt/presentation.xml", "mimetypeapplication/vnd.oasis")}


def file_type(path: Column, content: Column) -> Column:
    """pdf, xlsx, office, archive, xls-legacy, visum-matrix, shapefile-part, csv, txt or unknown.

    The first bytes decide, in a zip archive the names of its entries (which
    stand in it uncompressed), then the name's ending. A file without one is
    text if its first 4096 bytes are, but for a character cut at their end.
    """
    ext = F.lower(F.regexp_extract(F.element_at(F.split(path, "/|::"), -1), r"\.([^.]+)$", 1))
    starts = lambda magic: F.substring(content, 1, len(magic)) == F.lit(magic)
    holds = lambda kind: F.coalesce(*[F.when(F.contains(content, F.lit(e.encode())), True) for e in ENTRIES[kind]], F.lit(False))
    zipped = F.when(holds("xlsx"), "xlsx").when(holds("office") | ext.isin(*ENDINGS["office"]), "office").otherwise("archive")
    head = F.coalesce(*[F.when(F.is_valid_utf8(x.cast("string")), True) for x in (F.substring(content, 1, 4096 - k) for k in range(4))], F.lit(False))
    kind = F.when(starts(b"%PDF"), "pdf").when(starts(b"PK\x03\x04"), zipped).when(starts(b"\xd0\xcf\x11\xe0"), F.when(ext.isin(*ENDINGS["office"]), "office").otherwise("xls-legacy"))
    for name, endings in ENDINGS.items():
        kind = kind.when(ext.isin(*endings), name)
    return kind.when((ext == "") & head, "txt").otherwise("unknown")


def described(files: DataFrame) -> DataFrame:
    """binaryFile rows with content_hash, doc_type and name."""
    return files.withColumns({"content_hash": F.sha2("content", 256), "doc_type": file_type(F.col("path"), F.col("content")), "name": F.element_at(F.split("path", "/"), -1)})


def distinct_contents(found: DataFrame) -> DataFrame:
    """One row for each content_hash of described files: that of the first path, and how many files have it. Copies are combined where they are read."""
    rest = [c for c in found.columns if c != "content_hash"]
    first = found.groupBy("content_hash").agg(F.min_by(F.struct(*rest), "path").alias("f"), F.count("*").alias("copies"))
    return first.select("content_hash", "f.*", "copies")


def not_seen(files: DataFrame, seen: DataFrame, force: bool = False) -> DataFrame:
    """Files whose content is not among the ingested ones of ``seen`` (content_hash, status)."""
    if force:
        return files
    done = seen.where(F.col("status").isin("ingested", "partial")).select("content_hash")
    return files.join(done, "content_hash", "left_anti")


def entries(data: bytes) -> list[tuple[str, bytes]]:
    """The files of a zip archive; ValueError for too many, too large, or a path that leaves it."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
        if len(infos) > MAX_ENTRIES or sum(i.file_size for i in infos) > MAX_BYTES:
            raise ValueError("archive has too many or too large entries")
        for i in infos:
            p = PurePosixPath(i.filename.replace("\\", "/"))
            if p.is_absolute() or ".." in p.parts:
                raise ValueError(f"archive entry leaves the archive: {i.filename}")
        return [(i.filename, z.read(i)) for i in infos]


def expand_archives(files: DataFrame) -> DataFrame:
    """(path, content) with archives replaced by their entries, to MAX_DEPTH; an entry's path is ``archive::entry``. Deeper or broken ones stay as they are."""

    def walk(path: str, data: bytes, depth: int) -> Iterator[tuple[str, bytes]]:
        office = path.lower().rsplit(".", 1)[-1] in ENDINGS["office"] or any(e.encode() in data for names in ENTRIES.values() for e in names)
        if data[:4] != b"PK\x03\x04" or office or depth >= MAX_DEPTH:
            yield path, data
            return
        try:
            inner = entries(data)
        except (ValueError, zipfile.BadZipFile):
            yield path, data
            return
        for name, content in inner:
            yield from walk(f"{path}::{name}", content, depth + 1)

    def run(frames: Iterator) -> Iterator:
        for pdf in frames:
            yield from in_pieces((x for p, c in zip(pdf["path"], pdf["content"], strict=True) for x in walk(p, bytes(c), 0)), ["path", "content"])

    return files.select("path", "content").mapInPandas(run, "path string, content binary")


def as_zip(files: dict[str, bytes]) -> bytes:
    """A zip archive of the given files, always with the same bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n in sorted(files):
            z.writestr(zipfile.ZipInfo(n), files[n])
    return out.getvalue()
