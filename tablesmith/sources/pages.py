"""Page kinds, markdown splits and the steps up to a layout engine. Rendering and recognition themselves are plug-ins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_TEXT_CHARS, SCANNED_COVERAGE, MANY_DRAWINGS, MAX_LAYOUT_PAGES = 80, 0.5, 20, 40
CHUNK_CHARS = 2500


def page_kind(text_chars: Column, coverage: Column, drawings: Column) -> Column:
    """text, mixed, scanned, vector or empty; a null feature counts as none."""
    chars, cover, drawn = F.coalesce(text_chars, F.lit(0)), F.coalesce(coverage, F.lit(0.0)), F.coalesce(drawings, F.lit(0))
    image = cover >= SCANNED_COVERAGE
    return (
        F.when((chars >= MIN_TEXT_CHARS) & image, "mixed")
        .when(chars >= MIN_TEXT_CHARS, "text")
        .when(image, "scanned")
        .when(chars > 0, "text")
        .when(drawn > MANY_DRAWINGS, "vector")
        .otherwise("empty")
    )


def needs_layout(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, needs_layout) of documents in ``pages`` (doc_id, kind): one has a scanned or vector page or no row in ``tables`` (doc_id), and few enough pages."""
    docs = pages.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or(F.col("kind").isin("scanned", "vector")).alias("drawn"))
    j = docs.join(tables.select("doc_id", F.lit(True).alias("has")).distinct(), "doc_id", "left")
    return j.select("doc_id", ((F.col("drawn") | F.col("has").isNull()) & (F.col("n") <= MAX_LAYOUT_PAGES)).alias("needs_layout"))


def markdown_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, chunk_no, chunk): sections begin before headings of level one to four and are packed in order to about ``size`` characters; none is cut, blank ones go."""
    parts = F.split(F.coalesce(F.col(text_col), F.lit("")), r"(?m)(?=^#{1,4} )")
    zero = F.array().cast("array<string>")

    def step(acc: Column, p: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fits = last.isNotNull() & (F.length(last) + F.length(p) <= size)
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, p)))).otherwise(F.concat(acc, F.array(p)))

    cut = F.filter(F.transform(F.aggregate(parts, zero, step), lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")), lambda c: c != "")
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(cut).alias("chunk_no", "chunk"))
