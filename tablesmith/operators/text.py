"""Triage, chunks and lexical search of plain text."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS, MAX_CHUNKS, HEAD_LINES = 2500, 60, 400


def lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")


def alpha_ratio(text: Column) -> Column:
    """Letters among the characters that are not blank."""
    solid = F.length(F.regexp_replace(text, r"(?U)\s", ""))
    return F.when(solid > 0, F.regexp_count(text, F.lit(r"\p{L}")) / solid).otherwise(0.0)


def triage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, alpha_ratio, prefix_share, kind): records if letters are few or one two-character line start is in over half of the first lines, else prose."""
    head = F.slice(lines(F.coalesce(F.col(text_col), F.lit(""))), 1, HEAD_LINES)
    base = docs.select(F.col(id_col).alias("doc_id"), head.alias("head")).withColumn("n_lines", F.size("head")).withColumn("alpha_ratio", F.round(alpha_ratio(F.array_join("head", "\n")), 6))
    starts = F.array_sort(F.transform("head", lambda x: F.substring(x, 1, 2)))
    zero = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def count(acc: Column, x: Column) -> Column:
        run = F.when(acc["last"] == x, acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc["most"], run).alias("most"))

    most = F.aggregate(starts, zero, count, lambda acc: acc["most"])
    out = base.withColumn("prefix_share", F.round(F.when(F.col("n_lines") > 0, most / F.col("n_lines")).otherwise(0.0), 6))
    records = (F.col("alpha_ratio") < 0.7) | (F.col("prefix_share") > 0.5)
    return out.select("doc_id", F.col("n_lines").cast("bigint").alias("n_lines"), "alpha_ratio", "prefix_share", F.when(records, "records").otherwise("prose").alias("kind"))


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n\n", size: int = CHUNK_CHARS, most: int = MAX_CHUNKS) -> DataFrame:
    """(doc_id, chunk_no, chunk): paragraphs packed greedily to ``size`` characters, ``most`` chunks a text (the feature's own limit)."""
    part = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), separator), lambda p: F.trim(p) != "")
    zero = F.struct(F.lit("").alias("buf"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        joined = F.when(acc["buf"] == "", p).otherwise(F.concat(acc["buf"], F.lit(separator), p))
        fits = (acc["buf"] == "") | (F.length(joined) <= size)
        return F.struct(F.when(fits, joined).otherwise(p).alias("buf"), F.when(fits, acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["buf"]))).alias("out"))

    packed = F.aggregate(part, zero, step, lambda acc: F.when(acc["buf"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["buf"]))))
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.slice(packed, 1, most)).alias("chunk_no", "chunk"))


def search(docs: DataFrame, query: str, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of the k texts with the most occurrences of the query's terms of over two letters; ties by id."""
    terms = sorted({t for t in query.lower().split() if len(t) > 2})
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    score = F.lit(0).cast("bigint")
    for t in terms:
        score = score + ((F.length(text) - F.length(F.replace(text, F.lit(t), F.lit("")))) / len(t)).cast("bigint")
    return docs.select(F.col(id_col).alias("doc_id"), score.alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(k)


def label_preamble(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", delimiter: str = ";") -> DataFrame:
    """(doc_id, is_preamble): at most eight non-blank lines, 60 % of whose first fields end in a colon."""
    head = lines(F.coalesce(F.col(text_col), F.lit("")))
    labels = F.size(F.filter(head, lambda x: F.trim(F.split(x, delimiter)[0]).endswith(":")))
    n = F.size(head)
    return docs.select(F.col(id_col).alias("doc_id"), ((n > 0) & (n <= 8) & (labels >= 0.6 * n)).alias("is_preamble"))


def modal_width(docs: DataFrame, delimiter: str = ",", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, width, n_lines): the commonest number of fields in a text's lines, the smallest on a tie."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(lines(F.coalesce(F.col(text_col), F.lit("")))).alias("line"))
    counts = rows.groupBy("doc_id", F.size(F.split("line", delimiter)).cast("bigint").alias("width")).agg(F.count("*").alias("n"))
    return counts.groupBy("doc_id").agg(F.max_by("width", F.struct("n", -F.col("width"))).alias("width"), F.sum("n").alias("n_lines"))


