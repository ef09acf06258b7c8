"""Benchmark decontamination by a hash set of normalised n-grams, in DataFrame operations only.

One pass splits each text into words, hashes every word once and combines the
hashes of neighbours by doubling (1, 2, 4, 8, then the width), so a window costs
a few hashes and no string. A bitmap over the benchmark's window hashes, with a
fixed number of bits for each window, is part of the plan that the executors
get; windows that it lets through become rows, with their words, and the join
on hash and words verifies each. A benchmark of more than PASS_WINDOWS windows
is dealt by hash over several passes, each with a bitmap of the same bounded
size; the windows of the documents are never shuffled as a whole.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, free_name

WINDOW = 13
#: Bits of the bitmap for each window (two are set), at least as many in all, and the windows of a pass: a bitmap has 2 MB at most.
BITS_PER_WINDOW, MIN_BITS, PASS_WINDOWS = 32, 1 << 12, 1 << 19
# What stands between words, one by one: a class of single characters is a table for the regex engine, one of ranges is not.
_ASCII_DELIMITERS = [chr(c) for c in range(0x80) if not chr(c).isalnum()]
DELIMITER = "[" + "".join(f"\\x{ord(c):02x}" for c in _ASCII_DELIMITERS) + "]"
#: A word of text as it is, with what stands before it.
PIECE = DELIMITER + "*[^" + DELIMITER[1:-1] + "]+"


def words_of(text: Column) -> Column:
    """The lower-cased words; the sentinels at both ends keep empty strings out."""
    cut = F.split(F.concat(F.lit("x "), ascii_lower(F.coalesce(text, F.lit(""))), F.lit(" x")), DELIMITER + "+")
    return F.slice(cut, 2, F.size(cut) - 2)


def _doubled(of: str, by: int) -> Column:
    return F.transform(of, lambda h, i: F.xxhash64(h, F.get(of, i + by)))


def _with_windows(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds ``_w{n}`` for each length: the hash of the n words from each position on; positions too near the end have hashes of fewer words."""
    widths = {1}
    for n in lengths:
        widths |= {1 << k for k in range(n.bit_length()) if 1 << k <= n} | {n}
    out = df.withColumn("_w1", F.transform("words", lambda w: F.xxhash64(w)))
    for n in sorted(widths - {1}):
        half = max(k for k in widths if k < n and 2 * k >= n)
        out = out.withColumn(f"_w{n}", _doubled(f"_w{half}", n - half))
    return out


def _windows(lengths: list[int], test: Callable[[Column], Column]) -> Column:
    """Of (words, _w...): array of (pos, n, h, w) of the windows whose hash passes ``test``."""

    def of(n: int) -> Column:
        text = lambda i: F.concat_ws(" ", *[F.get("words", i + k) for k in range(n)])
        whole = lambda i: i + n <= F.size("words")
        found = F.transform(f"_w{n}", lambda h, i: F.when(test(h) & whole(i), F.struct(i.alias("pos"), F.lit(n).alias("n"), h.alias("h"))))
        return F.transform(F.array_compact(found), lambda x: F.struct(x["pos"].alias("pos"), x["n"].alias("n"), x["h"].alias("h"), text(x["pos"]).alias("w")))

    return of(lengths[0]) if len(lengths) == 1 else F.concat(*[of(n) for n in lengths])


def benchmark_windows(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(w, n, h, items): every distinct window, its number of words, its hash, and the ids (as strings) of the items that have it."""
    items = bench.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("least", F.least(F.size("words"), F.lit(width)))
    lengths = sorted(r["least"] for r in items.select("least").distinct().collect())  # width at most
    if not lengths:
        return items.select(F.lit("").alias("w"), "least", F.lit(0).cast("bigint").alias("h"), F.array("item").alias("items")).withColumnRenamed("least", "n")
    own = F.filter(_windows(lengths, lambda h: F.lit(True)), lambda x: x["n"] == F.col("least"))
    rows = _with_windows(items, lengths).select("item", F.explode(own).alias("g"))
    return rows.select("item", "g.w", "g.n", "g.h").groupBy("w", "n", "h").agg(F.collect_set("item").alias("items"))


def _bitmap(windows: DataFrame, bits: int) -> Column:
    """An array of bigint with two bits set for each window, a constant of the plan: ``bits`` / 64 rows at most reach the driver."""
    at = windows.select(F.explode(F.array(*_probes(F.col("h"), bits))).alias("at"))
    slots = at.select(F.shiftright("at", 6).alias("slot"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at").bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    words = [0] * (bits >> 6)
    for r in slots.groupBy("slot").agg(F.bit_or("bit").alias("word")).collect():
        words[r["slot"]] = r["word"]
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")


def _probes(h: Column, bits: int) -> list[Column]:
    mask = F.lit(bits - 1).cast("bigint")
    return [h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask)]


def _may_have(bitmap: Column, h: Column, bits: int) -> Column:
    one, two = (F.call_function("shiftrightunsigned", F.get(bitmap, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1 for p in _probes(h, bits))
    return one & two


def _tested(bitmap: Column, bits: int, passes: int, k: int) -> Callable[[Column], Column]:
    return lambda h: _may_have(bitmap, h, bits) if passes == 1 else (F.pmod(h, F.lit(passes)) == k) & _may_have(bitmap, h, bits)


def row_id(text: Column) -> Column:
    """Tells rows apart that share an id but not a text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _scanned(docs: DataFrame, bench: DataFrame, id_col: str, text_col: str, width: int, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, rid, n_words, found) of each row, and (doc_id, rid, hit, items) of each text with verified windows: hit has the (pos, n) in order."""
    rows = docs.select(F.col(id_col).alias("doc_id"), row_id(F.col(text_col)).alias("rid"), words_of(F.col(text_col)).alias("words"))
    windows = scratch.write(benchmark_windows(bench, width=width), "windows")
    shape = windows.agg(F.collect_set("n").alias("lengths"), F.count("*").alias("count")).first()
    if not shape["lengths"]:
        return rows.select("doc_id", "rid", F.size("words").cast("bigint").alias("n_words")), None
    lengths, passes = sorted(shape["lengths"]), -(-shape["count"] // PASS_WINDOWS)
    hashed, n_words, own = _with_windows(rows, lengths), F.size("words").cast("bigint"), F.pmod(windows["h"], F.lit(passes))
    bits, scans = max(MIN_BITS, 1 << (BITS_PER_WINDOW * min(shape["count"], PASS_WINDOWS) - 1).bit_length()), []
    for k in range(passes):
        bitmap = _bitmap(windows.where(own == k), bits)
        found = _windows(lengths, _tested(bitmap, bits, passes, k))
        scans.append(scratch.write(hashed.select("doc_id", "rid", n_words.alias("n_words"), found.alias("found")), f"scan{k}"))
    scan = reduce(DataFrame.unionByName, scans)
    seen = scan.where(F.size("found") > 0).select("doc_id", "rid", F.explode("found").alias("f")).select("doc_id", "rid", "f.pos", "f.n", "f.h", "f.w")
    hits = seen.join(windows.select("h", "w", "items"), ["h", "w"])
    facts = hits.groupBy("doc_id", "rid").agg(F.array_sort(F.collect_set(F.struct("pos", "n"))).alias("hit"), F.collect_set("items").alias("items"))
    return scans[0], scratch.write(facts, "facts")


def _spans(hit: Column) -> Column:
    """Disjoint (at, end) of the sorted (pos, n), in order."""
    start = F.array().cast("array<struct<at:int,end:int>>")

    def step(acc: Column, x: Column) -> Column:
        last, end = F.element_at(acc, -1), x["pos"] + x["n"]
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["at"].alias("at"), F.greatest(last["end"], end).alias("end"))))
        fresh = F.concat(acc, F.array(F.struct(x["pos"].alias("at"), end.alias("end"))))
        return F.when(F.size(acc) == 0, fresh).when(x["pos"] <= last["end"], grown).otherwise(fresh)

    return F.aggregate(hit, start, step)


def _covered(hit: Column) -> Column:
    """How many words the sorted (pos, n) cover."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        end = x["pos"] + x["n"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], x["pos"]))).alias("n"))

    return F.aggregate(hit, zero, step, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in any occurrence of a window; a text is
    contaminated if a twentieth of its words or more are hit. Null and empty
    texts have no words and are clean. An item without words has no window, one
    with a null id hits words but is not named. Repeated rows give repeated
    rows, empty tables an empty result or no hits; other columns are not read.
    """
    return verdicts(docs, bench, id_col, text_col, width).drop("rid")


def verdicts(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """As :func:`decontaminate`, with rid: :func:`row_id` of the text."""
    scan, facts = _scanned(docs, bench, id_col, text_col, width, Scratch(docs.sparkSession, "decontaminate"))
    counted = scan.select("doc_id", "rid", "n_words")
    if facts is None:
        return counted.select("doc_id", "rid", "n_words", F.lit(0).cast("bigint").alias("n_hit"), F.lit(0).cast("bigint").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"))
    found = facts.select("doc_id", "rid", _covered(F.col("hit")).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("names"))
    out = counted.join(found, counted["doc_id"].eqNullSafe(found["doc_id"]) & (counted["rid"] == found["rid"]), "left")
    n_hit, names = F.coalesce("n_hit", F.lit(0)).cast("bigint"), F.coalesce("names", F.array().cast("array<string>"))
    return out.select(counted["doc_id"], counted["rid"], "n_words", n_hit.alias("n_hit"), F.size(names).cast("bigint").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_share: float = 0.0) -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark in ``min_share`` of their words or more, all columns kept.

    At 0 any verified window drops the row, so no passage stays in what is
    kept. Rows are told apart by id (a null one too) and text; null and empty
    texts stay; an empty table or benchmark drops nothing.
    """
    at, rid = free_name(docs, "bad_id"), free_name(docs, "bad_rid")
    bad = verdicts(docs, bench, id_col, text_col).where((F.col("n_hit") > 0) & (F.col("n_hit") >= min_share * F.col("n_words")))
    bad = bad.select(F.col("doc_id").alias(at), F.col("rid").alias(rid)).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(F.col(at)) & (row_id(docs[text_col]) == F.col(rid)), "left_anti")


def strip_spans(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of each row without the words that a window covers and what stands before each; the rest keeps its case and punctuation.

    A text without hits is left as it is, null too.
    """
    _, facts = _scanned(docs, bench, id_col, text_col, WINDOW, Scratch(docs.sparkSession, "strip"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("rid", row_id(F.col("text")))
    if facts is None:
        return rows.select("doc_id", "text")
    spans = facts.select("doc_id", "rid", _spans(F.col("hit")).alias("spans"))
    both = rows.join(spans, rows["doc_id"].eqNullSafe(spans["doc_id"]) & (rows["rid"] == spans["rid"]), "left")
    pieces = F.regexp_extract_all("text", F.lit(PIECE), F.lit(0))
    both = both.select(rows["doc_id"], "text", "spans", F.when(F.col("spans").isNotNull(), pieces).alias("pieces"))
    ends = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["end"]))
    starts = F.concat(F.transform("spans", lambda s: s["at"]), F.array(F.size("pieces")))
    kept = F.flatten(F.zip_with(ends, starts, lambda a, b: F.slice(F.col("pieces"), a + 1, b - a)))
    tail = F.regexp_extract("text", DELIMITER + "*$", 0)
    return both.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.concat(F.array_join(kept, ""), tail)).alias("text"))
