"""Exact duplicates by deterministic block naming, in DataFrame operations only.

Every text is cut into blocks of a fixed size. The distinct blocks are sorted
into integer names; then each pair of neighbouring names is itself sorted into
a name, and so on until one name is left for each document. Two documents have
the same (level, name) exactly if their normalised texts are the same, because
a name stands for one content at every level.

Scale: a block travels once, after map-side deduplication. It is sorted under a
64-bit digest, and the aggregate that names the digest also proves that it has
one content; a digest with two contents gets its names from the contents
themselves. From there on only integers move. A group of copies meets in
partial aggregates or in the two sides of a join that AQE may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, free_name, one_row_each

#: Characters in a block.
BLOCK_CHARS = 4096
#: Names are integers within so many buckets of the sort order; the bucket is the name's upper part.
BUCKET_BITS = 12


def normalised(text: Column) -> Column:
    """Null as empty; each run of ``[\\x20\\x09-\\x0D]`` as one space. Single spaces need no replacement, so none is made."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def blocks_of(norm: Column, block_chars: int) -> Column:
    cut = F.regexp_extract_all(norm, F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    return F.when(F.length(norm) == 0, F.array(F.lit(""))).otherwise(cut)


def _numbered(keys: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``name``: the rank in the sort order of the first key, by buckets of its upper bits."""
    bucket = F.shiftrightunsigned(F.col(order[0]), 64 - BUCKET_BITS)
    w = Window.partitionBy("_bucket").orderBy(*order)
    return keys.withColumn("_bucket", bucket).withColumn("name", F.shiftleft(F.col("_bucket"), 48) + F.row_number().over(w)).drop("_bucket")


def _first_names(units: DataFrame, texts: DataFrame, block_chars: int, scratch: Scratch) -> DataFrame:
    """(doc_id, rid, n, pos, name) of every block."""
    block = F.explode(blocks_of(F.col("norm"), block_chars)).alias("block")
    distinct = texts.select(block).select(F.xxhash64("block").alias("digest"), "block").distinct()
    variants = distinct.groupBy("digest").agg(F.count("*").alias("contents"))
    names = scratch.write(_numbered(variants, ["digest"]), "names0")
    occ = units.select("doc_id", "rid", F.size("digests").alias("n"), F.posexplode("digests").alias("pos", "digest"))
    named = occ.join(names, "digest").select("doc_id", "rid", "n", "pos", "digest", "name", "contents")
    if names.where("contents > 1").limit(1).count() == 0:
        return named.drop("digest", "contents")
    # Different blocks under one digest: these few get a second sort by content.
    clash = names.where("contents > 1").select("digest")
    parts = texts.select("doc_id", "rid", F.posexplode(blocks_of(F.col("norm"), block_chars)).alias("pos", "block"))
    parts = parts.withColumn("digest", F.xxhash64("block")).join(clash, "digest")
    order = Window.partitionBy("digest").orderBy("block")
    rank = parts.select("digest", "block").distinct().withColumn("variant", F.row_number().over(order))
    parts = parts.join(rank, ["digest", "block"]).select("doc_id", "rid", "pos", "variant").distinct()
    same = (named["doc_id"].eqNullSafe(parts["doc_id"])) & (named["rid"] == parts["rid"]) & (named["pos"] == parts["pos"])
    exact = named.join(parts, same, "left").select(named["doc_id"], named["rid"], "n", named["pos"], (F.col("name") + F.shiftleft(F.coalesce("variant", F.lit(0)).cast("bigint"), 28)).alias("name"))
    return exact


def identities(units: DataFrame, texts: DataFrame, block_chars: int, scratch: Scratch) -> DataFrame:
    """(doc_id, rid, level, name), one row for each (doc_id, rid)."""
    level, done = 0, []
    cur = scratch.write(_first_names(units, texts, block_chars, scratch), "level0")
    while True:
        done.append(cur.where("n = 1").select("doc_id", "rid", F.lit(level).alias("level"), "name"))
        rest = cur.where("n > 1")
        if rest.limit(1).count() == 0:
            break
        level += 1
        side = lambda k: F.max(F.when(F.col("pos") % 2 == k, F.col("name")))
        pairs = rest.groupBy("doc_id", "rid", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(side(0).alias("a"), F.coalesce(side(1), F.lit(-1)).alias("b"))
        pairs = scratch.write(pairs, f"pairs{level}")
        seen = pairs.select("a", "b").distinct()
        mixed = seen.withColumn("mix", F.xxhash64("a", "b"))
        names = _numbered(mixed, ["mix", "a", "b"]).drop("mix")
        cur = scratch.write(pairs.join(names, ["a", "b"]).select("doc_id", "rid", "n", "pos", "name"), f"level{level}")
        scratch.drop(f"pairs{level}")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after :func:`normalised`; a null text is an
    empty one. The smallest id of a group stays; a null id never beats another
    and stays only if its whole group has null ids. Rows that repeat an id and
    its text count in ``group_size`` but only one of them is kept. An empty
    table gives an empty result. Other columns, whatever their names, are not read.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    # rid tells rows apart that share an id but not a text.
    texts = texts.withColumn("rid", F.xxhash64("norm", F.length("norm")))
    digests = F.transform(blocks_of(F.col("norm"), block_chars), lambda b: F.xxhash64(b))
    units = texts.select("doc_id", "rid", F.sha2("norm", 256).alias("text_sha256"), digests.alias("digests"))
    units = units.groupBy("doc_id", "rid", "text_sha256", "digests").agg(F.count("*").alias("n_rows"))
    units = scratch.write(units, "units")
    names = identities(units, texts, block_chars, scratch)
    both = (units["doc_id"].eqNullSafe(names["doc_id"])) & (units["rid"] == names["rid"])
    named = units.join(names, both).select(units["doc_id"], "level", "name", "text_sha256", "n_rows")
    named = scratch.write(named, "named")
    groups = named.groupBy("level", "name").agg(F.min("doc_id").alias("keep_id"), F.sum("n_rows").alias("group_size"))
    # Written, so that the join deals out both sides anew and AQE may split a large group's.
    groups = scratch.write(groups, "groups")
    rows = named.join(groups, ["level", "name"]).select("*", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))).alias("copy"))
    return rows.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the copies, all its columns kept.

    Rows are told apart by id (a null one too) and normalised text; rows that
    repeat both leave the one of least text. Any names of further columns will
    do; an empty table stays one.
    """
    at, own = free_name(docs, "kept_id"), free_name(docs, "kept_text")
    verdict = exact_dedup(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(at), F.col("text_sha256").alias(own))
    content = F.sha2(normalised(docs[text_col]), 256)
    kept = docs.join(verdict, docs[id_col].eqNullSafe(F.col(at)) & (content == F.col(own)), "left_semi")
    return one_row_each(kept, docs, [id_col], F.sha2(normalised(F.col(text_col)), 256), text_col)
