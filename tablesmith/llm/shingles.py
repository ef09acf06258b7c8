"""Near-duplicates by the Jaccard similarity of word shingles: SimHash and its segment-count embedding for candidates, then an exact check.

At similarity 0.8 the SimHashes of two texts lie up to 17 of 64 bits apart on
the test tables, where no grid over 64 bits selects. A set of shingles so has a
wide SimHash (:func:`simhash.votes`, 2,048 bits) and lies in one cell of each
of its 240 grids (:func:`simhash.wide_cells`). Two sets of similarity 0.8 share
12 cells or more on average and none with a probability of about one in 100,000.

Candidates share a cell and are joined by range: the Manhattan distance of their
embeddings must not exceed :func:`simhash.reach`. A set's sketch is the parity
of its hashes in 64 * SKETCH segments. The distance of two sketches never
exceeds the number of shingles that the sets do not share, so the join drops a
pair whose sketches lie too far apart for the similarity too, and no link is
lost by that. What is left is decided by the shingles of both texts. Sketches
folded to half their longs keep that bound and go along with a cell's members,
so that a pair too far apart by them is dropped in its cell, before any join.

A cell first ties its members to pivots, which is linear and leaves one
component of a group of near copies: at first the cells of some grids, so that a
large group has few edges, then all that still hold several components. Only
what is then in different components of a cell, and within range, is paired,
without a cap.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import Scratch, free_name, one_row_each
from .graph import components

WIDTH = 5
SIMILARITY = 0.8
#: Longs of a sketch and of a folded one, rounds of pivots, the grids of the first round, and the orders by which a round takes its pivots.
SKETCH = 8
FOLDED = SKETCH // 2
PIVOT_ROUNDS = 2
FIRST_GRIDS = 16
PIVOT_ORDERS = 32


def shingle_set(text: str | None, width: int = WIDTH) -> frozenset[int]:
    """The hashes of the word shingles; a text of fewer words is one shingle, one without words has none."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return frozenset()
    return frozenset(xxh64_intdigest(b" ".join(words[i : i + width])) for i in range(max(1, len(words) - width + 1)))


def similarity(a: frozenset[int], b: frozenset[int]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def signature(shingles: frozenset[int]) -> tuple:
    """The hash of the set, its size, its cells, its sketch and the kept bits of its wide SimHash, all signed; the empty set has no cell."""
    import numpy as np
    from xxhash import xxh64_intdigest

    h = np.sort(np.fromiter(shingles, np.uint64, len(shingles)))
    node = xxh64_intdigest(h.tobytes())
    node = node - (1 << 64) if node >= 1 << 63 else node
    if not len(h):
        return node, 0, [], [0] * SKETCH, [0] * simhash.KEPT
    odd_bits = np.packbits(np.bincount(((h >> np.uint64(20)) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1, bitorder="little").view("<i8")
    votes = simhash.votes(h)
    return node, len(h), simhash.wide_cells(votes).tolist(), odd_bits.tolist(), simhash.kept_bits(votes).tolist()


def row_id(text: Column) -> Column:
    """Tells rows apart that share an id but not a text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, rid, node, size, keys, sketch, bits) of every row of (doc_id, rid, text); equal sets of shingles have one node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        kinds = {"node": pa.int64(), "size": pa.int32(), "keys": ints, "sketch": longs, "bits": longs}
        for b in batches:
            # Slices bound the lists held; one set at a time, as the sets of a batch would be many times its texts.
            for at in range(0, b.num_rows, 512):
                c = b.slice(at, 512)
                got = zip(*[signature(shingle_set(t.as_py(), width)) for t in c.column(2)], strict=True)
                own = [pa.array(x, kind) for x, kind in zip(got, kinds.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), *own], names=["doc_id", "rid", *kinds])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "rid", "text").mapInArrow(run, f"doc_id {kind}, rid bigint, node bigint, size int, keys array<int>, sketch array<bigint>, bits array<bigint>")


def folded(sketch: Column) -> Column:
    """The parities of half as many segments, each two of the sketch's; the distance never grows by it."""
    return F.array(*[F.get(sketch, F.lit(i)).bitwiseXOR(F.get(sketch, F.lit(i + FOLDED))) for i in range(FOLDED)])


def may_be_similar(size_a: Column, sketch_a: Column, size_b: Column, sketch_b: Column, least: float, longs: int = SKETCH) -> Column:
    """False only for sets of less similarity: a similarity s leaves (1 - s) / (1 + s) of both sizes unshared at most, and the sketches differ in no more bits."""
    apart = sum((F.bit_count(F.get(sketch_a, F.lit(i)).bitwiseXOR(F.get(sketch_b, F.lit(i)))) for i in range(longs)), F.lit(0))
    return apart <= F.floor((size_a + size_b) * ((1 - least) / (1 + least)) + 1e-6)


def verified(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose shingles are as similar as ``least``; texts has node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(maxsize=64)(lambda t: shingle_set(t, width))
        for b in batches:
            good = [similarity(known(x.as_py()), known(y.as_py())) >= least for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = one.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def in_range(a: str, b: str, least: float) -> Column:
    """Whether the nodes of two structs (size, sketch, embedded) lie near enough in the embedding and by sketch."""
    near = simhash.distance(F.col(f"{a}.embedded"), F.col(f"{b}.embedded")) <= simhash.reach(least)
    return near & may_be_similar(F.col(f"{a}.size"), F.col(f"{a}.sketch"), F.col(f"{b}.size"), F.col(f"{b}.sketch"), least)


def links(own: DataFrame, docs: DataFrame, scratch: Scratch, width: int, least: float) -> DataFrame:
    """(a, b) edges that generate the components of all candidates as similar as ``least``."""
    cells, cell = own.select("node", F.explode("keys").alias("key")), Window.partitionBy("key")
    cells = cells.withColumns({"lo": F.min("node").over(cell), "hi": F.max("node").over(cell)})
    met = scratch.write(cells.where("lo <> hi").select("key", "node").distinct(), "met")
    # One row stands for a node: the sets are equal, whatever its text is.
    of = F.struct("size", "sketch", simhash.embedded(F.col("bits")).alias("embedded"))
    nodes = own.groupBy("node").agg(F.min(of).alias("of"), F.min(F.struct("doc_id", "rid")).alias("row"))
    nodes = scratch.write(nodes, "nodes")
    texts, edges, tried = [], None, None
    for k in range(PIVOT_ROUNDS + 1):
        # The rounds of pivots compare folded sketches in the cell, the last one compares all by a join.
        brief = F.struct("of.size", folded(F.col("of.sketch")).alias("sketch")).alias("of")
        rooted = nodes.select("node", "of" if k == PIVOT_ROUNDS else brief)
        if edges is None:
            rooted = rooted.withColumn("root", F.col("node"))
        else:
            root = components(edges, Scratch(scratch.spark, f"roots{k}"))
            rooted = rooted.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
        grid = F.shiftrightunsigned("key", 24)
        at = (met.where(grid < FIRST_GRIDS) if k == 0 else met).join(rooted, "node")
        # An order for each group of grids, so that a node meets many pivots.
        order = F.xxhash64("node", F.pmod(grid, F.lit(PIVOT_ORDERS)), F.lit(k))
        pivot = F.min_by(F.struct("node", "root") if k == PIVOT_ROUNDS else F.struct("node", "root", "of"), order).over(cell)
        of_cell = {"lo": F.min("root").over(cell), "hi": F.max("root").over(cell), "n": F.count("*").over(cell), "p": pivot}
        at = at.withColumns(of_cell).where("lo <> hi")
        if k < PIVOT_ROUNDS:
            near = may_be_similar(F.col("of.size"), F.col("of.sketch"), F.col("p.of.size"), F.col("p.of.sketch"), least, FOLDED)
            pairs = at.where((F.col("root") != F.col("p.root")) & near)
            pairs = pairs.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()
            l, r = nodes.select(F.col("node").alias("a"), F.col("of").alias("l")), nodes.select(F.col("node").alias("rb"), F.col("of").alias("r"))
            pairs = pairs.join(l, "a").join(r, (F.col("b") == F.col("rb")) & in_range("l", "r", least)).select("a", "b")
        else:
            # A random pivot is mostly of a crowded cell's largest component; what is of other ones is paired with all. Two nodes alone in a cell are done.
            left = at.where("n > 2").select("key", "node", "root", (F.col("root") == F.col("p.root")).alias("most"), "of.*")
            left = scratch.write(left, "left")
            l, r = left.where("not most").alias("l"), left.alias("r")
            on = (F.col("l.key") == F.col("r.key")) & (F.col("l.root") != F.col("r.root")) & (F.col("r.most") | (F.col("l.node") < F.col("r.node")))
            pairs = l.join(r, on & in_range("l", "r", least)).select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()
        pairs = scratch.write(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), f"pairs{k}")
        tried = pairs if tried is None else tried.union(pairs)
        need = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        for have in texts:
            need = need.join(have, "node", "left_anti")
        need = scratch.write(need.join(nodes, "node").select("node", F.col("row.doc_id").alias("_id"), F.col("row.rid").alias("_rid")), f"need{k}")
        if need.limit(1).count():
            found = docs.join(need, docs["doc_id"].eqNullSafe(need["_id"]) & (docs["rid"] == need["_rid"])).select("node", "text")
            texts.append(scratch.write(found.groupBy("node").agg(F.min("text").alias("text")), f"texts{k}"))
        if not texts:
            continue
        good = scratch.write(verified(pairs, reduce(DataFrame.union, texts), width, least), f"edges{k}")
        edges = good if edges is None else edges.union(good)
    return edges if edges is not None else met.select(F.col("node").alias("a"), F.col("node").alias("b"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = SIMILARITY) -> DataFrame:
    """One row for each row of ``docs``: doc_id, rid, kept; rid is :func:`row_id` of the text.

    Texts as similar as ``least`` by their sets of ``width``-word shingles are
    linked, and so are texts without words. A component keeps the row of least
    id, a null id only where it has no other, and of rows that share the id the
    one of least rid.
    """
    scratch = Scratch(docs.sparkSession, "shingles")
    rows = docs.select(F.col(id_col).alias("doc_id"), row_id(F.col(text_col)).alias("rid"), F.col(text_col).alias("text"))
    own = scratch.write(signatures(rows, width), "own")
    root = components(links(own, rows, scratch, width, least), scratch)
    rooted = own.join(root, "node", "left").select("doc_id", "rid", F.coalesce("root", "node").alias("root"))
    rooted = scratch.write(rooted, "rooted")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("first")
    firsts = scratch.write(rooted.groupBy("root").agg(first), "firsts")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("rid") == F.col("first.rid"))
    return rooted.join(firsts, "root").select("doc_id", "rid", kept.alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each component, all columns kept, whatever their names; rows that repeat an id and its text leave one row."""
    at, rid = free_name(docs, "kept_id"), free_name(docs, "kept_rid")
    kept = near_copies(docs, id_col, text_col, width, least).where("kept").select(F.col("doc_id").alias(at), F.col("rid").alias(rid))
    same = docs[id_col].eqNullSafe(F.col(at)) & (row_id(docs[text_col]) == F.col(rid))
    return one_row_each(docs.join(kept, same, "left_semi"), docs, [id_col], row_id(F.col(text_col)), text_col)
