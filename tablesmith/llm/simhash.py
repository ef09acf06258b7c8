"""Near-duplicates by SimHash with a segment-popcount embedding.

A fingerprint is embedded as its bit counts in 32 segments of two bits. The
Manhattan distance of two embeddings never exceeds the Hamming distance of the
fingerprints, so pairs are sought in the embedding and then verified exactly.
The grid: the 32 counts are dealt into five bands. Distance 2 touches at most
two bands, so a linked pair agrees in all counts of at least three; a cell of
the grid is the counts of one choice of three bands. Each distinct fingerprint
lies in ten cells.

A crowded cell is not paired: its members emit the 65 fingerprints within one
bit instead. Two members link exactly if they share one of these, and each
shared one ties its (at most 65) owners to the least of them, which is linear.

For wider distances (:mod:`shingles`) a set has a wide fingerprint and the bits
keep their votes. No grid selects there by whole bands, so each grid deals the
bits into segments anew and a cell names the surest segment of each band.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import acos, ceil, pi, sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .graph import components

MAX_BITS = 2
#: Members from which a cell goes by way of shared one-bit neighbours.
CROWDED = 48
_BANDS = ((0, 6), (6, 12), (12, 18), (18, 25), (25, 32))
_LOW = 0x5555555555555555


#: Longs of a wide fingerprint, the grids over it, the bands of a grid and the segments of a band.
WIDE, GRIDS, GRID_BANDS, SEGMENTS = 32, 240, 4, 32
#: Longs of a wide fingerprint that are kept for the distance of two embeddings.
KEPT = 8


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles as an unsigned integer; zero if there is no word."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones, per = np.zeros(64, np.int64), 1 << 15
    for at in range(0, n, per):
        hashes = np.array([xxh64_intdigest(b" ".join(words[i : i + width]), seed) for i in range(at, min(n, at + per))], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp bigint) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [_signed(fingerprint(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def embedding(fp: Column) -> Column:
    """The counts of 32 two-bit segments, each as a thermometer code (0: 00, 1: 01, 2: 11), so xor and bit_count give the Manhattan distance."""
    half = F.shiftrightunsigned(fp, 1)
    low = fp.bitwiseOR(half).bitwiseAND(F.lit(_LOW))
    high = fp.bitwiseAND(half).bitwiseAND(F.lit(_LOW))
    return low.bitwiseOR(F.shiftleft(high, 1))


@lru_cache(maxsize=1)
def _mixers():
    import numpy as np

    r = np.random.default_rng(42)
    draw = lambda: r.integers(0, 1 << 64, (1, WIDE), dtype=np.uint64)
    return draw(), draw() | np.uint64(1), draw() | np.uint64(1)


@lru_cache(maxsize=1)
def _deals():
    """The two bits of every segment of every band: each grid deals the bits of the wide fingerprint anew."""
    import numpy as np

    r, n = np.random.default_rng(43), GRID_BANDS * SEGMENTS * 2
    dealt = np.stack([r.permutation(64 * WIDE)[:n] for _ in range(GRIDS)]).reshape(GRIDS * GRID_BANDS, SEGMENTS, 2)
    return np.ascontiguousarray(dealt[:, :, 0]), np.ascontiguousarray(dealt[:, :, 1])


def votes(hashes):
    """The votes of a set of hashes on each bit of the wide fingerprint, ones less zeros; a bit is 1 if its votes are above zero."""
    import numpy as np

    flip, odd, odd2 = _mixers()
    ones = np.zeros(64 * WIDE, np.int32)
    # 255 at a time, so that a byte holds the sum.
    for at in range(0, len(hashes), 255):
        x = (hashes[at : at + 255, None] ^ flip) * odd
        x ^= x >> np.uint64(32)
        x *= odd2
        x ^= x >> np.uint64(29)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return 2 * ones - len(hashes)


def kept_bits(votes):
    """The first KEPT longs of the wide fingerprint."""
    import numpy as np

    return np.packbits(votes[: 64 * KEPT] > 0, bitorder="little").view("<i8")


def wide_cells(votes):
    """The cell of each grid, as an int that names the grid too.

    A cell is, for each band of the grid, the segment whose two bits are voted
    for most one-sidedly, with the side, that is its count of two or of none.
    Those counts are the last to change between near copies.
    """
    import numpy as np

    one, two = _deals()
    lean = votes[one] + votes[two]
    most = np.abs(lean).argmax(axis=1)
    side = lean[np.arange(len(most)), most] > 0
    band = (2 * most + side).reshape(GRIDS, GRID_BANDS)
    cell = band @ (2 * SEGMENTS) ** np.arange(GRID_BANDS) + np.arange(GRIDS) * (2 * SEGMENTS) ** GRID_BANDS
    return cell.astype(np.uint32).view(np.int32)


def embedded(bits: Column) -> Column:
    """The embeddings of an array of longs."""
    return F.transform(bits, embedding)


def distance(a: Column, b: Column) -> Column:
    """The Manhattan distance of two embedded wide fingerprints, by their kept longs."""
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(KEPT)), F.lit(0))


def reach(least: float) -> int:
    """The embedded distance of sets of similarity ``least``, six standard deviations above its mean.

    Their votes have a cosine of 2 s / (1 + s) at least, so a bit differs with
    probability arccos of that / pi, ties of small sets a quarter more; the
    distance of a segment then has mean 2 p - p ** 2.
    """
    p = 1.25 * acos(2 * least / (1 + least)) / pi
    n, mean = 32 * KEPT, 2 * p - p * p
    return ceil(n * mean + 6 * sqrt(n * (2 * p - mean * mean)))


def _mask(bands: tuple[int, ...]) -> int:
    bits = 0
    for b in bands:
        for s in range(*_BANDS[b]):
            bits |= 3 << (2 * s)
    return _signed(bits)


def links(fps: DataFrame, scratch: Scratch, crowded: int = CROWDED) -> DataFrame:
    """(a, b) edges between distinct fingerprints (column fp) that generate all components under MAX_BITS."""
    u = embedding(F.col("fp"))
    masks = [_mask(c) for c in combinations(range(5), 5 - MAX_BITS)]
    cell = F.explode(F.array(*[F.struct(F.lit(i).cast("byte").alias("grid"), u.bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(masks)])).alias("c")
    cells = fps.select("fp", cell).select("fp", "c.grid", "c.cell")
    full = scratch.write(cells.groupBy("grid", "cell").agg(F.count("*").alias("n")).where("n > 1"), "cells")
    met = scratch.write(cells.join(full, ["grid", "cell"]), "met")
    thin = met.where(F.col("n") <= crowded).drop("n")
    one, two = thin.withColumnRenamed("fp", "a"), thin.withColumnRenamed("fp", "b")
    pairs = one.join(two, ["grid", "cell"]).where("a < b")
    near = F.bit_count(embedding(F.col("a")).bitwiseXOR(embedding(F.col("b")))) <= MAX_BITS
    exact = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    pairs = pairs.where(near).where(exact).select("a", "b")
    thick = met.where(F.col("n") > crowded).select("fp").distinct()
    flips = F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])).alias("mid")
    owners = thick.select("fp", flips).groupBy("mid").agg(F.collect_list("fp").alias("own")).where(F.size("own") > 1)
    star = owners.select(F.explode("own").alias("a"), F.array_min("own").alias("b")).where("a <> b")
    return pairs.union(star).distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint, component_id.

    component_id is the smallest id that links of two or fewer bits reach,
    itself included. Null and empty texts have fingerprint zero and link like
    any other. Null ids belong to their group but are its smallest id only if
    all of its ids are null. Repeated rows give repeated rows; an empty table
    an empty result; further columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    own = scratch.write(fingerprints(docs, id_col, text_col), "own")
    fps = scratch.write(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    root = components(scratch.write(links(fps.select("fp"), scratch), "links"), scratch)
    joined = fps.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = scratch.write(joined, "rooted")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of = scratch.write(joined.join(least, "root").select("fp", "component_id"), "of")
    return own.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
