"""Connected components of a graph given by its edges, without leaving the DataFrame."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

_MIX = (0x5DEECE66D1234567, 0x2545F4914F6CDD1D, 0x1B873593CC9E2D51, 0x369DEA0F31A53F85, 0x106689D45497FDB5)


#: Edges, each in both directions, from which one task finishes what is left: a quarter of a megabyte.
LAST_EDGES = 1 << 14


def _united(edges: DataFrame) -> DataFrame:
    """(node, to) of all nodes of at most LAST_EDGES edges, by union-find in one task; ``to`` is the least node of the component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = find(x), find(y)
                root[max(x, y)] = min(x, y)
        nodes = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(map(find, nodes), pa.int64())], names=["node", "to"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node bigint, to bigint")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: bigint); root is one node of its component.

    Each round contracts every node into the neighbour of least rank under a
    mask that changes by round, so the edges left shrink by a constant share in
    expectation. The rank is a bijection of the node (xor with the mask), hence
    a partial ``min`` of one integer does it and hubs are combined map-side.
    When few edges are left one task unites them, which saves the last rounds.
    """
    cur = scratch.write(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct(), "edges0")
    maps: list[DataFrame] = []
    k = 0
    while left := cur.count():
        if left <= LAST_EDGES:
            maps.append(scratch.write(_united(cur), f"map{k}"))
            break
        mask = F.lit(_MIX[k % len(_MIX)] ^ (k * 0x9E3779B9))
        low = cur.groupBy("a").agg(F.min(F.col("b").bitwiseXOR(mask)).alias("m"))
        step = low.select(F.col("a").alias("node"), F.least("m", F.col("a").bitwiseXOR(mask)).bitwiseXOR(mask).alias("to"))
        step = scratch.write(step, f"map{k}")
        one = step.select(F.col("node").alias("a"), F.col("to").alias("x"))
        two = step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        nxt = cur.join(one, "a").join(two, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        nxt = scratch.write(nxt, f"edges{k + 1}")
        scratch.drop(f"edges{k}")
        maps.append(step)
        cur, k = nxt, k + 1
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).where(F.lit(False))

    def then(have: DataFrame, step: DataFrame) -> DataFrame:
        nxt = step.select(F.col("node").alias("root"), F.col("to").alias("_to"))
        return have.join(nxt, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))

    return reduce(then, maps[1:], maps[0].select("node", F.col("to").alias("root")))
