"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that have
them). Words flow from a pattern, over one arc for each repetition with rising
cost, to the sources of the pattern and on to their quotas. The flow says how
many words each pattern gives; whole passes and a seeded selection of documents
spend them. Only the patterns' sums reach the driver; their number is checked.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

#: Times that a document may be repeated.
MAX_REPEATS = 3
#: Patterns whose sums the driver may hold.
MAX_PATTERNS = 100_000
#: Bits of the seeded hash that each of the two rounds of the selection looks at.
ROUND_BITS = 10


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], repeats: int = MAX_REPEATS, total: int | None = None) -> dict[str | None, float]:
    """Each source's share by weight of ``total``, held to ``repeats`` times its size; the excess goes to the others by weight until none is above.

    ``total`` is the sum of ``sizes`` unless given: sources that overlap share
    out the words that there are, each once. A weight for a source without
    words gets nothing.
    """
    total, out, open_ = float(sum(sizes.values()) if total is None else total), {}, dict(weights)
    while open_:
        left, mass = total - sum(out.values()), sum(open_.values())
        full = [s for s, w in open_.items() if left * w / mass > repeats * sizes.get(s, 0)]
        if not full:
            return out | {s: left * w / mass for s, w in open_.items()}
        for s in full:
            out[s] = float(repeats * sizes.get(s, 0))
            del open_[s]
    return out


def cyclic_weights(sources: list[str | None], cycle: tuple[float, ...] = (1, 2, 3)) -> dict[str | None, float]:
    """Weights that repeat over the sources by code point, null last."""
    order = sorted((s for s in sources if s is not None), key=lambda s: s.encode()) + [None] * (None in sources)
    return {s: cycle[i % len(cycle)] for i, s in enumerate(order)}


def min_cost_flow(supply: dict[int, int], members: dict[int, list], quota: dict, repeats: int = MAX_REPEATS) -> dict[int, int]:
    """Words that each pattern gives: the largest flow to the quotas, at the least cost where the k-th pass over a pattern costs k a word.

    A path's cost is that of its first arc, for every other arc is free. So the
    passes are opened one after another, and after each the flow is made as
    large as it can be, by blocking flows over shortest paths: the result is a
    cheapest one of its value. A pattern without words or without a source with
    a quota gives none. An empty supply gives an empty result.
    """
    patterns, sources = list(supply), list(quota)
    place = {s: i for i, s in enumerate(sources)}
    own = [[place[s] for s in members[p] if s in place] for p in patterns]
    of: list[list[int]] = [[] for _ in sources]
    for i, ss in enumerate(own):
        for j in ss:
            of[j].append(i)
    room, sent = [0] * len(patterns), [0] * len(patterns)  # words that a pattern may still give, and gives
    open_ = [int(quota[s]) for s in sources]
    flow: dict[tuple[int, int], int] = {}
    for _ in range(repeats):
        for i, p in enumerate(patterns):
            room[i] += supply[p]
        while True:
            # Levels: patterns with room, their sources, patterns that could leave those sources for others, and so on.
            level_p, level_s = [0 if r > 0 and own[i] else -1 for i, r in enumerate(room)], [-1] * len(sources)
            front, depth, found = [i for i, d in enumerate(level_p) if d == 0], 0, False
            while front and not found:
                reached = []
                for i in front:
                    for j in own[i]:
                        if level_s[j] < 0:
                            level_s[j] = depth + 1
                            reached.append(j)
                            found = found or open_[j] > 0
                depth += 2
                front = []
                if not found:
                    for j in reached:
                        for i in of[j]:
                            if level_p[i] < 0 and flow.get((i, j), 0) > 0:
                                level_p[i] = depth
                                front.append(i)
            if not found:
                break
            at_p, at_s = [0] * len(patterns), [0] * len(sources)
            for start in (i for i, d in enumerate(level_p) if d == 0):
                while room[start] > 0 and (path := _path(start, own, of, level_p, level_s, at_p, at_s, open_, flow)):
                    most = min([room[start], open_[path[-1]], *(flow[path[k + 1], path[k]] for k in range(1, len(path) - 1, 2))])
                    for k in range(0, len(path), 2):
                        flow[path[k], path[k + 1]] = flow.get((path[k], path[k + 1]), 0) + most
                    for k in range(1, len(path) - 1, 2):
                        flow[path[k + 1], path[k]] -= most
                    room[start] -= most
                    sent[start] += most
                    open_[path[-1]] -= most
    return dict(zip(patterns, sent, strict=True))


def _path(start: int, own: list, of: list, level_p: list, level_s: list, at_p: list, at_s: list, open_: list, flow: dict) -> list[int] | None:
    """Pattern, source, pattern, .. up to a source with an open quota, one level on each step; arcs that lead nowhere are not tried again."""
    path = [start]
    while path:
        if len(path) % 2:
            i = path[-1]
            nxt = next((k for k in range(at_p[i], len(own[i])) if level_s[own[i][k]] == level_p[i] + 1), None)
            if nxt is not None:
                at_p[i] = nxt
                path.append(own[i][nxt])
                continue
            at_p[i] = len(own[i])
        else:
            j = path[-1]
            if open_[j] > 0:
                return path
            nxt = next((k for k in range(at_s[j], len(of[j])) if level_p[of[j][k]] == level_s[j] + 1 and flow.get((of[j][k], j), 0) > 0), None)
            if nxt is not None:
                at_s[j] = nxt
                path.append(of[j][nxt])
                continue
            at_s[j] = len(of[j])
        path.pop()
        if path:
            if len(path) % 2:
                at_p[path[-1]] += 1
            else:
                at_s[path[-1]] += 1
    return None


def _select(rows: DataFrame, scratch: Scratch, give: dict[int, tuple[int, int]]) -> DataFrame:
    """Adds ``picked``: whether the seeded selection of its pattern has the row. give: (pattern, (whole passes, words beyond them))."""
    spark = rows.sparkSession
    rest, cut = rows, {p: (g[1], 0) for p, g in give.items()}
    parts, schema = [], "pattern int, left bigint"
    for k in range(2):
        left = F.broadcast(spark.createDataFrame([(p, c[0]) for p, c in cut.items()], schema))
        bucket = F.shiftrightunsigned(F.col("h"), 64 - ROUND_BITS * (k + 1)).bitwiseAND(F.lit((1 << ROUND_BITS) - 1))
        rest = rest.withColumn("bucket", bucket)
        sums = rest.groupBy("pattern", "bucket").agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("pattern").orderBy("bucket"))
        marks = sums.withColumn("upto", upto).join(left, "pattern").where("upto > left")
        marks = marks.groupBy("pattern").agg(F.min_by(F.struct("bucket", (F.col("left") - F.col("upto") + F.col("words")).alias("left")), "bucket").alias("m"))
        found = {r["pattern"]: r["m"] for r in marks.collect()}
        at = F.broadcast(spark.createDataFrame([(p, int(found[p]["bucket"]) if p in found else 1 << ROUND_BITS) for p in cut], "pattern int, at bigint"))
        rest = rest.join(at, "pattern")
        parts.append(rest.where("bucket <> at").select("doc_id", "source", "size", "pattern", (F.col("bucket") < F.col("at")).alias("picked")))
        rest = rest.where("bucket = at").drop("bucket", "at")
        cut = {p: (int(m["left"]), 0) for p, m in found.items()}
    # What is left is about a millionth of a pattern, but for rows that repeat an id and text: those are one row here, with their number.
    left = F.broadcast(spark.createDataFrame([(p, c[0]) for p, c in cut.items()], schema))
    same = rest.groupBy("pattern", "h", "doc_id", "size", "source").agg(F.count("*").alias("n"))
    words = F.col("n") * F.col("size")
    before = F.sum(words).over(Window.partitionBy("pattern").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - words
    last = same.withColumn("before", before).join(left, "pattern")
    # As many as end nearest to what is left; a row without words is picked while any are left.
    few = F.when(F.col("size") > 0, F.floor((F.col("left") - F.col("before") + F.col("size") / 2) / F.col("size"))).otherwise(F.when(F.col("before") <= F.col("left"), F.col("n")).otherwise(0))
    last = last.withColumn("few", F.greatest(F.lit(0), F.least(few, F.col("n")))).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    parts.append(last.select("doc_id", "source", "size", "pattern", (F.col("k") <= F.col("few")).alias("picked")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict[str | None, float] | None = None, seed: int = 11, repeats: int = MAX_REPEATS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target, taken.

    ``source_col`` is a string, or an array of strings for overlapping sources;
    ``target`` and ``source_size`` are sums over the sources of the row. Null is
    a source of its own. Null and empty texts have size 0 and take nothing. Ties
    of the seeded hash go by id. Repeated rows count each; an empty table gives
    an empty result; other columns are not read.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "mix")
    one = F.col(source_col)
    if isinstance(docs.schema[source_col].dataType, T.ArrayType):
        member = F.when(one.isNull() | (F.size(one) == 0), F.array(F.lit(None).cast("string"))).otherwise(F.array_sort(F.array_distinct(one)))
    else:
        member = F.array(one.cast("string"))
    rows = docs.select(F.col(id_col).alias("doc_id"), n_words(F.col(text_col)).alias("size"), member.alias("source"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"))
    rows = scratch.write(rows, "sizes")
    got = rows.groupBy("source").agg(F.sum("size").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(got) > MAX_PATTERNS:
        raise ValueError(f"over {MAX_PATTERNS} membership patterns")
    supply = {i: int(r["words"]) for i, r in enumerate(got)}
    members = {i: list(r["source"]) for i, r in enumerate(got)}
    sizes: dict = defaultdict(int)
    for i, ms in members.items():
        for s in ms:
            sizes[s] += supply[i]
    goal = targets(dict(sizes), weights or cyclic_weights(list(sizes)), repeats, sum(supply.values())) if sizes else {}
    flow = min_cost_flow(supply, members, {s: round(g) for s, g in goal.items()}, repeats)
    give = {p: divmod(flow[p], supply[p]) if supply[p] else (0, 0) for p in supply}
    schema = "source array<string>, pattern int, source_size bigint, target double, passes int"
    plan = spark.createDataFrame([(members[p], p, sum(sizes[s] for s in members[p]), float(sum(goal[s] for s in members[p])), give[p][0]) for p in supply], schema)
    known = F.broadcast(plan)
    numbered = rows.join(known.select(F.col("source").alias("_s"), "pattern"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    picked = _select(numbered, scratch, give)
    out = picked.join(known.drop("source"), "pattern")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("passes") + F.col("picked").cast("int"))).alias("taken"))
