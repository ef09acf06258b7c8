"""Near copies by shingle similarity against brute force."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from tablesmith.llm import graph, shingles, simhash
from tablesmith.llm.common import Scratch
from tests.llm.test_corpus import frame


def near_rows():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows = []
    for g in range(30):
        base = [word() for _ in range(200)]
        rows.append((10 * g, " ".join(base)))
        for c, edits in enumerate((1, 2, 3, 4, 5, 7)):
            copy = list(base)
            for at in r.sample(range(0, 200), edits):
                copy[at] = word()
            rows.append((10 * g + c + 1, " ".join(copy)))
    return rows


def brute(rows):
    sets = [shingles.shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if shingles.similarity(sets[i], sets[j]) >= 0.8:
                root[find(i)] = find(j)
    out = {}
    for i, (k, t) in enumerate(rows):
        out.setdefault(find(i), []).append((k is None, k if k is not None else 0, t))
    return sorted((None if a else b, t) for a, b, t in (min(g, key=lambda x: x[:2]) for g in out.values()))


def test_near_copies_at_similarity(spark):
    rows = near_rows()
    got = shingles.drop_near_copies(frame(spark, rows))
    assert sorted((x.doc_id, x.text) for x in got.collect()) == brute(rows)
    assert got.columns == frame(spark, rows).columns and len(brute(rows)) < len(rows)


def test_a_large_group_loses_no_link_and_pairs_few(spark):
    """Copies of one text with one to thirty edits each: some are linked only by way of others, most not at all."""
    r = random.Random(13)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(150)]
    rows = [(1, " ".join(base))]
    for c in range(160):
        copy = list(base)
        for at in r.sample(range(150), r.choice((1, 2, 4, 8, 15, 30))):
            copy[at] = word()
        rows.append((c + 2, " ".join(copy)))
    assert sorted((x.doc_id, x.text) for x in shingles.drop_near_copies(frame(spark, rows)).collect()) == brute(rows)


def test_components_by_rounds_and_at_once(spark, monkeypatch):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(-40, 40)] + [(1000, i) for i in range(1001, 1060)] + [(r.randrange(2000, 2200), r.randrange(2000, 2200)) for _ in range(90)] + [(5000, 5000)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[find(a)] = find(b)
    want = {}
    for x in list(root):
        want.setdefault(find(x), set()).add(x)
    for most in (0, 50, 1 << 14):
        monkeypatch.setattr(graph, "LAST_EDGES", most)
        got = {}
        for x in graph.components(df, Scratch(spark, "t")).collect():
            got.setdefault(x.root, set()).add(x.node)
        assert {frozenset(s) for s in got.values()} == {frozenset(s) for s in want.values()} and all(k in s for k, s in got.items())
    assert graph.components(df.limit(0), Scratch(spark, "t")).count() == 0


def test_sketches_bound_the_similarity(spark):
    """No pair as similar as the threshold is dropped by its sketches, and many of the others are."""
    sets = [shingles.shingle_set(t) for _, t in near_rows()[:70]]
    rows = [(i, len(s), shingles.signature(s)[3]) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "i int, size int, sketch array<bigint>")
    a, b = df.alias("a"), df.alias("b")
    near = shingles.may_be_similar(F.col("a.size"), F.col("a.sketch"), F.col("b.size"), F.col("b.sketch"), 0.8)
    left = {(x.i, x.j) for x in a.join(b, F.expr("a.i < b.i") & near).select("a.i", F.col("b.i").alias("j")).collect()}
    real = {(i, j) for j in range(len(sets)) for i in range(j) if shingles.similarity(sets[i], sets[j]) >= 0.8}
    assert real <= left and len(left) < len(real) + 0.1 * len(sets) ** 2 / 2


def test_near_copies_tell_rows_apart(spark):
    a, b, c = (" ".join(f"{p}{i}" for i in range(60)) for p in "abc")
    rows = [(None, a), (None, b), (1, c), (2, c + " x"), (2, a + " x"), (3, ""), (4, None), (3, ""), (5, "one two"), (6, "One  two")]
    got = shingles.drop_near_copies(frame(spark, rows)).select("doc_id", "text").collect()
    want = [(None, b), (1, c), (2, a + " x"), (3, ""), (5, "one two")]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert shingles.drop_near_copies(frame(spark, [])).count() == 0


def sets_at(r, common, *own):
    """Sets of random hashes that share ``common`` of them."""
    draw = lambda n: {r.getrandbits(64) for _ in range(n)}
    both = draw(common)
    return [both | draw(n) for n in own]


def wide(s):
    v = simhash.votes(np.fromiter(s, np.uint64, len(s)))
    counts = (v[: 64 * simhash.KEPT] > 0).reshape(-1, 2).sum(axis=1)
    return set(simhash.wide_cells(v).tolist()), counts


def test_wide_simhash_by_plain_integers():
    """Votes, segments and cells as counted bit by bit; over 255 hashes, so that sums pass a byte."""
    (s,) = sets_at(random.Random(5), 300, 0)
    flip, odd, odd2 = ([int(x) for x in m[0]] for m in simhash._mixers())
    most = (1 << 64) - 1
    votes = []
    for w in range(simhash.WIDE):
        mixed = [((h ^ flip[w]) * odd[w]) & most for h in s]
        mixed = [((x ^ (x >> 32)) * odd2[w]) & most for x in mixed]
        mixed = [x ^ (x >> 29) for x in mixed]
        votes += [sum(1 if x >> i & 1 else -1 for x in mixed) for i in range(64)]
    got = simhash.votes(np.fromiter(s, np.uint64, len(s)))
    assert got.tolist() == votes
    one, two = simhash._deals()
    for g, cell in list(enumerate(simhash.wide_cells(got)))[:: simhash.GRIDS // 8]:
        key, n = 0, 2 * simhash.SEGMENTS
        for b in range(simhash.GRID_BANDS):
            at = g * simhash.GRID_BANDS + b
            lean = [votes[i] + votes[j] for i, j in zip(one[at], two[at], strict=True)]
            best = max(range(len(lean)), key=lambda k: (abs(lean[k]), -k))
            key += (2 * best + (lean[best] > 0)) * n**b
        assert int(cell) % (1 << 32) == g * n**simhash.GRID_BANDS + key
    assert shingles.signature(frozenset(s))[2] == simhash.wide_cells(got).tolist()


def test_near_sets_share_cells_within_reach():
    """Pairs of similarity 0.8 of all sizes meet in a cell and lie within reach in the embedding; unrelated sets do neither."""
    r = random.Random(6)
    for common, a, b in ((4, 0, 1), (8, 1, 1), (8, 0, 2), (16, 2, 2), (80, 10, 10), (80, 0, 20), (800, 100, 100)):
        for _ in range(12):
            (x, cx), (y, cy) = map(wide, sets_at(r, common, a, b))
            assert x & y and abs(cx - cy).sum() <= simhash.reach(0.8)
            (x, cx), (y, cy) = map(wide, sets_at(r, 0, common + a, common + b))
            assert len(x & y) <= 1 and abs(cx - cy).sum() > simhash.reach(0.8)


def executions(spark):
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    return {runs.apply(i).executionId() for i in range(runs.size())}


def rows_of_joins(spark, runs):
    """Rows made by the joins by (a, b) and by a alone in these executions."""
    store, made = spark._jsparkSession.sharedState().statusStore(), 0
    for run in runs:
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            metrics = node.metrics()
            for m in (metrics.apply(i) for i in range(metrics.size())):
                if re.match(r"\w*Join \[(a#\d+L, b#\d+L|a#\d+L)\]", node.desc()) and m.name() == "number of output rows" and (v := values.get(m.accumulatorId())).isDefined():
                    made += int(v.get().replace(",", ""))
    return made


def test_texts_that_share_a_passage_are_dropped_in_their_cells(spark):
    """Of many texts with one common passage and five pairs of near copies only what the sketches leave is joined."""
    r = random.Random(17)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(70)]
    rows = [(i, " ".join([*passage, *(word() for _ in range(40))])) for i in range(150)]
    rows += [(200 + i, rows[i][1] + " " + word()) for i in range(5)]
    before = executions(spark)
    got = shingles.drop_near_copies(frame(spark, rows)).collect()
    assert sorted((x.doc_id, x.text) for x in got) == brute(rows) and len(got) == 150
    assert 0 < rows_of_joins(spark, executions(spark) - before) < len(rows)


def test_folded_sketches_bound_the_similarity(spark):
    """A folded sketch has the parities of twice the hashes a segment, and lies no farther from another than the sketches do."""
    sets = [shingles.shingle_set(t) for _, t in near_rows()[:40]]
    df = spark.createDataFrame([(i, shingles.signature(s)[3]) for i, s in enumerate(sets)], "i int, sketch array<bigint>")
    bits = lambda longs: {64 * i + j for i, x in enumerate(longs) for j in range(64) if x >> j & 1}
    got = {x.i: (bits(x.sketch), bits(x.half)) for x in df.withColumn("half", shingles.folded(F.col("sketch"))).collect()}
    n = 64 * shingles.FOLDED
    for i, s in enumerate(sets):
        odd = [sum(1 for h in s if (h >> 20) % n == k) % 2 for k in range(n)]
        assert got[i][1] == {k for k in range(n) if odd[k]}
        for j in range(i):
            assert len(got[i][1] ^ got[j][1]) <= len(got[i][0] ^ got[j][0]) <= len(s ^ sets[j])


def test_near_stage_joins_by_range_in_the_embedding(spark, monkeypatch):
    import corpus_pipeline

    rows = near_rows()[:28]
    stage = lambda: sorted((x.doc_id, x.text) for x in corpus_pipeline.near_stage(spark, frame(spark, rows), "").collect())
    assert stage() == brute(rows) and len(brute(rows)) < len(rows)
    monkeypatch.setattr(simhash, "reach", lambda least: -1)
    assert stage() == sorted(rows)
