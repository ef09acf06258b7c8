"""The registered queries over whole tables, against SQL or a plain second way to the same rows."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash

from tablesmith.llm import queries as Q

SF = "/root/testdata/sf0.001"


#: Some 270 labelled texts to learn from; in SF there are 45, too few for a measure.
LEARN_SF = "/root/testdata/sf0.01"


def rows_of(spark, name, order="doc_id", sf=SF):
    return {r[order]: r for r in Q.queries()[name](spark, sf).collect()}


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = Q.queries()[name](spark, SF).toPandas(), c.execute(Q.oracle_sql()[name]).df()
    key = lambda d: sorted(tuple(map(str, r)) for r in d[sorted(d.columns)].itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and key(got) == key(want)


def test_op5_by_a_plain_simhash(spark, docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fps = {}
    for i, d in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", (d.text or "").translate(low))
        grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = rows_of(spark, "op5_simhash")
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{f:016x}", find(i)) for i, f in fps.items()}


def test_op6_by_the_library(spark, docs):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path(Q.TOKENIZER))
    want = {i: (len((d.text or "").encode()), n := len(lib.encode(d.text or "", add_special_tokens=False).ids), n > 1024) for i, d in docs.items()}
    assert {i: (r.n_bytes, r.n_tokens, r.over_limit) for i, r in rows_of(spark, "op6_token_counts").items()} == want


def test_op7_sizes_and_targets(spark, docs):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for i, d in docs.items()}
    held = Counter()
    for i, d in docs.items():
        held[d.source] += size[i]
    order = sorted((s for s in held if s is not None), key=lambda s: s.encode()) + [None] * (None in held)
    weight, goal, open_ = {s: 1 + k % 3 for k, s in enumerate(order)}, {}, set(order)
    while open_:
        left, mass = sum(held.values()) - sum(goal.values()), sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / mass > 3 * held[s]}
        goal |= {s: 3.0 * held[s] for s in full} if full else {s: left * weight[s] / mass for s in open_}
        open_ -= full or open_
    taken = defaultdict(int)
    for i, r in rows_of(spark, "op7_mixing").items():
        s = docs[i].source
        assert (r["size"], r.source_size) == (size[i], held[s]) and r.target == pytest.approx(goal[s]) and 0 <= r.taken <= 3 * size[i]
        taken[s] += r.taken
    for s in order:
        assert abs(taken[s] - goal[s]) <= max(size[i] for i, d in docs.items() if d.source == s)


def test_op9_rules(spark):
    rules = {"net/": ("net", "/", "block"), "example.net/en/": ("example.net", "/en/", "allow"), "example.com/de/": ("example.com", "/de/", "block"), "org/fr/": ("org", "/fr/", "allow")}
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = rows_of(spark, "op9_url_filter", "page_id")
    assert got.keys() == urls.keys()
    for i, url in urls.items():
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [n for n, (h, p, _) in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, key=len, default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (rules[rule][2] if rule else "block" if got[i].score >= 0.5 else "allow")


def test_learned_queries_hold_their_contract(spark):
    held = lambda i, m, k: zlib.crc32(str(i).encode()) % m == k
    labels, docs = ({r.doc_id: r for r in spark.read.parquet(f"{LEARN_SF}/{t}.parquet").collect()} for t in ("labels", "documents"))
    quality, language, toxic = (rows_of(spark, n, sf=LEARN_SF) for n in ("op1_quality", "op2_language", "op10_toxicity"))
    assert quality.keys() == language.keys() == toxic.keys() == docs.keys()
    for i in docs:
        assert quality[i].held_out == toxic[i].held_out == held(i, 3, 1) and language[i].held_out == held(i, 4, 2)
        assert quality[i].predicted == int(quality[i].score >= 0.5) and toxic[i].predicted == int(toxic[i].score >= 0.7)
        assert all(0 <= x[i].score <= 1 for x in (quality, language, toxic))
    share = lambda pairs: sum(a == b for a, b in pairs) / len(pairs)
    assert share([(quality[i].predicted, r.quality) for i, r in labels.items() if held(i, 3, 1) and r.quality is not None]) >= 0.85
    assert share([(language[i].lang_pred, d.lang) for i, d in docs.items() if held(i, 4, 2) and d.lang]) >= 0.95
    assert share([(toxic[i].predicted, r.toxic) for i, r in labels.items() if held(i, 3, 1) and r.toxic is not None]) >= 0.95
