"""Token counts by a compiled finite-state tokenizer.

The merges are compiled into a deterministic transducer over bytes. A state
holds, for every split point from which the bytes so far spell the start of a
token, the token that ends there; each transition is annotated with the change
of the token count. A token sequence is the tokenizer's own exactly if each
neighbouring pair is, so the last token after any prefix is unique and the
state set is finite. States are built when first met and kept under a bound.

A text is cut into chunks, each a row of its own. A chunk is a map of states:
before its first place where every run must start a new piece (a blank after a
non-blank) it depends on the state before it, behind that it is constant. It is
kept as what is yet to be read from the state before (the head), the tokens of
the constant middle, and the characters read since the last such place, which
name the state at its end. Maps compose associatively; the maps of a text are
combined in the order of its chunks, in a tree.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK_CHARS = 1 << 16
#: States, and pieces of either of two generations, that a process keeps; beyond them they are built again.
MAX_STATES = 1 << 18
MAX_PIECES = 1 << 18


def _byte_chars() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        table = _byte_chars()
        raw = lambda s: bytes(table[c] for c in s)
        special = [t["content"] for t in spec.get("added_tokens", ())]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        self.tokens = [raw(t) for t in spec["model"]["vocab"] if t not in special]
        self.ids = {t: i for i, t in enumerate(self.tokens)}
        self.child: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        nodes = 1
        for i, t in enumerate(self.tokens):
            at = 0
            for b in t:
                nxt = self.child.get(at << 8 | b)
                if nxt is None:
                    nxt = self.child[at << 8 | b] = nodes
                    nodes += 1
                at = nxt
            self.token_at[at] = i
        self.find = regex.compile(PATTERN).findall
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.cut = regex.compile(r"(?<=\S)(?=\s)")
        self.pair: dict[tuple[int, int], bool] = {}
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        start = ((0, -1, 0),)
        self.states, self.numbers, self.trans = [start], {start: 0}, {}

    def merged(self, data: bytes) -> list[bytes]:
        """The tokens of a short piece by merging lowest ranks first; only for compiling."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.rank.get((parts[i], parts[i + 1]), 1 << 30), i) for i in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _follows(self, one: int, two: int) -> bool:
        got = self.pair.get((one, two))
        if got is None:
            want = [self.tokens[two]] if one < 0 else [self.tokens[one], self.tokens[two]]
            got = self.pair[one, two] = self.merged(b"".join(want)) == want
            if len(self.pair) > 4 * MAX_STATES:
                self.pair.clear()
        return got

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition's target and the change of the count."""
        alive, last, delta = [], -1, 0
        for node, tok, rel in self.states[state]:
            nxt = self.child.get(node << 8 | byte)
            if nxt is None:
                continue
            alive.append((nxt, tok, rel))
            end = self.token_at.get(nxt)
            if end is not None and last < 0 and self._follows(tok, end):
                last, delta = end, rel + 1
        new = (*((n, t, r - delta) for n, t, r in alive), (0, last, 0))
        at = self.numbers.get(new)
        if at is None:
            at = self.numbers[new] = len(self.states)
            self.states.append(new)
        got = self.trans[state << 8 | byte] = (at, delta)
        return got

    def piece(self, text: str) -> int:
        state, total, trans = 0, 0, self.trans
        for b in text.encode("utf-8", "surrogatepass"):
            state, d = trans.get(state << 8 | b) or self._compile(state, b)
            total += d
        return total

    def _run(self, text: str) -> int:
        total, young, old = 0, self.young, self.old
        for p in self.find(text):
            n = young.get(p)
            if n is None:
                n = old.get(p)
                if n is None:
                    n = self.piece(p)
                if len(p) < 64:
                    young[p] = n
            total += n
        if len(young) > MAX_PIECES:
            self.young, self.old = {}, young
        if len(self.states) > MAX_STATES:
            self._reset()
        return total

    def run(self, text: str) -> int:
        """The tokens of a text from the start state to its end."""
        if self.special is None:
            return self._run(text)
        total, at = 0, 0
        for m in self.special.finditer(text):
            total += self._run(text[at : m.start()]) + 1
            at = m.end()
        return total + self._run(text[at:] if at else text)

    def chunk_map(self, chunk: str) -> tuple[str, int | None, str]:
        """(head, tokens, tail): what depends on the state before, the constant middle, what the next chunk may go on with. tokens is None if the chunk has no cut."""
        first = self.cut.search(chunk)
        if first is None:
            return chunk, None, ""
        last = first.start()
        for back in range(len(chunk) - 1, last, -1):
            if chunk[back].isspace() and self.cut.match(chunk, back):
                last = back
                break
        return chunk[: first.start()], self.run(chunk[first.start() : last]), chunk[last:]

    def compose(self, one: tuple, two: tuple) -> tuple:
        if one[1] is None and two[1] is None:
            return one[0] + two[0], None, ""
        if one[1] is None:
            # A cut where the chunks meet is found again when the head is run.
            return one[0] + two[0], two[1], two[2]
        if two[1] is None:
            return one[0], one[1], one[2] + two[0]
        return one[0], one[1] + self.run(one[2] + two[0]) + two[1], two[2]

    def composed(self, maps: list[tuple]) -> int:
        """The tokens of a text whose chunks have these maps, in order."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, mid, tail = maps[0]
        return self.run(head) + (mid or 0) + self.run(tail)

    def count(self, text: str, chunk_chars: int = CHUNK_CHARS) -> int:
        if len(text) <= chunk_chars:
            return self.run(text)
        return self.composed([self.chunk_map(text[i : i + chunk_chars]) for i in range(0, len(text), chunk_chars)])


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One for each worker process."""
    return Transducer(path)


def _chunk_maps(chunks: DataFrame, path: str, kind: str) -> DataFrame:
    """Of (doc_id, rid, n_bytes, n_chunks, k, chunk): the map of each chunk; a text of one chunk has its tokens in mid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in batches:
            maps = [("", t.run(c.as_py()), "") if n.as_py() == 1 else t.chunk_map(c.as_py()) for n, c in zip(b.column(3), b.column(5), strict=True)]
            head, mid, tail = zip(*maps, strict=True) if maps else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(head, pa.string()), pa.array(mid, pa.int64()), pa.array(tail, pa.string())], names=["doc_id", "rid", "n_bytes", "n_chunks", "k", "head", "mid", "tail"])

    return chunks.mapInArrow(run, f"doc_id {kind}, rid bigint, n_bytes bigint, n_chunks int, k int, head string, mid bigint, tail string")


def _composed(long: DataFrame, path: str, kind: str) -> DataFrame:
    """Of (doc_id, n_bytes, maps), the maps in order: (doc_id, n_bytes, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in batches:
            counts = [t.composed([(m["head"], m["mid"], m["tail"]) for m in ms.as_py()]) for ms in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return long.select("doc_id", "n_bytes", "maps").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    ``path`` names a byte-level BPE file that every executor can read. Null
    counts as empty, which has no token. Repeated rows give repeated rows, an
    empty table an empty result; other columns are not read. Chunks of one text
    may be read by different tasks; a group holds one text's maps.
    """
    scratch, kind = Scratch(docs.sparkSession, "tokens"), docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text"))
    cut = F.when(F.length("text") <= chunk_chars, F.array("text")).otherwise(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk_chars}}}"), F.lit(0)))
    chunks = rows.select("doc_id", "rid", "n_bytes", cut.alias("cut")).select("doc_id", "rid", "n_bytes", F.size("cut").alias("n_chunks"), F.posexplode("cut").alias("k", "chunk"))
    maps = scratch.write(_chunk_maps(chunks, path, kind), "maps")
    short = maps.where("n_chunks = 1").select("doc_id", "n_bytes", F.col("mid").alias("n_tokens"))
    long = maps.where("n_chunks > 1").groupBy("rid", "doc_id", "n_bytes").agg(F.array_sort(F.collect_list(F.struct("k", "head", "mid", "tail"))).alias("maps"))
    counted = short.union(_composed(long, path, kind))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
