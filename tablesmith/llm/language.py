"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Training (driver, bounded sample): follow-the-regularised-leader with elastic
net, then one temperature fitted on a part of the sample kept aside. Scoring
runs over whole texts in Arrow batches; a logit is a sum over positions, so a
text is read once and in pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts of each language in the training sample, about.
TRAIN_PER_LANGUAGE = 400
#: n-grams of whole code points are hashed into so many bits; non-letters are one code point, 0.
HASH_BITS = 20
PIECE_CHARS = 1 << 20
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    ids: np.ndarray
    weights: np.ndarray  # float32, a row for each id
    bias: np.ndarray
    temperature: float


_LETTER: list[np.ndarray] = []
_START = np.zeros(2, np.uint64)
N_IDS = 1 << HASH_BITS
# Odd multipliers, one for each place of an n-gram.
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.uint8, 0x110000))
    return _LETTER[0]


def _ngrams(text: str, tail: np.ndarray) -> tuple[bool, np.ndarray, np.ndarray]:
    """Whether a piece has a letter, the ids of its one, two and three letters after ``tail`` (the last two codes before it), and the next tail."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    c = (points * _letters()[points]).astype(np.uint64)
    full = np.concatenate([tail, c])
    keep = np.ones(len(full), bool)
    keep[2:] = (full[2:] != 0) | (full[1:-1] != 0)
    full = full[keep]
    last, shift = full[2:], np.uint64(64 - HASH_BITS)
    one = (last + np.uint64(1)) * _ODD[0]
    two = one + (full[1:-1] + np.uint64(2)) * _ODD[1]
    three = two + (full[:-2] + np.uint64(3)) * _ODD[2]
    mixed = np.concatenate([one[last > 0], two, three])
    mixed ^= mixed >> np.uint64(29)
    return bool(c.any()), (mixed * _ODD[1] >> shift).astype(np.int64), full[-2:]


def _all_ids(text: str) -> np.ndarray:
    tail, out = _START, []
    for i in range(0, max(1, len(text)), PIECE_CHARS):
        _, ids, tail = _ngrams(text[i : i + PIECE_CHARS], tail)
        out.append(ids)
    return np.concatenate(out)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], langs: list[str], seed: int = 3, epochs: int = 4, alpha: float = 0.6, beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-3, scale: float = 4.0) -> Model | None:
    """None if there is nothing to learn from."""
    names = tuple(sorted(set(langs)))
    if not names:
        return None
    rng, rows = np.random.default_rng(seed), []
    for t, g in zip(texts, langs, strict=True):
        y = names.index(g)
        rows.append((t, y))
        for width in (24, 80, 300):
            if len(t) > width:
                at = int(rng.integers(0, len(t) - width))
                rows.append((t[at : at + width], y))
    vectors = [np.unique(_all_ids(t), return_counts=True) for t, _ in rows]
    df = np.zeros(N_IDS, np.int32)
    for ids, _ in vectors:
        df[ids] += 1
    used = np.flatnonzero(df >= 3)
    dense = np.full(N_IDS, -1, np.int32)
    dense[used] = np.arange(len(used))
    idf = (np.log((1 + len(rows)) / (1 + df[used])) + 1) * scale
    data = []
    for (ids, n), (_, y) in zip(vectors, rows, strict=True):
        at = dense[ids]
        ok = at >= 0
        data.append((at[ok], (n[ok] / max(1, n.sum()) * idf[at[ok]]), y))
    order = rng.permutation(len(data))
    aside = set(order[: len(data) // 5].tolist()) if len(data) >= 50 else set()
    k = len(names)
    z, n2 = np.zeros((len(used) + 1, k)), np.zeros((len(used) + 1, k))

    def weight(at: np.ndarray) -> np.ndarray:
        zz, nn = z[at], n2[at]
        shrunk = np.sign(zz) * np.maximum(np.abs(zz) - l1, 0)
        return -shrunk / ((beta + np.sqrt(nn)) / alpha + l2)

    bias = len(used)
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            if i in aside:
                continue
            at, x, y = data[i]
            at, x = np.append(at, bias), np.append(x, 0.1)
            w = weight(at)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            z[at] += g - (np.sqrt(n2[at] + g * g) - np.sqrt(n2[at])) / alpha * w
            n2[at] += g * g
    w = weight(np.arange(len(used) + 1))
    logits = np.array([data[i][1] @ w[data[i][0]] + 0.1 * w[bias] for i in sorted(aside)]).reshape(-1, k)
    truth = np.array([data[i][2] for i in sorted(aside)], int)
    steps = np.geomspace(0.02, 5, 80)
    loss = [-np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in steps] if len(truth) else [0.0]
    temperature = float(steps[int(np.argmin(loss))]) if len(truth) else 1.0
    keep = np.abs(w[:-1]).sum(axis=1) > 0
    return Model(names, used[keep], (w[:-1] * idf[:, None])[keep].astype(np.float32), 0.1 * w[bias], temperature)


def _load(m: Model) -> tuple[np.ndarray, np.ndarray]:
    """The place of every id's weights, and the weights; place 0 has none."""
    place = np.zeros(N_IDS, np.int32)
    place[m.ids] = np.arange(1, len(m.ids) + 1)
    return place, np.concatenate([np.zeros((1, len(m.langs)), np.float32), m.weights.reshape(-1, len(m.langs))])


def predict(text: str | None, m: Model | None, loaded: tuple | None = None) -> tuple[str, float]:
    """(language, probability); (``und``, 0) for a text without letters."""
    if not text or m is None:
        return UNKNOWN, 0.0
    place, weights = loaded or _load(m)
    total, n, tail, seen = np.zeros(len(m.langs)), 0, _START, False
    for i in range(0, len(text), PIECE_CHARS):
        any_letter, ids, tail = _ngrams(text[i : i + PIECE_CHARS], tail)
        seen = seen or any_letter
        for j in range(0, len(ids), 1 << 16):
            total += weights[place[ids[j : j + (1 << 16)]]].sum(axis=0, dtype=np.float64)
        n += len(ids)
    if not seen:
        return UNKNOWN, 0.0
    p = _softmax((total / max(1, n) + m.bias) / m.temperature)
    best = int(p.argmax())
    return m.langs[best], float(p[best])


def train(docs: DataFrame, usable: Column, per_language: int = TRAIN_PER_LANGUAGE, seed: int = 5, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model | None:
    """Fits on about ``per_language`` texts of each language among the ``usable`` rows, drawn by a seeded hash of the id in one pass."""
    pool = docs.where(usable & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    counts = pool.groupBy(F.col(lang_col).alias("lang")).count().collect()
    if not counts:
        return None
    rate = F.coalesce(*[F.when(F.col(lang_col) == r["lang"], F.lit(min(1.0, per_language / r["count"]))) for r in counts], F.lit(0.0))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    rows = pool.where(draw < rate).select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.col(lang_col).alias("g")).collect()
    rows = sorted(rows, key=lambda r: (r["i"], r["t"]))
    return fit([r["t"] for r in rows], [r["g"] for r in rows])


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, lang_pred, score.

    A null text, or one without a letter, is ``und`` with score 0; so is every
    text if nothing could be learned. Ties go to the language first in the
    alphabet. Repeated rows give repeated rows; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        loaded = _load(m) if m is not None else None
        for b in batches:
            got = [predict(t.as_py(), m, loaded) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g for g, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model | None, min_score: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a letter and a language of at least ``min_score``; all rows with a letter if nothing could be learned."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def known(text: str | None, m: Model | None, loaded: tuple | None) -> bool:
        if m is None:
            return any(map(str.isalpha, text or ""))
        name, score = predict(text, m, loaded)
        return name != UNKNOWN and score >= min_score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        loaded = _load(m) if m is not None else None
        for b in batches:
            yield b.filter(pa.array([known(t.as_py(), m, loaded) for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
