"""Quality classifier by compression: zstandard dictionaries of good and bad text.

A text is cut into short pieces, so that the dictionary and not the text itself
explains each, and compressed with either dictionary. The difference of the
sizes by the text's length goes through a logistic curve fitted on labelled
texts that the dictionaries have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample

#: Labelled documents of either class in the training sample, at most.
TRAIN_PER_CLASS = 1500
DICT_BYTES = 112 << 10
PIECE_BYTES = 512
#: Pieces of either class from which its dictionary is made, at most.
DICT_PIECES = 12_000
LEVEL = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float


def _pieces(data: bytes) -> Iterator[bytes]:
    return (data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES))


def _dictionary(texts: list[bytes], seed: int) -> bytes:
    import zstandard

    pieces = [p for t in texts for p in _pieces(t)]
    rng = np.random.default_rng(seed)
    if len(pieces) > DICT_PIECES:
        pieces = [pieces[i] for i in sorted(rng.choice(len(pieces), DICT_PIECES, replace=False))]
    total = sum(map(len, pieces))
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, total // 8)), pieces).as_bytes()
    except zstandard.ZstdError:  # too few samples: the text itself serves as the dictionary
        return b"".join(pieces)[-DICT_BYTES:]


class Sizer:
    """Normalised size difference of a text under the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        self.both = []
        for raw in (good, bad):
            if not raw:
                self.both.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False))
                continue
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self.both.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False))

    def __call__(self, text: str | None) -> float:
        data = (text or "").encode("utf-8", "replace")
        if not data:
            return 0.0
        good, bad = self.both
        diff = sum(len(bad.compress(p)) - len(good.compress(p)) for p in _pieces(data))
        return diff / len(data)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset by Newton steps; both classes weigh the same. x is scaled inside."""
    if not len(x) or y.min() == y.max():
        return 0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else 0.0
    s = float(np.abs(x).mean()) or 1.0
    a, w = np.stack([x / s, np.ones(len(x))], axis=1), np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        grad = a.T @ (w * (y - p)) - ridge * np.array([b[0], 0])
        hess = (a * (w * p * (1 - p))[:, None]).T @ a + np.diag([ridge, 1e-9])
        step = np.linalg.solve(hess, grad)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0] / s), float(b[1])


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> Model:
    """labels: doc_id, quality, of rows that may be learned from. Two thirds of the sample make the dictionaries, the rest the curve."""
    rows = sorted((r["y"], r["u"], r["text"]) for r in labelled_sample(docs, labels, "quality", per_class).collect())
    raw = {y: [t.encode("utf-8", "replace") for c, u, t in rows if c == y and u < 66] for y in (0, 1)}
    good, bad = _dictionary(raw[1], 1), _dictionary(raw[0], 2)
    sizer = Sizer(good, bad)
    rest = [(sizer(t), y) for y, u, t in rows if u >= 66]
    slope, offset = logistic(np.array([x for x, _ in rest]), np.array([y for _, y in rest], int))
    return Model(good, bad, slope, offset)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, score (0 to 1), predicted.

    Null and empty texts have no size difference and get the curve's value at
    zero. Repeated rows give repeated rows, an empty table an empty result;
    without labels of both classes the score is the share of the one there is.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        sizer = Sizer(m.good, m.bad)
        for b in batches:
            x = np.array([sizer(t.as_py()) for t in b.column(1)], float)
            p = 1 / (1 + np.exp(-np.clip(m.slope * x + m.offset, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")
