"""Rows of many files as frames of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

#: A piece ends with the row that brings its weight to this: a value weighs one and its characters or bytes, a list of text its values.
MOST = 1 << 20


def _weight(row: tuple) -> int:
    n = len(row)
    for v in row:
        if isinstance(v, list):
            n += len(v) + sum(map(len, filter(None, v)))
        elif isinstance(v, (str, bytes)):
            n += len(v)
    return n


def in_pieces(rows: Iterable[tuple], names: list[str], most: int = MOST) -> Iterator:
    """``rows`` as data frames, none of which holds more than ``most`` and one row; a batch has up to 10,000 files, whose rows are never held together."""
    import pandas as pd

    piece, held = [], 0
    for r in rows:
        piece.append(r)
        held += _weight(r)
        if held >= most:
            yield pd.DataFrame(piece, columns=names)
            piece, held = [], 0
    if piece:
        yield pd.DataFrame(piece, columns=names)
