"""Recursive text chunking: strongest separator first, overlap between neighbours."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import rules
from tidemark.functions.slices import mapped


def _pieces(text: str, separator: str) -> list[str]:
    """Split so that every piece but the first begins with its separator."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in (head, *(separator + r for r in rest)) if p]


def _pack(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Join neighbouring pieces up to ``size``; the next chunk restarts within ``overlap``."""
    packed, start, total = [], 0, 0
    for i, piece in enumerate(pieces):
        if total + len(piece) > size and i > start:
            packed.append("".join(pieces[start:i]))
            while total > overlap or (total > 0 and total + len(piece) > size):
                total -= len(pieces[start])
                start += 1
        total += len(piece)
    packed.append("".join(pieces[start:]))
    return [chunk for chunk in (p.strip() for p in packed) if chunk]


def split_text(text: str, size: int = rules.CHUNK_SIZE, overlap: int = rules.CHUNK_OVERLAP,
               separators: tuple[str, ...] = tuple(rules.CHUNK_SEPARATORS)) -> list[str]:
    level = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    weaker = separators[level + 1:]
    chunks: list[str] = []
    run: list[str] = []
    for piece in _pieces(text, separators[level]):
        if len(piece) < size:
            run.append(piece)
            continue
        if run:
            chunks += _pack(run, size, overlap)
            run = []
        chunks += split_text(piece, size, overlap, weaker) if weaker else [piece]
    return chunks + (_pack(run, size, overlap) if run else [])


@F.arrow_udf(T.ArrayType(T.StringType()))
def _chunks(texts: pa.Array) -> pa.Array:
    return mapped(texts, lambda t: split_text(t.strip()) if t else [], pa.list_(pa.string()))


def chunks(text: Column) -> Column:
    return _chunks(text)
