"""Hashed five-word shingle sets of whole texts, batch by batch in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WIDTH = 5
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingles of every text (A-Z lowered, words between ASCII white space); empty without words."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("") if texts.null_count else texts))
    flat, owner = split.flatten(), pc.list_parent_indices(split)
    worded = pc.greater(pc.binary_length(flat), 0)
    flat, owner = flat.filter(worded), owner.filter(worded).to_numpy()
    names = flat.dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(names.dictionary))
    words = known[names.indices.to_numpy(zero_copy_only=False)] if len(names) else np.zeros(0, np.uint64)
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    n = max(0, len(words) - WIDTH + 1)
    rolled = np.zeros(n, np.uint64)
    for i in range(WIDTH):
        rolled += words[i : i + n] * _STEPS[i]
    rolled = mix(rolled)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a >= WIDTH:
            yield np.unique(rolled[a : b - WIDTH + 1])
        elif b > a:
            yield mix(np.array([(words[a:b] * _STEPS[: b - a]).sum() + np.uint64(b - a)], dtype=np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def vertex(shingles: np.ndarray) -> int:
    """64 bits that stand for a whole set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def pieces(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``most`` bytes (or one longer text)."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)
