"""Tokens, hashed token runs and exact similarity shared by the overlap operators.

A token is a longest run of letters, digits and underscores, or one other character that is not white
space; texts are lower-cased first. Similarity is the Jaccard index of the sets of three consecutive
tokens and 0 if either set is empty. A null text has no tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

TOKEN = re.compile(r"\w+|[^\w\s]")
SHINGLE = 3
GROUP_CHARS = 1_000_000
#: A slice of a batch holds about so many bytes of text, and at most so many texts.
SLICE_BYTES, SLICE_ROWS = 4_000_000, 1 << 13
_SPACE, _WORD, _OTHER = 0, 1, 2


@cache
def _kinds(words_only: bool) -> np.ndarray:
    """Kind of each code point (space, word, other) as the pattern sees it; made once in a process. With ``words_only``
    all but letters and digits is space."""
    points = [chr(c) if not 0xD800 <= c < 0xE000 else "?" for c in range(0x110000)]
    kinds = np.full(0x110000, _SPACE if words_only else _OTHER, np.uint8)
    kinds[[i for i, c in enumerate(points) if c.isspace()]] = _SPACE
    kinds[[i for i, c in enumerate(points) if c.isalnum() or c == "_" and not words_only]] = _WORD
    return kinds


def _bytes(texts: pa.Array) -> np.ndarray:
    """Bytes of each text, or of the texts of each list."""
    if pa.types.is_list(texts.type):
        inner = np.concatenate(([0], np.cumsum(_bytes(texts.values))))
        ends = texts.offsets.to_numpy()
        return inner[ends[1:]] - inner[ends[:-1]]
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def sliced(batches: Iterator[pa.RecordBatch], column: int, *more: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of the batches with the texts of ``column``; a slice is bounded in bytes, also of the columns
    ``more``, so that memory does not follow the batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        held = np.cumsum(sum(_bytes(batch.column(c)) for c in (column, *more)))
        start = 0
        while start < batch.num_rows:
            room = SLICE_BYTES + (held[start - 1] if start else 0)
            stop = min(max(start + 1, int(np.searchsorted(held, room, "right"))), start + SLICE_ROWS)
            part = batch.slice(start, stop - start)
            yield part, part.column(column).to_pylist()
            start = stop


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words (the finaliser of a splitmix generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat_hashes(texts: list[str | None], words_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all tokens of all texts, one after the other, and the number of tokens of each text; with
    ``words_only`` of the longest runs of letters and digits.

    Texts are handled in groups of about ``GROUP_CHARS`` characters, each as one array of code points; what is held
    beside the hashes does not grow with the number of texts.
    """
    hashes, counts, start, held = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0, 0
    for i, text in enumerate(texts):
        held += len(text or "") + 1
        if held >= GROUP_CHARS or i + 1 == len(texts):
            h, c = _group_hashes(texts[start : i + 1], words_only)
            hashes.append(h)
            counts.append(c)
            start, held = i + 1, 0
    return np.concatenate(hashes), np.concatenate(counts)


def _group_hashes(texts: list[str | None], words_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """A token's hash is the sum of its code points, each times a random odd word that belongs to its place in the token."""
    lower = [t.lower() if t else "" for t in texts]
    lengths = np.fromiter(map(len, lower), np.int64, len(lower))
    points = np.frombuffer("\n".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    kind = _kinds(words_only)[points]
    word = kind == _WORD
    start = kind == _OTHER
    start[0] |= word[0]
    start[1:] |= word[1:] & ~word[:-1]
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    sizes = np.diff(np.append(at, len(points)))
    place = np.arange(at[0], len(points)) - np.repeat(at, sizes)
    factors = scramble(np.arange(1, int(place.max()) + 2, dtype=np.uint64)) | np.uint64(1)
    weights = (points[at[0] :].astype(np.uint64) + np.uint64(1)) * factors[place]
    weights[kind[at[0] :] == _SPACE] = 0
    ends = np.cumsum(lengths + 1)
    upto = np.searchsorted(at, ends)
    return scramble(np.add.reduceat(weights, at - at[0])), np.diff(np.concatenate(([0], upto)))


def runs(flat: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, position) of each run of ``width`` tokens that lies inside one text."""
    if len(flat) < width:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    n = len(flat) - width + 1
    h = scramble(flat[:n] + np.uint64(0x9E3779B97F4A7C15))
    for k in range(1, width):
        h = scramble(h * np.uint64(3) + flat[k : k + n])
    owner = np.repeat(np.arange(len(counts)), counts)
    starts = np.concatenate(([0], np.cumsum(counts)))[:-1]
    inside = owner[:n] == owner[width - 1 :]
    owner = owner[:n][inside]
    return h[inside], owner, np.flatnonzero(inside) - starts[owner]


def shingle_set(text: str | None) -> set[tuple[str, str, str]]:
    found = tokens(text)
    return set(zip(found, found[1:], found[2:]))


def similarities(a: list[str | None], b: list[str | None], threshold: float) -> np.ndarray:
    """Similarity of a[i] and b[i]. Hashed shingles decide, except within 0.02 of ``threshold``, where the shingles themselves do."""
    n, out = len(a), []
    step = 1 << 12
    for k in range(0, n, step):
        x, y = a[k : k + step], b[k : k + step]
        keys, sizes = [], []
        for texts in (x, y):
            h, owner, _ = runs(*flat_hashes(texts), SHINGLE)
            key = np.sort((owner.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
            keys.append(key[np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1]))])
            sizes.append(np.bincount((keys[-1] >> np.uint64(48)).astype(np.int64), minlength=len(x)))
        joint = np.sort(np.concatenate(keys))
        both = joint[1:][joint[1:] == joint[:-1]]
        shared = np.bincount((both >> np.uint64(48)).astype(np.int64), minlength=len(x))
        found = shared / np.maximum(1, sizes[0] + sizes[1] - shared)
        for i in np.flatnonzero(np.abs(found - threshold) < 0.02):
            found[i] = jaccard(shingle_set(x[i]), shingle_set(y[i]))
        out.append(found)
    return np.concatenate(out) if out else np.zeros(0)


def jaccard(a: set, b: set) -> float:
    if not a or not b:
        return 0.0
    both = len(a & b)
    return both / (len(a) + len(b) - both)
