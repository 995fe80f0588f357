"""Vectorised tokenising and hashing of whole Arrow text columns.

A token is a maximal run of ASCII letters, digits or bytes above 0x7F, lower-cased.
Its 64-bit hash comes from a prefix polynomial over the UTF-8 bytes, so a whole
batch is hashed with a handful of numpy passes and no per-word Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_SEG = 1 << 17
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_NGRAM = [np.uint64(x | 1) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3)]
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser; another seed gives an independent permutation."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _pows(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        _powers = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, _SEG + 1), b, np.uint64))]) for b in (_P, _INV))
    return _powers


@dataclass
class Tokens:
    """hash: of each token. offs: document i owns tokens offs[i]:offs[i + 1].
    start, end: byte bounds in the lower-cased text, counted from the batch's first byte."""

    hash: np.ndarray
    offs: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    byte_offs: np.ndarray

    def __len__(self) -> int:
        return len(self.offs) - 1

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.offs))


def tokenize(texts: pa.Array) -> Tokens:
    """Nulls count as empty texts."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    n = len(texts)
    _, offs_buf, data_buf = texts.buffers()
    offs = np.frombuffer(offs_buf, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data_buf, np.uint8)[offs[0] : offs[-1]] if data_buf else np.zeros(0, np.uint8)
    offs = offs - offs[0]
    word = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last[:-1] &= ~word[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        base = start[i]
        j = max(i + 1, int(np.searchsorted(end, base + _SEG, "right")))
        piece = data[base : end[j - 1]].astype(np.uint64) + np.uint64(1)
        up, down = _pows(len(piece) + 1)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * up[: len(piece)], out=total[1:])
        out[i:j] = (total[end[i:j] - base] - total[start[i:j] - base]) * down[start[i:j] - base]
        i = j
    return Tokens(mix(out), np.searchsorted(start, offs), start, end, data, offs)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts of a batch whose texts hold about `most` bytes; a longer text comes alone, whole."""
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(size, size[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def ngrams(t: Tokens, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and first token of each word n-gram, and the documents' offsets into them.
    A document of fewer than n tokens, but at least one, has one gram: all of it."""
    size = np.diff(t.offs)
    grams = np.where(size == 0, 0, np.maximum(size - n + 1, 1))
    offs = np.concatenate([[0], np.cumsum(grams)])
    at = np.arange(offs[-1]) + np.repeat(t.offs[:-1] - offs[:-1], grams)
    stop = np.repeat(t.offs[1:], grams)
    if not len(at):
        return np.zeros(0, np.uint64), at, offs
    total = t.hash[at] * _NGRAM[0]
    for j in range(1, n):
        inside = at + j < stop
        total = total * _NGRAM[7] + np.where(inside, t.hash[np.minimum(at + j, len(t.hash) - 1)], np.uint64(j)) * _NGRAM[j % 7]
    return mix(total), at, offs


def sets(values: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct values, ascending, and their offsets."""
    parts = [np.unique(values[a:b]) for a, b in zip(offs[:-1], offs[1:], strict=True)]
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def over(ufunc: np.ufunc, values: np.ndarray, offs: np.ndarray, empty) -> np.ndarray:
    """ufunc reduced over each document's values; `empty` for documents without any."""
    out = np.full((len(offs) - 1, *values.shape[1:]), empty, values.dtype)
    some = np.diff(offs) > 0
    if some.any():
        out[some] = ufunc.reduceat(values, offs[:-1][some], axis=0)
    return out


def binaries(values: np.ndarray, offs: np.ndarray) -> pa.Array:
    """values[offs[i]:offs[i + 1]] as a binary each, without a Python object for any."""
    at = pa.py_buffer((offs * values.itemsize).astype(np.int64))
    return pa.Array.from_buffers(pa.large_binary(), len(offs) - 1, [None, at, pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())
