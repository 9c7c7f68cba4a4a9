"""Whole-batch tokenising and hashing over Arrow string buffers: no Python work per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64

#: Bytes that one pass of the vectorised code covers; a longer single text is a pass of its own.
CHUNK_BYTES = 512 << 10


def byte_mask(ranges: list[tuple[int, int]]) -> np.ndarray:
    """True for the bytes in the inclusive ranges."""
    mask = np.zeros(256, bool)
    for lo, hi in ranges:
        mask[lo : hi + 1] = True
    return mask


#: Bytes of a word [^\x20\x09-\x0D]+
NOT_SPACE = ~byte_mask([(0x20, 0x20), (0x09, 0x0D)])
#: Bytes of a word [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z have been lower-cased
ALNUM = ~byte_mask([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240117)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=_U) * _U(2) + _U(1)
_COEF = _RANDOM.integers(0, 1 << 63, 64, dtype=_U) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n + n // 4, base, _U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def string_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about CHUNK_BYTES of text; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


class Words:
    """Words of some texts: 64-bit hash and text number of each, in order; counts and first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray, lower: bool = True):
        texts = len(offsets) - 1
        if lower:
            data = _LOWER[data]
        inside = word_bytes[data]
        fresh = np.zeros(len(data) + 1, bool)
        fresh[offsets[:-1]] = True
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        before &= ~fresh[:-1]
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        after &= ~fresh[1:]
        self.start = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after)
        power, self._inverse = _power_tables(len(data) + 1)
        self._total = np.zeros(len(data) + 1, _U)
        np.cumsum(_BYTE[data] * power[: len(data)], out=self._total[1:])
        self.length = end - self.start + 1
        self.hash = self.beginnings(slice(None), self.length)
        self.text = np.searchsorted(offsets, self.start, "right") - 1
        self.count = np.bincount(self.text, minlength=texts)
        self.first = np.concatenate([[0], np.cumsum(self.count)])

    def beginnings(self, which: np.ndarray | slice, length: np.ndarray | int) -> np.ndarray:
        """The hashes of the first ``length`` bytes of some words that have so many; they are those of words of these bytes alone."""
        start = self.start[which]
        own = (self._total[start + length] - self._total[start]) * self._inverse[start]
        return mix64(own ^ np.asarray(length, np.int64).astype(_U) * _U(0xD6E8FEB86659FD93))

    def grams(self, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text number) of every run of k words, in order. With ``short``, a text of 1 to k-1 words gives its whole sequence as one run."""
        n = len(self.hash)
        m = max(0, n - k + 1)
        out = np.zeros(m, _U)
        for j in range(k):
            out += self.hash[j : j + m] * _COEF[j]
        whole = self.text[:m] == self.text[n - m :]
        out, text = mix64(out[whole]), self.text[:m][whole]
        few = np.flatnonzero((self.count > 0) & (self.count < k)) if short else []
        if len(few):
            more = np.array([self._sequence(t) for t in few], _U)
            out, text = np.concatenate([out, mix64(more)]), np.concatenate([text, few])
            order = np.argsort(text, kind="stable")
            out, text = out[order], text[order]
        return out, text

    def _sequence(self, text: int) -> int:
        own = self.hash[self.first[text] : self.first[text + 1]]
        return (own * _COEF[: len(own)]).sum(dtype=_U) ^ _U(len(own) * 0x9FB21C651E98DF25 & (1 << 64) - 1)


def count_by_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The number of true values in each text's part of a mask over all bytes."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def distinct_by_text(hashes: np.ndarray, text: np.ndarray, texts: int) -> list[np.ndarray]:
    """For each text its distinct hashes, ascending. ``text`` must be ascending."""
    bounds = np.searchsorted(text, np.arange(texts + 1))
    out = []
    for t in range(texts):
        own = np.sort(hashes[bounds[t] : bounds[t + 1]])
        if len(own) > 1:
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        out.append(own)
    return out


def lists(parts: list[np.ndarray], kind: str = "int64") -> pa.Array:
    """An Arrow list column of 64-bit integers."""
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, _U)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(flat).view(kind)))


def word_hashes(text: str | bytes, word_bytes: np.ndarray) -> np.ndarray:
    """The hashes of one text's words, as Words gives them."""
    data = np.frombuffer(text.encode() if isinstance(text, str) else text, np.uint8)
    return Words(data, np.array([0, len(data)]), word_bytes).hash
