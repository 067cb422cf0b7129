"""Vectorised words, shingles and windows of texts, shared by the operators that compare texts.

A word is a run of bytes other than space and tab to carriage return (0x20, 0x09-0x0D) of the UTF-8 text.
Every word, shingle and window is a 64-bit hash; texts are handled in segments, so memory does not follow
the longest text times a constant above the hashes themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
_SEGMENT = 1 << 21
_LONG_WORD = 64  # bytes


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self._bases = base, pow(base, -1, 1 << 64)
        self._tables = tuple(np.ones(1, dtype=np.uint64) for _ in range(2))

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._tables[0]) < n:
            size = max(n, 2 * len(self._tables[0]))
            grown = []
            for base in self._bases:
                table = np.full(size, base, dtype=np.uint64)
                table[0] = 1
                np.multiply.accumulate(table, out=table)
                grown.append(table)
            self._tables = tuple(grown)
        return self._tables[0][:n], self._tables[1][:n]


_bytes, _words = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the whole 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _runs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, dtype=np.uint8)
    edge = np.ones(len(raw) + 2, dtype=bool)
    np.take(_SPACE, raw, out=edge[1:-1])
    turn = edge[1:] != edge[:-1]
    at = np.flatnonzero(turn)
    return raw, at[0::2], at[1::2]


def _segment_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw, start, end = _runs(data)
    if not len(start):
        return np.empty(0, np.uint64), start
    up, down = _bytes.upto(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.multiply(raw.astype(np.uint64) + np.uint64(1), up[:-1], out=sums[1:])
    np.cumsum(sums, out=sums)
    hashes = mix((sums[end] - sums[start]) * down[start])
    # sums modulo 2**64 can be equal for different words of very regular, long order
    for i in np.flatnonzero(end - start > _LONG_WORD).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest()
        hashes[i] = int.from_bytes(digest, "little")
    return hashes, start


def _segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while len(data) - at > _SEGMENT:
        cut = at + _SEGMENT
        # move back to a space; a word longer than a segment stays whole
        while cut > at and not _SPACE[data[cut]]:
            cut -= 1
        if cut == at:
            cut = at + _SEGMENT
            while cut < len(data) and not _SPACE[data[cut]]:
                cut += 1
        yield at, data[at:cut]
        at = cut
    yield at, data[at:]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts, and where each text's words begin (one entry more than texts)."""
    found, counts, pack, held = [], np.zeros(len(texts), dtype=np.int64), [], 0

    def flush() -> None:
        nonlocal pack, held
        if not pack:
            return
        hashes, start = _segment_words(b"\n".join(texts[i] for i in pack))
        ends = np.cumsum([len(texts[i]) + 1 for i in pack])
        edges = np.searchsorted(start, np.concatenate(([0], ends)))
        counts[pack] = np.diff(edges)
        found.append(hashes)
        pack, held = [], 0

    for i, text in enumerate(texts):
        if len(text) > _SEGMENT:
            flush()
            parts = [_segment_words(part)[0] for _, part in _segments(text)]
            counts[i] = sum(map(len, parts))
            found += parts
            continue
        if held + len(text) > _SEGMENT:
            flush()
        pack.append(i)
        held += len(text) + 1
    flush()
    hashes = np.concatenate(found) if found else np.empty(0, np.uint64)
    return hashes, np.concatenate(([0], np.cumsum(counts)))


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each position on, across text borders; the last positions have none."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _words.upto(len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.multiply(words, up[:-1], out=sums[1:])
    np.cumsum(sums, out=sums)
    return mix((sums[width:] - sums[:-width]) * down[:n])


def inside(edges: np.ndarray, width: int) -> np.ndarray:
    """Marks the positions of ``windows`` whose words all belong to one text."""
    n = int(edges[-1]) - width + 1
    if n <= 0:
        return np.empty(0, dtype=bool)
    step = np.zeros(int(edges[-1]) + 1, dtype=np.int32)
    sizes = np.diff(edges)
    full = sizes >= width
    np.add.at(step, edges[:-1][full], 1)
    np.add.at(step, edges[1:][full] - width + 1, -1)
    return np.cumsum(step)[:n] > 0


def shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles (repeats included) and each text's first position.

    A text of fewer words gives its whole sequence as one shingle; one without words gives none.
    """
    words, edges = word_hashes(texts)
    sizes = np.diff(edges)
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    counts = np.maximum(sizes - width + 1, 0)
    counts[short] = 1
    first = np.concatenate(([0], np.cumsum(counts)))
    out = np.empty(int(first[-1]), dtype=np.uint64)
    whole = np.ones(len(out), dtype=bool)
    whole[first[:-1][short]] = False
    out[whole] = windows(words, width)[inside(edges, width)]
    for i in short:
        part = words[edges[i] : edges[i + 1]]
        out[first[i]] = windows(part, len(part))[0] ^ np.uint64(len(part))
    return out, first


def as_bytes(texts: list[str | None], lower: bool = False) -> list[bytes]:
    """UTF-8 of each text (null: empty); with ``lower`` only A-Z change."""
    raw = [(text or "").encode("utf-8", "surrogatepass") for text in texts]
    return [x.lower() for x in raw] if lower else raw
