"""MinHash signatures of shingle sets and exact comparison of full sets, shared by the two operators on them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from runwarden.llm.hashing import as_bytes, shingles
from runwarden.llm.tables import lean, slices

_BLOCK = 1 << 15


@lru_cache(maxsize=8)
def permutations(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of universal hash functions x -> high half of (a x + b) modulo 2**64."""
    random = np.random.default_rng(seed)
    a = random.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, random.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2)


def signatures(hashes: np.ndarray, first: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Smallest value of each permutation over the shingles of each text, 32 bits; all ones for a text without any."""
    texts = len(first) - 1
    out = np.full((count, texts), np.iinfo(np.uint64).max, dtype=np.uint64)
    a, b = permutations(count, seed)
    scratch = np.empty(_BLOCK, np.uint64)
    # blocks of shingles stay in the processor's cache while all permutations pass over them
    for start in range(0, len(hashes), _BLOCK):
        block = hashes[start : start + _BLOCK]
        low = np.searchsorted(first, start, side="right") - 1
        high = np.searchsorted(first, start + len(block), side="left")
        full = np.flatnonzero(np.diff(np.clip(first[low : high + 1], start, start + len(block))))
        at = np.maximum(first[low + full] - start, 0)
        room = scratch[: len(block)]
        for k in range(count):
            np.multiply(block, a[k], out=room)
            np.add(room, b[k], out=room)
            least = np.minimum.reduceat(room, at)
            np.minimum(out[k, low + full], least, out=least)
            out[k, low + full] = least
    return (out >> np.uint64(32)).astype(np.uint32).T.copy()


_EVEN, _ODD = np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3)


def sets(hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Distinct shingles of each text, rising."""
    out = []
    for start, end in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        part = np.sort(hashes[start:end])
        out.append(part[np.concatenate(([True], part[1:] != part[:-1]))] if len(part) else part)
    return out


def set_key(members: np.ndarray) -> bytes | None:
    """128 bits that equal sets share; null for an empty set."""
    if not len(members):
        return None
    one = (members ^ (members >> np.uint64(29))) * _EVEN
    two = (members ^ (members >> np.uint64(31))) * _ODD
    return np.array([one.sum(dtype=np.uint64), two.sum(dtype=np.uint64)], "<u8").tobytes()


def _small(members: np.ndarray) -> bytes:
    """The 48 high bits of each member."""
    return np.ascontiguousarray(members.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """The members of a packed set, rising."""
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def full_sets(docs: DataFrame, width: int, lower: bool) -> DataFrame:
    """Columns id, members (the distinct shingles as 48-bit hashes) of the columns id, text."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = sets(*shingles(as_bytes(part.column(1).to_pylist(), lower), width))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([_small(x) for x in found], pa.binary())], ["id", "members"]
                )

    return docs.select("id", "text").mapInArrow(lean(run), f"id {kind}, members binary")
