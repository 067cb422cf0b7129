"""Byte-pair encoding and decoding with a given vocabulary.

A piece of text is merged with a priority queue of (merge rank, position) over a doubly linked list of
symbols. An entry whose symbols have changed since it was queued is stale and skipped. Equal pieces are
encoded once per worker, in a cache of bounded size. Decoding concatenates the vocabulary strings.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runwarden.llm.tables import slices

# Fixed value: the split pattern of byte-level vocabularies of this family.
PIECES = regex.compile(r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# A piece never holds a non-space followed by a space: where every space stands alone, a text may be cut at it.
OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_NEIGHBOURS = ["  ", *(pair for c in "\t\n\r\x0b\x0c" for pair in (c + " ", " " + c))]
CACHED = 250_000
_LONGEST_CACHED = 64


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else 256 upwards."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Cache(dict):
    """Keeps what ``make`` gave for a key. When full, the entries used since the last time it was full stay."""

    def __init__(self, make: Callable[[str], bytes], most: int | None = None) -> None:
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
            if len(key) > _LONGEST_CACHED:
                return found
        self[key] = found
        return found

    def turn(self) -> None:
        if len(self) > (self.most or CACHED):
            self.older = dict(self)
            self.clear()


class Encoder:
    """Encodes and decodes with one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        vocabulary = read["model"]["vocab"]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(read["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((vocabulary[left], vocabulary[right]), (rank, vocabulary[left + right]))
        characters = byte_characters()
        self.byte_ids = [vocabulary[c] for c in characters]
        self.special = {x["content"]: x["id"] for x in read["added_tokens"]}
        of_character = {c: b for b, c in enumerate(characters)}
        self.strings: dict[int, bytes] = {i: bytes(of_character[c] for c in s) for s, i in vocabulary.items()}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.split_special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self.pieces = Cache(lambda piece: array("I", self.merge(piece.encode())).tobytes())
        self.spaced = Cache(lambda part: b"".join(map(self.pieces.__getitem__, PIECES.findall(" " + part))))

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece after all merges, lowest rank first, leftmost first among equals."""
        ids = [self.byte_ids[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        merges = self.merges
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []
        for i in range(n - 1):
            pair = ids[i], ids[i + 1]
            if found := merges.get(pair):
                queue.append((found[0], i, pair, found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, pair, merged = heapq.heappop(queue)
            j = after[i]
            # stale: one of the two symbols has been merged with another since
            if j >= n or ids[i] != pair[0] or ids[j] != pair[1]:
                continue
            ids[i], ids[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                pair = merged, ids[k]
                if found := merges.get(pair):
                    heapq.heappush(queue, (found[0], i, pair, found[1]))
            h = before[i]
            if h >= 0:
                pair = ids[h], merged
                if found := merges.get(pair):
                    heapq.heappush(queue, (found[0], h, pair, found[1]))
        return [x for x in ids if x >= 0]

    def _plain(self, text: str) -> bytes:
        if any(pair in text for pair in _NEIGHBOURS) or OTHER_SPACE.search(text):
            return b"".join(map(self.pieces.__getitem__, PIECES.findall(text)))
        first, *rest = text.split(" ")
        start = b"".join(map(self.pieces.__getitem__, PIECES.findall(first)))
        return start + b"".join(map(self.spaced.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; strings of special tokens in the text become their ids."""
        self.pieces.turn()
        self.spaced.turn()
        if self.split_special is None or not self.split_special.search(text):
            return self._plain(text)
        return b"".join(
            array("I", [self.special[part]]).tobytes() if part in self.special else self._plain(part)
            for part in self.split_special.split(text)
        )

    def decode(self, ids: bytes) -> str:
        """The vocabulary strings of the ids one after another, as text."""
        return b"".join(map(self.strings.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    return Encoder(path)


_SCHEMA = "id {id}, ids binary, decoded string"


def encode_decode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns id, ids (binary, little-endian unsigned 32 bit), decoded: one row per document, nothing shuffled.

    A null text counts as empty and gives no ids. Repeated rows stay; other columns are left out.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path)
        for batch in batches:
            for part in slices(batch, 1):
                ids = [codec.encode(text or "") for text in part.column(1).to_pylist()]
                decoded = [codec.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                    names=["id", "ids", "decoded"],
                )

    return docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(
        run, _SCHEMA.format(id=kind)
    )


def digests(encoded: DataFrame) -> DataFrame:
    """Counts and digests of ``encode_decode`` rows."""
    return encoded.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
