"""Packing of tokenised documents into sequences of equal length.

Documents are cut into whole sequences and short remainders; the remainders of a group are dealt into windows
by Karmarkar-Karp multiway differencing. A group's window count starts at the least possible and rises until
no window is over capacity.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from runwarden.llm.bpe import OTHER_SPACE, Cache, byte_characters
from runwarden.llm.tables import lean, slices, stage

CAPACITY = 2048
CUT = 512
PIECES_PER_GROUP = 4096


_LATIN_END = 0x250
_BEYOND_LATIN = re.compile(f"[{chr(_LATIN_END)}-\U0010ffff]")
_CACHED_PIECES = 300_000  # with their ids some 50 MB, and as many that were used lately


def _latin_class(of: regex.Pattern) -> str:
    """A character class of the matching characters below U+0250 and of their lower-case forms."""
    found = {c for n in range(_LATIN_END) for c in chr(n) + chr(n).lower() if of.match(c)}
    return "".join(map(re.escape, sorted(found)))


class WordTokens:
    """Ids of the tokenizers library for a vocabulary that drops white space, by distinct piece.

    No token spans white space there, and the file's own pattern splits a lower-cased text into the pieces that
    are merged. A text of Latin letters is split as a whole and each new piece goes straight to the library's merge
    model; of other texts, words with letters beyond go through the whole library. Texts that hold a special
    token's string, or white space outside ASCII, go to the library whole.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words, self.pieces = Cache(self._word), Cache(self._piece, _CACHED_PIECES)
        special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.pattern = self._own_pattern()
        self.characters = byte_characters()

    def _own_pattern(self) -> re.Pattern | None:
        """The file's split pattern for Latin letters, if its other steps are lower-casing, composing and dropping white space."""
        made = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (made["normalizer"] or {}).get("normalizers", [])]
        split, *rest = (made["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        plain = [x["type"] for x in rest] == ["ByteLevel"] and not rest[0]["use_regex"]
        if steps != ["NFC", "Replace", "Lowercase"] or split.get("type") != "Split" or not plain:
            return None
        found = split["pattern"]["Regex"]
        for name in (r"\p{L}", r"\p{N}"):
            found = found.replace(f"[{name}]", name).replace(name, f"[{name}]")
            inside = _latin_class(regex.compile(name))
            # inside a negated class the properties stand without brackets of their own
            found = re.sub(r"\[\^([^\]]*)\[" + re.escape(name) + r"\]", lambda m, x=inside: f"[^{m[1]}{x}", found)
            found = found.replace(f"[{name}]", f"[{inside}]")
        return re.compile(found)

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isalnum()):
            piece = "".join(map(self.characters.__getitem__, piece.encode()))
        return array("I", [x.id for x in self.tokenizer.model.tokenize(piece)]).tobytes()

    def _latin(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text.lower())))

    def _word(self, word: str) -> bytes:
        return self._library(word) if _BEYOND_LATIN.search(word) else self._latin(word)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        self.words.turn()
        self.pieces.turn()
        if self.pattern is None or OTHER_SPACE.search(text) or self.special.search(text):
            return self._library(text)
        if not _BEYOND_LATIN.search(text):
            return self._latin(text)
        return b"".join(map(self.words.__getitem__, text.split()))


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def cuts(tokens: int, capacity: int = CAPACITY, cut: int = CUT) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, then near-equal parts of at most ``cut``."""
    whole = tokens // capacity
    out = [(i * capacity, capacity) for i in range(whole)]
    start, rest = whole * capacity, tokens - whole * capacity
    parts = -(-rest // cut)
    for i in range(parts):
        size = rest // parts + (i < rest % parts)
        out.append((start, size))
        start += size
    return out


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Positions of ``sizes`` dealt into ``windows`` lists of near-equal sums.

    Each size starts as a partial partition with one filled window. The two partial partitions of widest
    spread are merged again and again, the fullest windows of one with the emptiest of the other.
    """
    n = len(sizes)
    halves = np.empty((n, 2), dtype=np.int64)
    made = 0
    parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def part(key: int) -> tuple[np.ndarray, np.ndarray]:
        if key >= n:
            return parts.pop(key)
        sums, nodes = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        sums[0], nodes[0] = sizes[key], key
        return sums, nodes

    def joined(a: int, b: int) -> int:
        nonlocal made
        halves[made] = a, b
        made += 1
        return n + made - 1

    def inserted(values: np.ndarray, at: int, value: int) -> np.ndarray:
        """``values`` without the last, and ``value`` at a position."""
        out = np.empty(windows, np.int64)
        out[:at], out[at], out[at + 1 :] = values[:at], value, values[at:-1]
        return out

    queue = [(-size, key) for key, size in enumerate(sizes)]
    heapq.heapify(queue)
    key = n
    while len(queue) > 1:
        one, two = heapq.heappop(queue)[1], heapq.heappop(queue)[1]
        single = one if one < n else two
        if single < n:
            # a single size goes to the emptiest window of the other partition, and only that window moves
            sums, nodes = part(two if single == one else one)
            value, node = int(sums[-1]) + sizes[single], int(nodes[-1])
            at = windows - 1 - int(np.searchsorted(sums[-2::-1], value)) if windows > 1 else 0
            sums, nodes = inserted(sums, at, value), inserted(nodes, at, single if node < 0 else joined(node, single))
            sums -= sums[-1]
            parts[key] = sums, nodes
            heapq.heappush(queue, (-int(sums[0]), key))
            key += 1
            continue
        (sums, nodes), (sums2, nodes2) = part(one), part(two)
        sums, nodes2 = sums + sums2[::-1], nodes2[::-1]
        both = np.flatnonzero((nodes >= 0) & (nodes2 >= 0))
        mixed = np.maximum(nodes, nodes2)
        if len(both):
            halves[made : made + len(both), 0] = nodes[both]
            halves[made : made + len(both), 1] = nodes2[both]
            mixed[both] = n + np.arange(made, made + len(both))
            made += len(both)
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        sums -= sums[-1]
        parts[key] = sums, mixed[order]
        heapq.heappush(queue, (-int(sums[0]), key))
        key += 1
    out = []
    for node in part(queue[0][1])[1].tolist() if queue else []:
        items, open_nodes = [], [node] if node >= 0 else []
        while open_nodes:
            top = open_nodes.pop()
            if top < n:
                items.append(top)
            else:
                open_nodes += halves[top - n].tolist()
        out.append(sorted(items))
    return [x for x in out if x]


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most ``capacity``; the window count rises whenever one is over it."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt = difference(sizes, windows)
        if all(sum(sizes[i] for i in window) <= capacity for window in dealt):
            return dealt
        windows += max(1, windows // 256)


def pieces(
    docs: DataFrame, path: str, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Columns doc_id, start, length, ids_crc32, doc_tokens, ids of every piece; nothing is shuffled.

    A null text counts as empty: one piece with the end id. Repeated rows give repeated pieces.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, end = word_tokens(path), array("I", [end_id]).tobytes()
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = codec.encode(text or "") + end
                    total = len(ids) // 4
                    for start, length in cuts(total):
                        piece = ids[4 * start : 4 * (start + length)]
                        rows.append((doc, start, length, zlib.crc32(piece), total, piece))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(column, part.column(0).type if k == 0 else pa.binary() if k == 5 else pa.int64())
                        for k, column in enumerate(zip(*rows, strict=True))
                    ],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"],
                )
        # the worker outlives the task; only what was used lately is worth its memory
        codec.words.older, codec.pieces.older = {}, {}

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(
        lean(run), schema
    )


def sequences(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to the pieces (columns doc_id, start, length, ids_crc32, doc_tokens).

    Only these numbers are shuffled. A group holds about 4,096 pieces, dealt by a hash of the row's place, so
    repeated documents spread as well; the number of groups follows the number of pieces. Sequence ids are
    unique over all groups but have gaps.
    """
    numbered = cut.select("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    stored = stage(numbered.withColumn("_deal", F.xxhash64(F.monotonically_increasing_id())), "pieces")
    groups = -(-stored.count() // PIECES_PER_GROUP) or 1
    kind = cut.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def deal(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "_deal"], ascending=[False, True], kind="stable", ignore_index=True)
        sizes = group["length"].to_numpy()
        whole = int((sizes == capacity).sum())
        windows = [[i] for i in range(whole)] + [
            [whole + i for i in window] for window in pack(sizes[whole:].tolist(), capacity)
        ]
        order = np.fromiter((i for window in windows for i in window), np.int64, len(group))
        number = np.repeat(np.arange(len(windows)), [len(window) for window in windows])
        ends = np.cumsum(sizes[order])
        starts = ends - sizes[order]
        firsts = np.concatenate(([0], np.cumsum([len(window) for window in windows])[:-1])).astype(np.int64)
        out = group.iloc[order].reset_index(drop=True)
        out["sequence_id"] = number * groups + int(group["_group"].iloc[0])
        out["offset"] = starts - np.repeat(starts[firsts], [len(window) for window in windows])
        return out.drop(columns=["_deal", "_group"])

    return (
        stored.withColumn("_group", F.expr(f"pmod(_deal, {groups})")).groupBy("_group").applyInPandas(deal, schema)
    )


def fill(cut: DataFrame, placed: DataFrame, capacity: int = CAPACITY, padding_id: int = 0) -> DataFrame:
    """The sequences themselves: sequence_id, ids (array of ``capacity`` ids, or of a power of two below it).

    ``cut`` are the pieces with their ids, ``placed`` the result of ``sequences`` over them. Pieces of equal
    document, start and checksum hold equal ids, so one of them stands for all.
    """
    keys = ["doc_id", "start", "ids_crc32", "length"]
    one = cut.groupBy(*keys).agg(F.first("ids").alias("ids"))
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    joined = placed.alias("p").join(one.alias("o"), same)
    spec = "sequence_id long, ids array<long>"

    def lay(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("offset")
        ids = np.frombuffer(b"".join(group["ids"]), "<u4").astype(np.int64)
        if len(ids) & (len(ids) - 1):
            ids = np.concatenate([ids, np.full(capacity - len(ids), padding_id)])
        return pd.DataFrame({"sequence_id": [group["sequence_id"].iloc[0]], "ids": [ids]})

    return joined.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInPandas(lay, spec)
