"""Removal of word passages that occur more than once.

Fixed-block anchors: every text is cut into non-overlapping reference blocks of 18 words, and all its rolling
windows of 18 words probe them. A passage of 35 words holds one whole block of its own text, and that block
is found again wherever the passage occurs. Hits are extended to the windows of 35 words around them, these
are counted, and neighbouring repeated windows make the maximal exact repeats.

Texts travel in batches of several megabytes, stored once, bucketed by batch. What is shuffled are sorted
hashes of a batch, coded by their distances; an answer goes back to a batch, not to a place, so a passage
that very many texts share is one entry for each batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runwarden.llm.hashing import as_bytes, inside, mix, windows, word_hashes
from runwarden.llm.tables import lean, slices, stage
from runwarden.session import fresh_dir

WIDTH = 35
BATCH_BYTES = 4 << 20
ENTRIES_PER_GROUP = 1_000_000
_LOW = np.uint64((1 << 48) - 1)


def _pack_sorted(values: np.ndarray) -> bytes:
    """Rising 48-bit numbers as distances of 32 bits; larger distances stand apart."""
    steps = np.diff(values, prepend=np.uint64(0))
    large = steps >= 0xFFFFFFFF
    short = np.where(large, np.uint64(0xFFFFFFFF), steps).astype("<u4")
    return len(values).to_bytes(8, "little") + short.tobytes() + steps[large].astype("<u8").tobytes()


def _unpack_sorted(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    steps = np.frombuffer(data, "<u4", n, 8).astype(np.uint64)
    steps[steps == 0xFFFFFFFF] = np.frombuffer(data, "<u8", -1, 8 + 4 * n)
    return np.cumsum(steps)


def _write_batches(docs: DataFrame, text_column: str) -> tuple[DataFrame, int]:
    """The rows in compressed batches (batch, size in words, rows), bucketed by batch, and the number of words."""
    spark = docs.sparkSession
    at = docs.columns.index(text_column)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in parts:
            for part in slices(batch, at, BATCH_BYTES):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(part)
                size = sum(len(x.split()) for x in as_bytes(part.column(at).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()])],
                    names=["batch", "n_words", "rows"],
                )
                number += 1

    # Equal bucketing lets answers meet the texts without moving the texts again.
    name = f"llm_batches_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = docs.mapInArrow(lean(run), "batch long, n_words long, rows binary")
    stored.write.bucketBy(buckets, "batch").option("path", fresh_dir(spark, "llm-batches")).option(
        "compression", "none"
    ).saveAsTable(name)
    table = spark.table(name)
    return table, table.agg(F.sum("n_words")).first()[0] or 0


def _rows(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _words(rows: pa.Table, text_column: str) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(as_bytes(rows.column(text_column).to_pylist()))


def _groups_of(values: np.ndarray, groups: int) -> np.ndarray:
    """Where each group's part of the rising 48-bit ``values`` begins (one entry more than groups)."""
    bounds = np.array([(g << 48) // groups for g in range(groups)], dtype=np.uint64)
    return np.append(np.searchsorted(values, bounds), len(values))


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, first places in that order, and counts of equal values."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    return order, first, np.diff(np.append(first, len(values)))


def _aligned(edges: np.ndarray, width: int, block: int) -> np.ndarray:
    """Marks the positions at which a reference block of a text begins and ends inside the text."""
    n = int(edges[-1]) - width + 1
    place = np.arange(max(n, 0)) - np.repeat(edges[:-1], np.diff(edges))[: max(n, 0)]
    return (place % block == 0) & inside(edges, width)


def _probes(batches: DataFrame, text_column: str, block: int, groups: int) -> DataFrame:
    """Per batch and group of hashes: the distinct window hashes, which are repeated in the batch, which are blocks."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for number, data in zip(part.column("batch").to_pylist(), part.column("rows").to_pylist(), strict=True):
                words, edges = _words(_rows(data), text_column)
                valid = inside(edges, block)
                values = windows(words, block)[valid] >> np.uint64(16)
                if not len(values):
                    continue
                order, first, counts = _distinct(values)
                is_block = np.logical_or.reduceat(_aligned(edges, block, block)[valid][order], first)
                values = values[order][first]
                cut = _groups_of(values, groups)
                full = np.flatnonzero(np.diff(cut))
                spans = [slice(cut[g], cut[g + 1]) for g in full]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(full, pa.int32()),
                        pa.array([number] * len(full), pa.int64()),
                        pa.array([_pack_sorted(values[s]) for s in spans], pa.binary()),
                        pa.array([np.packbits(counts[s] > 1).tobytes() for s in spans], pa.binary()),
                        pa.array([np.packbits(is_block[s]).tobytes() for s in spans], pa.binary()),
                    ],
                    names=["grp", "batch", "hashes", "repeated", "blocks"],
                )

    return batches.select("batch", "rows").mapInArrow(
        lean(run), "grp int, batch long, hashes binary, repeated binary, blocks binary"
    )


def _by_group(parts: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of one group together; the group is the first column."""
    held: list[tuple] = []
    for part in parts:
        for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _anchors(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch, its blocks whose words begin at another place as well."""
    for rows in _by_group(parts):
        lists = [_unpack_sorted(row[2]) for row in rows]
        sizes = [len(x) for x in lists]
        values = np.concatenate(lists)
        repeated = np.concatenate([_bits(row[3], n) for row, n in zip(rows, sizes, strict=True)])
        blocks = np.concatenate([_bits(row[4], n) for row, n in zip(rows, sizes, strict=True)])
        order, first, _ = _distinct(values)
        total = np.add.reduceat(1 + repeated[order].astype(np.int64), first)
        many = np.zeros(len(values), bool)
        many[order] = np.repeat(total > 1, np.diff(np.append(first, len(values))))
        many &= blocks
        numbers, found = [], []
        for row, end, n in zip(rows, np.cumsum(sizes).tolist(), sizes, strict=True):
            hits = values[end - n : end][many[end - n : end]]
            if len(hits):
                numbers.append(row[1])
                found.append(_pack_sorted(hits))
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers, pa.int64()), pa.array(found, pa.binary())], names=["batch", "hits"]
        )


def _second(words: np.ndarray, width: int) -> np.ndarray:
    """A second, independent hash of the windows."""
    return windows(mix(words ^ np.uint64(0xA0761D6478BD642F)), width)


class _Candidates:
    """Windows of a batch around its anchors: their positions and, ranked by hash, the distinct ones."""

    def __init__(self, words: np.ndarray, edges: np.ndarray, hits: list[bytes], width: int, block: int) -> None:
        self.positions = np.empty(0, np.int64)
        self.first = self.order = self.counts = self.positions
        self.low = self.high = np.empty(0, np.uint64)
        valid = inside(edges, width)
        if not hits or not valid.any():
            return
        known = np.sort(np.concatenate([_unpack_sorted(x) for x in hits]))
        starts = np.flatnonzero(_aligned(edges, block, block))
        values = windows(words, block)[starts] >> np.uint64(16)
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        starts = starts[known[at] == values]
        # a block that begins at a lies in the windows that begin at a - (width - block) to a
        step = np.zeros(len(words) + 1, np.int32)
        np.add.at(step, np.maximum(starts - (width - block), 0), 1)
        np.add.at(step, starts + 1, -1)
        near = (np.cumsum(step)[: len(valid)] > 0) & valid
        self.positions = np.flatnonzero(near)
        if not len(self.positions):
            return
        one, two = windows(words, width)[near], _second(words, width)[near]
        self.order = np.lexsort((two, one))
        one, two = one[self.order], two[self.order]
        new = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
        self.first = np.flatnonzero(new)
        self.counts = np.diff(np.append(self.first, len(one)))
        self.low, self.high = one[self.first] >> np.uint64(16), two[self.first] & _LOW


def _windows_of(joined: DataFrame, text_column: str, width: int, block: int, groups: int) -> DataFrame:
    """Per batch and group of hashes: the distinct candidate windows and which are repeated in the batch."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for number, data, hits in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if not hits:
                    continue
                found = _Candidates(*_words(_rows(data), text_column), hits, width, block)
                cut = _groups_of(found.low, groups)
                full = np.flatnonzero(np.diff(cut))
                spans = [slice(cut[g], cut[g + 1]) for g in full]
                rest = found.high
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(full, pa.int32()),
                        pa.array([number] * len(full), pa.int64()),
                        pa.array([_pack_sorted(found.low[s]) for s in spans], pa.binary()),
                        pa.array([np.packbits(found.counts[s] > 1).tobytes() for s in spans], pa.binary()),
                        pa.array([_six_bytes(rest[s]) for s in spans], pa.binary()),
                    ],
                    names=["grp", "batch", "hashes", "repeated", "more"],
                )

    return joined.select("batch", "rows", "hits").mapInArrow(
        lean(run), "grp int, batch long, hashes binary, repeated binary, more binary"
    )


def _six_bytes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


def _confirmed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and group, a bit for each of its candidate windows: it begins at another place as well."""
    for rows in _by_group(parts):
        lists = [_unpack_sorted(row[2]) for row in rows]
        sizes = [len(x) for x in lists]
        one, two = np.concatenate(lists), np.concatenate([_from_six(row[4]) for row in rows])
        repeated = np.concatenate([_bits(row[3], n) for row, n in zip(rows, sizes, strict=True)])
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        first = np.flatnonzero(np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]))))
        total = np.add.reduceat(1 + repeated[order].astype(np.int64), first)
        many = np.zeros(len(one), bool)
        many[order] = np.repeat(total > 1, np.diff(np.append(first, len(one))))
        ends = np.cumsum(sizes)
        bits = [np.packbits(many[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([row[1] for row in rows], pa.int64()),
                pa.array([row[0] for row in rows], pa.int32()),
                pa.array(bits, pa.binary()),
            ],
            names=["batch", "grp", "bits"],
        )


def _covered(found: _Candidates, marks: list[dict], n_words: int, width: int, groups: int) -> np.ndarray:
    """Marks the words that lie in a confirmed window."""
    step = np.zeros(n_words + 1, np.int32)
    if len(found.positions) and marks:
        cut = _groups_of(found.low, groups)
        many = np.zeros(len(found.low), bool)
        for mark in marks:
            start, end = cut[mark["grp"]], cut[mark["grp"] + 1]
            many[start:end] = _bits(mark["bits"], end - start)
        at = found.positions[found.order][np.repeat(many, found.counts)]
        np.add.at(step, at, 1)
        np.add.at(step, at + width, -1)
    return np.cumsum(step)[:n_words] > 0


def _spans(removed: np.ndarray) -> list[int]:
    """Starts and ends of the runs of marked words, in turn."""
    return np.flatnonzero(np.diff(np.concatenate(([False], removed, [False])))).tolist()


_ADDED = "n_words long, n_removed long, kept_text string, repeats array<long>"


def remove_repeats(docs: DataFrame, text_column: str = "text", width: int = WIDTH) -> DataFrame:
    """All columns of ``docs`` and n_words, n_removed, kept_text (kept words joined by one space), repeats.

    A word goes if a window of ``width`` words that covers it begins anywhere else too, in the same text or
    another; every occurrence goes, the first as well. repeats lists the maximal repeated passages as word
    positions: start, end, start, end ... (end exclusive). Texts that are null, empty or shorter than the width
    lose nothing; a null text has no words and kept_text "". Repeated rows are repeats of each other. Columns
    of ``docs`` that have an added name are replaced. ``width`` must be odd.
    """
    if width % 2 == 0:
        raise ValueError("width must be odd")
    block = (width + 1) // 2
    added = [x.split()[0] for x in _ADDED.split(", ")]
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c not in added])
    batches, n_words = _write_batches(docs, text_column)
    groups = max(1, -(-n_words // ENTRIES_PER_GROUP))

    probes = _probes(batches, text_column, block, groups).repartition("grp").sortWithinPartitions("grp")
    hits = stage(probes.mapInArrow(lean(_anchors), "batch long, hits binary"), "anchors")
    hits = hits.groupBy("batch").agg(F.collect_list("hits").alias("hits"))
    joined = batches.join(hits, "batch", "left")

    candidates = _windows_of(joined, text_column, width, block, groups)
    together = candidates.repartition("grp").sortWithinPartitions("grp")
    marks = stage(together.mapInArrow(lean(_confirmed), "batch long, grp int, bits binary"), "windows")
    marks = marks.groupBy("batch").agg(F.collect_list(F.struct("grp", "bits")).alias("marks"))
    answered = joined.join(marks, "batch", "left").select("rows", "hits", "marks")
    names = [*docs.columns, *added]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for data, found, given in zip(*(c.to_pylist() for c in part.columns), strict=True):
                rows = _rows(data)
                texts = as_bytes(rows.column(text_column).to_pylist())
                words, edges = word_hashes(texts)
                candidates = _Candidates(words, edges, found or [], width, block)
                removed = _covered(candidates, given or [], len(words), width, groups)
                counts, kept, spans = [], [], []
                for text, start, end in zip(texts, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    gone, parts_kept = removed[start:end], text.split()
                    if gone.any():
                        parts_kept = [parts_kept[i] for i in np.flatnonzero(~gone).tolist()]
                        spans.append(_spans(gone))
                    else:
                        spans.append([])
                    counts.append(end - start - len(parts_kept))
                    kept.append(b" ".join(parts_kept).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays(
                    [
                        *rows.combine_chunks().to_batches()[0].columns,
                        pa.array(np.diff(edges), pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(kept, pa.string()),
                        pa.array(spans, pa.list_(pa.int64())),
                    ],
                    names=names,
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return answered.mapInArrow(lean(run), f"{schema}, {_ADDED}")

