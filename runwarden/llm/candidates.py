"""From banded buckets to confirmed links, without all pairs of a bucket; shared by the two MinHash operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runwarden.llm import minhash
from runwarden.llm.graph import components
from runwarden.llm.tables import lean, stage

BLOCK = 8192  # texts of one bucket that one task compares; their sketches take a megabyte
FAMILY_BLOCK = 1024  # texts of one family on one side of a comparison; their full sets meet in a task


def _buckets(classes: DataFrame) -> DataFrame:
    """Columns key, size, id: buckets of two ids or more; of buckets with the same ids, one.

    Counts combine before the shuffle and rows find them by a join, so a bucket of very many ids is split.
    """
    rows = classes.select("id", F.explode("bands").alias("key"))
    counts = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("ids")
    )
    shared = counts.where("size > 1").groupBy("ids", "size").agg(F.min("key").alias("key"))
    return rows.join(shared, "key").select("key", "size", "id")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Rows that are equal in the first ``keys`` columns together; no group exceeds two blocks."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for column in batch.columns[:keys]:
            values = column.to_numpy(zero_copy_only=False)
            change[1:] |= values[1:] != values[:-1]
        starts = [0, *np.flatnonzero(change).tolist()]
        for start, end in zip(starts[:-1], starts[1:], strict=True):
            yield batch.slice(start, end - start)
        held = batch.slice(starts[-1])
    if held is not None and held.num_rows:
        yield held


@dataclass(frozen=True)
class Likeness:
    """How sketches (equal numbers of ``dtype``) are compared, and the least estimate worth confirming."""

    dtype: type
    estimate: Callable[[np.ndarray, np.ndarray], np.ndarray]
    least_estimate: float

    def matrix(self, column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), self.dtype).reshape(len(column), -1)


def _spanning(batches: Iterator[pa.RecordBatch], by: Likeness) -> Iterator[pa.RecordBatch]:
    """Per bucket, the pairs of a spanning forest of greatest estimates (columns a, b)."""
    for group in _groups(batches, 2):
        n = group.num_rows
        if n < 2:
            continue
        sketch = by.matrix(group.column(3))
        best, other = np.full(n, -np.inf), np.zeros(n, np.int64)
        outside = np.ones(n, bool)
        now, pairs = 0, []
        for _ in range(n - 1):
            outside[now] = False
            left = np.flatnonzero(outside)
            found = by.estimate(sketch[now], sketch[left])
            better = found > best[left]
            best[left[better]], other[left[better]] = found[better], now
            now = left[np.argmax(best[left])]
            if best[now] >= by.least_estimate:
                pairs.append((other[now], now))
        yield _as_pairs(group.column(2), pairs)


def _as_pairs(ids: pa.Array, pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    at = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(at[:, 0])), ids.take(pa.array(at[:, 1]))], ["a", "b"])


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _exact(batches: Iterator[pa.RecordBatch], by: Likeness, least: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Per pair of blocks of a family, confirmed pairs that hold its components together (columns a, b).

    Columns family, low, high, id, sketch, members, side. Likely pairs that are not joined yet are compared on
    their full sets, likeliest first.
    """
    up, down = least
    for group in _groups(batches, 3):
        low, high = group.column(1)[0].as_py(), group.column(2)[0].as_py()
        sketch, side = by.matrix(group.column(4)), group.column(6).to_numpy()
        sets = [minhash.unpacked(x) for x in group.column(5).to_pylist()]
        sizes = np.array([len(x) for x in sets])
        starts = np.concatenate(([0], np.cumsum(sizes)))
        flat = np.concatenate(sets)
        root = np.arange(len(sets))
        right = np.flatnonzero(side == high)
        pairs = []
        for i in np.flatnonzero(side == low).tolist():
            at = right[right > i] if low == high else right
            # sets of too different size can't be alike enough
            at = at[(root[at] != root[i]) & (down * np.minimum(sizes[at], sizes[i]) >= up * np.maximum(sizes[at], sizes[i]))]
            if not len(at):
                continue
            found = by.estimate(sketch[i], sketch[at])
            at, found = at[found >= by.least_estimate], found[found >= by.least_estimate]
            at = at[np.argsort(-found, kind="stable")]
            step = 4
            while len(at):
                part, at = at[:step], at[step:]
                step = 256
                inside = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in part.tolist()])
                place = np.minimum(np.searchsorted(sets[i], flat[inside]), sizes[i] - 1)
                edges = np.concatenate(([0], np.cumsum(sizes[part])[:-1]))
                both = np.add.reduceat((sets[i][place] == flat[inside]).astype(np.int64), edges)
                for k in part[down * both >= up * (sizes[part] + sizes[i] - both)].tolist():
                    if root[k] != root[i]:
                        root[root == root[k]] = root[i]
                        pairs.append((i, k))
                at = at[root[at] != root[i]]
        if pairs:
            yield _as_pairs(group.column(3), pairs)


def links(
    docs: DataFrame, classes: DataFrame, width: int, lower: bool, least: tuple[int, int], by: Likeness
) -> DataFrame:
    """Confirmed pairs (a, b) of class ids that hold every component together.

    ``docs`` has id and text, ``classes`` id, bands (array of keys) and sketch. In every bucket, a spanning
    forest of the likeliest pairs joins ids to families: a bucket of n ids gives n - 1 pairs at most, and all
    likely pairs lie inside one family. The full sets then travel to their family, or for a large family to
    each pair of its blocks, and are compared there; no pairs are listed but those found linked and needed.
    """
    kind = classes.schema["id"].dataType.simpleString()
    buckets = stage(_buckets(classes), "bucket-ids")
    sketch = classes.select("id", "sketch")

    small = buckets.where(F.col("size") <= BLOCK).select("key", F.lit(0).alias("block"), "id").join(sketch, "id")
    together = small.select("key", "block", "id", "sketch").repartition("key").sortWithinPartitions("key", "id")
    forest = together.mapInArrow(lean(lambda x: _spanning(x, by)), f"a {kind}, b {kind}")
    # a bucket too large for one task is one family
    large = buckets.where(F.col("size") > BLOCK)
    star = large.join(large.groupBy("key").agg(F.min("id").alias("first")), "key")
    family = components(_ordered(forest.union(star.select(F.col("first").alias("a"), F.col("id").alias("b")))))
    family = stage(family.select("id", F.col("component_id").alias("family")).distinct(), "families")

    members = minhash.full_sets(docs.join(family.select("id"), "id", "left_semi"), width, lower)
    sizes = family.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / FAMILY_BLOCK).cast("int").alias("n"))
    placed = (
        family.join(sizes, "family")
        .withColumn("side", F.pmod(F.xxhash64("id"), "n").cast("int"))
        .join(sketch, "id")
        .join(members, "id")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select(
            "family",
            F.least("side", "other").alias("low"),
            F.greatest("side", "other").alias("high"),
            "id",
            "sketch",
            "members",
            "side",
        )
    )
    keys = ("family", "low", "high")
    dealt = placed.repartition(*keys).sortWithinPartitions(*keys, "id")
    return stage(dealt.mapInArrow(lean(lambda x: _exact(x, by, least)), f"a {kind}, b {kind}"), "confirmed")
