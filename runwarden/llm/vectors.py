"""Near-duplicate vectors by random-hyperplane signs.

Equal vectors of a label are one class. Every class gets a sign code in each of several tables; classes that
share a code are compared by exact cosine in double precision, inside tasks of bounded size, and every linked
pair is counted in the first table in which its codes agree. Links become components by joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runwarden.llm.graph import components
from runwarden.llm.tables import stage

LEAST_COSINE = 0.98
# Two vectors at cosine 0.98 agree in one sign with chance 0.936; with these sizes a pair there shares no code
# with chance (1 - 0.936**20)**48 = 3e-7, and every closer pair with less.
BITS, TABLES = 20, 48
BLOCK = 1024  # classes of one bucket on one side of a comparison


@lru_cache(maxsize=8)
def _planes(width: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([width, bits, tables]).standard_normal((width, bits * tables))


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors as rows, shorter ones filled with zeros."""
    lengths = pc.list_value_length(column).to_numpy()
    flat = column.flatten().to_numpy().astype(np.float64)
    if (lengths == lengths[0]).all():
        return flat.reshape(len(lengths), -1)
    out = np.zeros((len(lengths), lengths.max()))
    out[np.arange(out.shape[1])[None] < lengths[:, None]] = flat
    return out


def _codes(vectors: DataFrame, bits: int, tables: int) -> DataFrame:
    """Columns id, label, copies, vector, codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            codes = np.empty((batch.num_rows, tables), np.int64)
            lengths = pc.list_value_length(batch.column("vector")).to_numpy()
            for width in np.unique(lengths):
                at = np.flatnonzero(lengths == width)
                matrix = _matrix(batch.column("vector").take(pa.array(at)))
                signs = (matrix @ _planes(int(width), bits, tables) >= 0).reshape(len(at), tables, bits)
                codes[at] = signs @ weights
            flat = pa.array(codes.astype(np.int32).ravel())
            ends = pa.array(np.arange(0, len(flat) + 1, tables, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(ends, flat)], names=[*batch.schema.names, "codes"]
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(run, f"{schema}, codes array<int>")


def _usable(vector, label):
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return vector.isNotNull() & label.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False))


def _compared(codes: DataFrame, least: float) -> DataFrame:
    """Per bucket and pair of blocks: columns id, links (rows linked in other classes), root (an id linked to it)."""
    buckets = codes.select("id", "label", F.posexplode("codes").alias("table", "code"))
    # Only codes that two classes share; counts combine before the shuffle.
    shared = (
        buckets.groupBy("label", "table", "code").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    )
    # A large bucket is dealt into blocks, and each pair of blocks is compared once.
    dealt = buckets.join(shared, ["label", "table", "code"]).withColumn(
        "blocks", F.ceil(F.col("size") / BLOCK).cast("int")
    )
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    sides = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "id", "label", "table", "code", "block",
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
    )
    rows = sides.join(codes.drop("label"), "id")

    keys = ["label", "table", "code", "low", "high"]
    together = rows.repartition(*keys).sortWithinPartitions(*keys)
    kind = codes.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, keys):
            found = _links(batch, least)
            if found is not None:
                yield found

    return together.mapInArrow(run, f"id {kind}, links long, root {kind}")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of equal keys together; a group has at most two blocks of rows."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for key in keys:
            values = batch.column(key).to_numpy(zero_copy_only=False)
            change[1:] |= values[1:] != values[:-1]
        starts = [0, *np.flatnonzero(change).tolist()]
        for start, end in zip(starts[:-1], starts[1:], strict=True):
            yield batch.slice(start, end - start)
        held = batch.slice(starts[-1])
    if held is not None and held.num_rows:
        yield held


def _links(group: pa.RecordBatch, least: float) -> pa.RecordBatch | None:
    """Linked rows and roots inside one pair of blocks."""
    ids, copies = group.column("id"), group.column("copies").to_numpy()
    table, low, high = (group.column(c)[0].as_py() for c in ("table", "low", "high"))
    vectors = group.column("vector")
    lengths = pc.list_value_length(vectors).to_numpy()
    matrix = _matrix(vectors)
    # scaled by the largest part first, so squares neither overflow nor vanish
    matrix /= np.abs(matrix).max(1, keepdims=True)
    matrix /= np.sqrt((matrix**2).sum(1, keepdims=True))
    blocks = group.column("block").to_numpy()
    left, right = np.flatnonzero(blocks == low), np.flatnonzero(blocks == high)
    links, root, codes = np.zeros(len(ids), np.int64), np.arange(len(ids)), None
    for start in range(0, len(left), 256):
        part = left[start : start + 256]
        close = matrix[part] @ matrix[right].T >= least
        close &= lengths[part][:, None] == lengths[right][None]
        if low == high:
            close &= part[:, None] < right[None]
        a, b = np.nonzero(close)
        if not len(a):
            continue
        if codes is None:
            codes = group.column("codes").flatten().to_numpy().reshape(len(ids), -1)
        a, b = part[a], right[b]
        first = (codes[a] == codes[b]).argmax(1) == table
        a, b = a[first], b[first]
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        for i, k in zip(a.tolist(), b.tolist(), strict=True):
            i, k = _top(root, i), _top(root, k)
            if i != k:
                root[max(i, k)] = min(i, k)
    linked = np.flatnonzero(links)
    if not len(linked):
        return None
    tops = np.array([_top(root, i) for i in linked.tolist()])
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(linked)), pa.array(links[linked]), ids.take(pa.array(tops))], ["id", "links", "root"]
    )


def _top(root: np.ndarray, i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def near_duplicates(
    embeddings: DataFrame, least: float = LEAST_COSINE, bits: int = BITS, tables: int = TABLES
) -> DataFrame:
    """Columns vec_id, n_links, component_id, kept: one row per row of ``embeddings`` (vec_id, embedding, label).

    Rows link when their labels are equal and the cosine of their vectors is at least ``least``. Vectors that are
    null, all zero or hold null or non-finite parts, and rows without label, link with nothing; vectors of
    different length don't link. Repeated rows link with each other. Rows
    without vec_id count with those of equal label and vector only.
    """
    rows = embeddings.select("vec_id", F.col("embedding").alias("vector"), "label")
    usable = _usable(F.col("vector"), F.col("label"))
    # -0.0 and 0.0 are equal numbers but print differently; adding 0.0 makes them one
    text = F.concat_ws(",", F.transform("vector", lambda x: (x + F.lit(0.0)).cast("string")))
    named = F.sha2(F.concat_ws("|", F.col("label").cast("string"), text), 256)
    keyed = rows.select("vec_id", "vector", "label", F.when(usable, named).alias("key"))
    classes = (
        keyed.where("key is not null")
        .groupBy("key")
        .agg(
            F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"),
            F.first("label").alias("label"), F.first("vector").alias("vector"),
        )
    )
    # a class of rows without vec_id has no id to be reported by, so it is left to itself
    codes = stage(_codes(classes.where("id is not null").drop("key"), bits, tables), "codes")
    compared = stage(_compared(codes, least), "vector-links")
    sums = compared.groupBy("id").agg(F.sum("links").alias("links"))
    linked = components(compared.select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = (
        classes.select("key", "id", "copies")
        .join(sums, "id", "left")
        .join(linked, "id", "left")
        .select(
            "key",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component_id", "id").alias("component_id"),
        )
    )
    return (
        keyed.select("vec_id", "key")
        .join(known, "key", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
