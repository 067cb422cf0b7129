"""Small Spark helpers of the operators: stages in the shared folder and slices of Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runwarden.session import fresh_dir


def stage(df: DataFrame, label: str) -> DataFrame:
    """The rows written as a table in the shared folder and read back, which cuts the lineage."""
    spark = df.sparkSession
    path = fresh_dir(spark, f"llm-{label}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose strings in ``column`` together stay near ``most_bytes`` (one row at least)."""
    at = held = 0
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for i, size in enumerate(lengths):
        if i > at and held + size > most_bytes:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += size
    if batch.num_rows > at:
        yield batch.slice(at)


Batches = Iterator[pa.RecordBatch]


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, after which memory that the task has freed goes back to the system.

    Workers outlive their tasks and go on to those of other stages; what the allocators keep for later would add up
    over the stages of a chain.
    """

    def task(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return task


def carried(docs: DataFrame, needed: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """The needed columns, and all others inside one struct, so that no name can clash with an operator's."""
    others = [c for c in docs.columns if c not in needed]
    held = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("int")
    return docs.select(*needed, held.alias("_carried"))


def restored(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` in their order, from a result over ``carried`` rows."""
    return df.select(
        *[
            F.col(c) if c in ("doc_id", "text") else F.col("_carried").getField(c).alias(c)
            for c in docs.columns
        ]
    )


def adding(docs: DataFrame, column: str, compute: Callable[[list], list[pa.Array]], added: str) -> DataFrame:
    """All columns of ``docs`` and those of the schema ``added``, computed from one string column; nothing is shuffled.

    Columns of ``docs`` with an added name are replaced.
    """
    names = [x.split()[0] for x in added.split(", ")]
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c not in names])
    at = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                made = compute(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(lean(run), f"{schema}, {added}")
