"""Document fingerprints: MinHash signatures over word shingles.

A signature is the least value of each of many universal hash permutations over a text's five-word shingles,
computed for whole batches in numpy. Bands of a signature, joined in Spark, find near-duplicates; the Jaccard
likeness of the full sets decides.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runwarden.llm import candidates, minhash
from runwarden.llm.graph import components
from runwarden.llm.hashing import as_bytes, shingles
from runwarden.llm.tables import lean, slices, stage

WIDTH = 5
PERMUTATIONS = 256
LEAST = (80, 100)
# A pair of likeness 0.8 shares no band of four values with chance (1 - 0.8**4)**32 = 5e-8. Bands are made of 16 bits of
# each value, so the values that are kept for the estimate are all that travels.
ROWS, BANDS = 4, 32
LEAST_ESTIMATE = 0.62  # five standard deviations of the estimate below 0.8; 0 confirms all pairs that share a band
_SEED = 5


def signatures(texts: list[str | None]) -> np.ndarray:
    """One row of 32-bit values per text; A-Z count as a-z, a text without words (or null) gets all ones."""
    hashes, first = shingles(as_bytes(texts, lower=True), WIDTH)
    return minhash.signatures(hashes, first, PERMUTATIONS, _SEED)


def as_string(signature: np.ndarray) -> str:
    return signature.astype("<u4").tobytes().hex()


def likeness(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Share of equal values: an unbiased estimate of the Jaccard likeness of the sets."""
    return (one == two).mean(-1)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns id, fingerprint (hex) of every row; nothing is shuffled, a null text counts as empty."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = [as_string(x) for x in signatures(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.string())], ["id", "fingerprint"])

    own = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return own.mapInArrow(run, f"id {kind}, fingerprint string")


def sketches(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The signature whose bands are joined: 16 low bits of ROWS * BANDS permutations, band after band."""
    return (minhash.signatures(hashes, first, ROWS * BANDS, _SEED) & np.uint32(0xFFFF)).astype("<u2")


def _bands(sketch: str) -> Column:
    """Keys of the bands of a packed signature."""
    size = 2 * ROWS
    return F.array(*[F.xxhash64(F.substring(sketch, k * size + 1, size), F.lit(k)) for k in range(BANDS)])


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_estimate: float = LEAST_ESTIMATE
) -> DataFrame:
    """Columns id, component_id: near-duplicate classes at Jaccard 0.8 over five-word shingles.

    Texts of equal sets are one class. Candidates share a band; their likeness is confirmed on full sets, the
    likelier ones by their signatures first, those estimated below ``least_estimate`` not at all (0: none).
    Texts without words are alone; rows that share an id count as linked; rows without id follow their set.
    """
    own = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = own.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                hashes, first = shingles(as_bytes(part.column(1).to_pylist(), lower=True), WIDTH)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([minhash.set_key(x) for x in minhash.sets(hashes, first)], pa.binary()),
                        pa.array([x.tobytes() for x in sketches(hashes, first)], pa.binary()),
                    ],
                    names=["id", "set_key", "sketch"],
                )

    signed = stage(own.mapInArrow(lean(run), f"id {kind}, set_key binary, sketch binary"), "signed")
    classes = stage(
        signed.where("set_key is not null")
        .groupBy("set_key")
        .agg(F.min("id").alias("id"), F.first("sketch").alias("sketch")),
        "classes",
    )
    by = candidates.Likeness(np.uint16, likeness, least_estimate)
    known = classes.where("id is not null").withColumn("bands", _bands("sketch"))
    linked = components(candidates.links(own, known, WIDTH, True, LEAST, by))
    of_class = classes.select("set_key", "id").join(linked, "id", "left")
    of_class = of_class.select("set_key", F.coalesce("component_id", "id").alias("component_id"))
    return (
        signed.select("id", "set_key")
        .join(of_class, "set_key", "left")
        .select("id", F.when(F.col("set_key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    )


def edited(text: str, following: str) -> str:
    """The text with its last third (rounded down) replaced by as many first characters of another."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


_COMPARED = (
    "doc_id {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, component_id {id}"
)


def compared_with_next(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", classes: DataFrame | None = None
) -> DataFrame:
    """Every text against its edited version and against the next document, by falling id; the last meets the first.

    With ``classes``, the result of ``near_duplicates``, rows also get the component_id of their id (the smallest
    if there are several, null without id); the classes travel to the texts, so the result needs no join.

    Ids are numbers. They are cut into blocks at approximate quantiles, and a block also gets the first document
    of the next one, so texts are shuffled once (compressed) and no task needs more than its block, read in
    order. Rows of equal id follow each other in a fixed order; null ids come last; a null text counts as empty.
    """
    own = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    blocks = 4 * int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / blocks for i in range(1, blocks)] + [1.0]
    found = own.agg(F.percentile_approx("id", shares, 100_000).alias("b"), F.max("id").alias("m")).first()
    # each bound is the first id of its block, and the highest begins the first
    bounds = sorted({*(found["b"] or ()), found["m"]} - {None}, reverse=True)
    last = max(0, len(bounds) - 1)
    rising = bounds[::-1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                ids, classed = part.column(0).to_pylist(), part.column(3).to_pylist()
                rows = []
                for i, text in enumerate(part.column(1).to_pylist()):
                    packed = None if text is None else zlib.compress(text.encode("utf-8", "surrogatepass"), 1)
                    # ids below all bounds, and null, belong to the last block
                    block = last
                    if ids[i] is not None:
                        block = min(last, len(bounds) - bisect_left(rising, ids[i]) - 1)
                    rows.append((block, 0, ids[i], packed, i))
                    if not classed[i] and (not bounds or ids[i] == bounds[block]):
                        rows.append((block - 1 if block else last, 1, ids[i], packed, i))
                source = pa.array([r[4] for r in rows], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int32()),
                        pa.array([r[1] for r in rows], pa.int32()),
                        pa.array([r[2] for r in rows], part.column(0).type),
                        pa.array([r[3] for r in rows], pa.binary()),
                        part.column(2).take(source),
                        part.column(3).take(source),
                    ],
                    names=["block", "late", "id", "packed", "component_id", "classed"],
                )

    rows = own.select("id", "text", F.lit(None).cast(kind).alias("component_id"), F.lit(False).alias("classed"))
    if classes is not None:
        least = classes.where("id is not null").groupBy("id").agg(F.min("component_id").alias("component_id"))
        rows = rows.union(least.select("id", F.lit(None).cast("string"), "component_id", F.lit(True)))
    schema = f"block int, late int, id {kind}, packed binary, component_id {kind}, classed boolean"
    placed = rows.mapInArrow(lean(place), schema).repartition("block")
    # the class of an id comes before its texts
    order = placed.sortWithinPartitions("block", "late", F.col("id").desc_nulls_last(), F.desc("classed"), "packed")
    compared = order.mapInArrow(lean(_compare), _COMPARED.format(id=kind))
    return compared if classes is not None else compared.drop("component_id")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = None
    run: list[tuple] = []  # documents of one block in order, the last of them still without its next
    held, block, closed = 0, None, False
    last_class = None, None
    for batch in batches:
        kind = batch.schema.field(2).type
        for at, late, doc, packed, component, classed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != block:
                run, held, block, closed = [], 0, at, False
            if classed:
                last_class = doc, component
                continue
            if closed:
                continue
            text = "" if packed is None else zlib.decompress(packed).decode("utf-8", "surrogatepass")
            run.append((doc, text, last_class[1] if doc == last_class[0] else None))
            held += len(text)
            # a block ends with the first document of the next block
            if late or held > 4_000_000:
                closed = bool(late)
                if len(run) > 1:
                    yield _rows(run, kind)
                run, held = run[-1:], len(text)


def _rows(run: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    texts = [text for _, text, _ in run]
    new = [edited(text, following) for text, following in zip(texts[:-1], texts[1:], strict=True)]
    own = signatures(texts)
    changed = signatures(new)
    digests = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in new]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([doc for doc, *_ in run[:-1]], kind),
            pa.array(list(map(len, texts[:-1])), pa.int64()),
            pa.array(digests, pa.string()),
            pa.array([as_string(x) for x in own[:-1]], pa.string()),
            pa.array([as_string(x) for x in changed], pa.string()),
            pa.array(likeness(own[:-1], changed), pa.float64()),
            pa.array(likeness(own[:-1], own[1:]), pa.float64()),
            pa.array([component for *_, component in run[:-1]], kind),
        ],
        names=[x.split()[0] for x in _COMPARED.split(", ")],
    )
