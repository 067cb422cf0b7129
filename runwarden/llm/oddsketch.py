"""Near-duplicate texts by MinHash bands, odd sketches and exact confirmation.

The MinHash samples of a text are folded into a parity bitmap (odd sketch): each sample flips one bit, so
equal samples cancel and the population count of the XOR of two sketches tells how many differ, precisely
where most agree. Texts with equal bands are candidates. Inside a bucket the estimates pick the pairs that
can join what is not yet joined, and only such pairs are confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runwarden.llm import candidates, minhash
from runwarden.llm.graph import components
from runwarden.llm.hashing import as_bytes, mix, shingles
from runwarden.llm.tables import lean, slices, stage

LEAST = (80, 100)
# A pair of likeness 0.8 agrees in a band with chance 0.8**5; it shares none with chance (1 - 0.328)**48 = 5e-9.
ROWS, BANDS = 5, 48
SKETCH_BITS = 1024
# Five standard deviations of the estimate below 0.8; likelier pairs are confirmed, others are not.
LEAST_ESTIMATE = 0.66
_SEED = 20


def sketches(signature: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmaps of the samples, as 64-bit words: a sample is its permutation and its value."""
    n, k = signature.shape
    sample = mix(signature.astype(np.uint64) ^ (np.arange(k, dtype=np.uint64) << np.uint64(32)))
    out = np.zeros((n, bits // 64), np.uint64)
    place = (sample % np.uint64(bits)).astype(np.int64)
    np.bitwise_xor.at(
        out, (np.arange(n)[:, None], place >> 6), np.uint64(1) << (place & 63).astype(np.uint64)
    )
    return out


def estimate(one: np.ndarray, many: np.ndarray, samples: int) -> np.ndarray:
    """Likeness of one sketch to many: n bits, k samples, d differing bits: 1 + n ln(1 - 2 d / n) / (4 k)."""
    bits = 64 * one.shape[-1]
    differ = np.bitwise_count(one ^ many).sum(-1, dtype=np.int64)
    share = np.minimum(2.0 * differ / bits, 1 - 1e-9)
    return 1 + bits * np.log1p(-share) / (4 * samples)


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """Columns id, n_shingles, set_key, bands, sketch."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                hashes, first = shingles(as_bytes(part.column(1).to_pylist(), lower=True), width)
                members = minhash.sets(hashes, first)
                signature = minhash.signatures(hashes, first, ROWS * BANDS, _SEED)
                band = np.zeros((len(members), BANDS), np.uint64)
                for k in range(ROWS):
                    band = mix(band ^ signature[:, k::ROWS].astype(np.uint64))
                band = mix(band + np.arange(BANDS, dtype=np.uint64))
                ends = pa.array(np.arange(0, band.size + 1, BANDS, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(x) for x in members], pa.int64()),
                        pa.array([minhash.set_key(x) for x in members], pa.binary()),
                        pa.ListArray.from_arrays(ends, pa.array(band.view(np.int64).ravel())),
                        pa.array([x.tobytes() for x in sketches(signature)], pa.binary()),
                    ],
                    names=["id", "n_shingles", "set_key", "bands", "sketch"],
                )

    return docs.mapInArrow(
        lean(run), f"id {kind}, n_shingles long, set_key binary, bands array<long>, sketch binary"
    )


def _likeness(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return estimate(one, many, ROWS * BANDS)


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5
) -> DataFrame:
    """Columns id, n_shingles, component_id, kept: one row per row of ``docs``.

    A-Z are lower-cased; a text's set are its distinct shingles of ``width`` words, or its whole sequence if it
    has fewer. Texts link when 100 * common >= 80 * united shingles; component_id is the smallest id reachable.
    A null or empty text links with nothing. Texts of equal sets are one class, so copies cost one row. Rows
    that share an id but not a text count as linked; rows without id belong to the class of their set only, and
    have component_id null where no row of it has an id. All rows of the smallest id are kept.
    """
    own = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    signed = stage(_signed(own, width), "signed")
    classes = (
        signed.where("set_key is not null")
        .groupBy("set_key")
        .agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    )
    classes = stage(classes, "classes")
    known = classes.where("id is not null")
    by = candidates.Likeness(np.uint64, _likeness, LEAST_ESTIMATE)
    linked = components(candidates.links(own, known, width, True, LEAST, by))
    of_class = classes.select("set_key", "id").join(linked, "id", "left").select(
        "set_key", F.coalesce("component_id", "id").alias("component_id")
    )
    return (
        signed.select("id", "n_shingles", "set_key")
        .join(of_class, "set_key", "left")
        .select(
            "id",
            "n_shingles",
            F.when(F.col("set_key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
    )
