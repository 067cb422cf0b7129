"""Toxicity grades by cumulative-link ordinal regression.

Grades run from 0 (not toxic) to 3. One weight per feature is shared by all thresholds:
P(grade <= k) = sigmoid(threshold_k - weights . features) with rising thresholds. Features are the presence of
a word and of its first four to six characters, hashed. The labels tell toxic from clean only; the grades of
toxic training texts are the thirds of their number of features that toxic texts have more often.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runwarden.llm.bpe import Cache
from runwarden.llm.tables import adding, lean, slices, stage

TRAINING_ROWS = 12_000  # labelled texts that the model is fitted on, at most
_SPACE_BITS = 22
_LEAST_TEXTS = 4
_GRADES = 4
_AROUND = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»“”‘’…"


def _hashed(kind: str, string: str) -> int:
    return zlib.crc32((kind + string).encode("utf-8", "surrogatepass")) & ((1 << _SPACE_BITS) - 1)


def word_features(word: str) -> tuple[int, ...]:
    """Hashed features of one white-space separated word."""
    word = word.strip(_AROUND)
    if not word:
        return ()
    return (_hashed("w", word), *(_hashed("p", word[:n]) for n in (4, 5, 6) if len(word) >= n))


@dataclass(frozen=True)
class Model:
    """Weights by feature and the rising thresholds; without training texts of both kinds it grades all as 0."""

    weights: dict[int, float]
    thresholds: tuple[float, ...]

    def at_least(self, score: float) -> list[float]:
        """P(grade >= k) for k = 1, 2, 3."""
        return [1.0 / (1.0 + float(np.exp(np.clip(t - score, -700, 700)))) for t in self.thresholds]


def _rise(raw: np.ndarray) -> np.ndarray:
    return np.concatenate((raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit_ordinal(
    rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, n_features: int, l2: float = 2e-5, rounds: int = 400
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of least penalised loss, by gradient steps of adapted length over all rows."""
    n = len(grades)
    weights, raw = np.zeros(n_features), np.zeros(_GRADES - 1)
    raw[0] = 2.0
    moments = [np.zeros(n_features + len(raw)) for _ in range(2)]
    for step in range(1, rounds + 1):
        score = np.bincount(rows, weights[columns], minlength=n)
        limits = np.concatenate(([-np.inf], _rise(raw), [np.inf]))
        upper, lower = _sigmoid(limits[grades + 1] - score), _sigmoid(limits[grades] - score)
        upper[grades == _GRADES - 1], lower[grades == 0] = 1.0, 0.0
        chance = np.maximum(upper - lower, 1e-12)
        d_upper, d_lower = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        by_row = (d_upper - d_lower) / n
        gradient = np.bincount(columns, by_row[rows], minlength=n_features) + l2 * weights
        by_limit = np.bincount(grades, -d_upper / n, minlength=_GRADES)[:-1]
        by_limit += np.bincount(grades, d_lower / n, minlength=_GRADES)[1:]
        by_raw = np.concatenate(([by_limit.sum()], np.exp(raw[1:]) * np.cumsum(by_limit[::-1])[::-1][1:]))
        whole = np.concatenate((gradient, by_raw))
        moments[0] = 0.9 * moments[0] + 0.1 * whole
        moments[1] = 0.99 * moments[1] + 0.01 * whole**2
        move = 0.05 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-9)
        weights -= move[:n_features]
        raw -= move[n_features:]
    return weights, _rise(raw)


def _information(with_toxic: np.ndarray, count: np.ndarray, share: float) -> np.ndarray:
    """Twice the log likelihood ratio of a feature's own toxic share against the share of all texts."""
    clean = count - with_toxic
    first = with_toxic * np.log(np.maximum(with_toxic, 1) / (count * share))
    return 2 * (first + clean * np.log(np.maximum(clean, 1) / (count * (1 - share))))


def telling(features: np.ndarray, count: np.ndarray, with_toxic: np.ndarray, n_toxic: int, n_texts: int) -> np.ndarray:
    """The features whose likelihood ratio is above what chance reaches about once among so many.

    Of the ``count`` texts that have a feature, ``with_toxic`` are toxic.
    """
    ratio = _information(with_toxic, count, n_toxic / n_texts)
    return features[ratio >= 2 * np.log(max(2, len(features)))]


def fit(texts: list[np.ndarray], toxic: np.ndarray) -> Model:
    """The model of the distinct telling features of each text and labels 0/1."""
    if not len(texts) or toxic.min() == toxic.max():
        return Model({}, (30.0, 31.0, 32.0))
    rows = np.repeat(np.arange(len(texts)), list(map(len, texts)))
    features, columns = np.unique(np.concatenate(texts), return_inverse=True)
    count = np.bincount(columns, minlength=len(features))
    with_toxic = np.bincount(columns, toxic[rows], minlength=len(features))
    n_toxic, n_clean = toxic.sum(), len(toxic) - toxic.sum()
    odds = np.log((with_toxic + 0.5) / (n_toxic + 1)) - np.log((count - with_toxic + 0.5) / (n_clean + 1))
    markers = np.bincount(rows, odds[columns] > 2.0, minlength=len(texts))
    cuts = np.quantile(markers[toxic == 1], [1 / 3, 2 / 3])
    grades = np.where(toxic == 1, 1 + np.searchsorted(cuts, markers, side="left"), 0).astype(np.int64)
    weights, thresholds = fit_ordinal(rows, columns, grades, len(features))
    return Model(dict(zip(features.tolist(), weights.tolist(), strict=True)), tuple(thresholds.tolist()))


def train(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", most: int = TRAINING_ROWS
) -> Model:
    """Fits on at most ``most`` labelled texts, those with the smallest hash of the id; null labels don't count.

    The chosen labels are few by that bound and therefore broadcast. Spark counts the features; the driver gets one
    row for each feature of the hash space (2**22 at most) that enough texts have, then the telling ones of each text.
    """
    chosen_labels = (
        labels.where("toxic is not null")
        .groupBy(F.col(id_column).alias("id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(most)
    )
    found = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).join(
        F.broadcast(chosen_labels), "id"
    )
    # rows that share an id are one text, that with the smallest hash
    found = found.groupBy("id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text"))
    featured = stage(_featured(found), "labelled")
    counts = (
        featured.select(F.explode("features").alias("feature"), "toxic")
        .groupBy("feature")
        .agg(F.count(F.lit(1)).alias("count"), F.sum("toxic").alias("with_toxic"))
        .where(F.col("count") >= _LEAST_TEXTS)
        .toArrow()
        .sort_by("feature")
    )
    n = featured.agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("texts")).first()
    chosen = np.empty(0, np.int32)
    if n["texts"] and 0 < n["toxic"] < n["texts"]:
        chosen = telling(*(counts[c].to_numpy() for c in ("feature", "count", "with_toxic")), n["toxic"], n["texts"])
    got = _only(featured, chosen).toArrow()
    texts = [x.values.to_numpy() for x in got.column("features")]
    # repeated runs see the rows in any order; the sums of the fit must not depend on it
    toxic = got["toxic"].to_numpy()
    order = sorted(range(len(texts)), key=lambda i: (zlib.crc32(texts[i]), len(texts[i]), toxic[i]))
    return fit([texts[i] for i in order], toxic[order].astype(np.int64))


def _featured(texts: DataFrame) -> DataFrame:
    """Columns features (distinct, rising), toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Cache(word_features)
        for batch in batches:
            for part in slices(batch, 1):
                known.turn()
                features = []
                for text in part.column(1).to_pylist():
                    words = set((text or "").lower().split())
                    features.append(sorted({f for word in words for f in known[word]}))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(features, pa.list_(pa.int32())), part.column(2)], names=["features", "toxic"]
                )

    return texts.select("id", "text", "toxic").mapInArrow(lean(run), "features array<int>, toxic int")


def _only(featured: DataFrame, chosen: np.ndarray) -> DataFrame:
    """The rows with those of their features that are chosen; both rise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.intersect1d(x.values.to_numpy(), chosen, assume_unique=True) for x in batch.column(0)]
            own = pa.array([x.astype(np.int32) for x in lists], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([own, batch.column(1)], names=["features", "toxic"])

    return featured.mapInArrow(lean(run), "features array<int>, toxic int")


_GRADED = "severity double, p_toxic double, grade int, toxic boolean"


def grade(docs: DataFrame, model: Model, text_column: str = "text", least: float = 0.5) -> DataFrame:
    """All columns of ``docs`` and severity (expected grade, 0 to 3), p_toxic, grade (likeliest), toxic.

    toxic is p_toxic >= ``least``. One row per document, nothing shuffled; a null or empty text has no features
    and gets the clean grade. Columns of ``docs`` that have an added name are replaced.
    """
    weights = model.weights
    known = Cache(_Features(frozenset(weights)))

    def compute(texts: list[str | None]) -> list[pa.Array]:
        known.turn()
        rows = []
        for text in texts:
            features = {f for word in set((text or "").lower().split()) for f in known[word]}
            steps = model.at_least(sum(weights[f] for f in sorted(features)))
            chances = np.diff([-1.0, *(-p for p in steps), 0.0])
            rows.append((sum(steps), steps[0], int(np.argmax(chances)), steps[0] >= least))
        kinds = (pa.float64(), pa.float64(), pa.int32(), pa.bool_())
        return [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]

    return adding(docs.withColumn(text_column, F.col(text_column).cast("string")), text_column, compute, _GRADED)


class _Features:
    """The features of a word that a model has weights for."""

    def __init__(self, kept: frozenset[int]) -> None:
        self.kept = kept

    def __call__(self, word: str) -> tuple[int, ...]:
        return tuple(f for f in word_features(word) if f in self.kept)
