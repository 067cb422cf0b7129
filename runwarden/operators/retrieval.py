"""Runbook chunks, hashed embeddings and vector search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from runwarden import fixed
from runwarden.functions import text
from runwarden.operators.keyed import ranked_top

# Rows on either side of one comparison task. Each block of queries gets a copy of the corpus, whose vectors are large,
# so it holds many queries, of which a task scores so many at a time.
CORPUS_BLOCK = 8192
QUERY_BLOCK = 32768
QUERIES_AT_ONCE = 2048


def chunk_documents(docs: DataFrame, max_chars: int = fixed.CHUNK_CHARS, cut: bool = False) -> DataFrame:
    """Cut Markdown ``(runbook_path, text)`` before each second-level heading.

    A section longer than ``max_chars`` becomes consecutive chunks, so all of it can be found; with ``cut``
    only its beginning is kept, ending in an ellipsis.
    The failure class is the file's name where that names one, unless ``docs`` brings its own
    ``failure_type`` column.
    """
    stem = F.regexp_extract("runbook_path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    named = F.when(stem.isin(*fixed.FAILURE_CLASSES), stem)
    parts = docs.select(
        "runbook_path",
        stem.alias("stem"),
        (F.col("failure_type") if "failure_type" in docs.columns else named).alias("failure_type"),
        F.posexplode(F.split(text.strip(F.col("text")), r"\n(?=## )")).alias("i", "part"),
    ).withColumn("body", text.strip(F.col("part")))
    parts = parts.filter(F.col("body") != "")
    if cut:
        short = F.concat(F.substring("body", 1, max_chars - 3), F.lit("..."))
        pieces = F.array(F.when(F.length("body") > max_chars, short).otherwise(F.col("body")))
    else:
        pieces = F.transform(
            F.sequence(F.lit(0), F.floor((F.length("body") - 1) / max_chars).cast("int")),
            lambda p: F.substr("body", p * max_chars + 1, F.lit(max_chars)),
        )
    parts = parts.select("stem", "runbook_path", "failure_type", "i", F.posexplode(pieces).alias("p", "piece"))
    return parts.select(
        F.concat_ws("-", "stem", F.col("i").cast("string"), F.when(F.col("p") > 0, F.col("p").cast("string"))).alias(
            "chunk_id"
        ),
        "runbook_path",
        "failure_type",
        F.initcap(F.replace("stem", F.lit("_"), F.lit(" "))).alias("title"),
        F.col("piece").alias("chunk_text"),
    )


def hash_embed(docs: DataFrame, key: str, body: str, dim: int = fixed.EMBED_DIM) -> DataFrame:
    """Sparse unit vectors as rows ``(key, slot, weight)``."""
    return docs.select(key, F.explode(text.hashed_weights(F.col(body), dim)).alias("slot", "weight"))


def embed_chunks(chunks: DataFrame, embedded_at: Column) -> DataFrame:
    return chunks.select(
        "*",
        text.dense(text.hashed_weights(F.col("chunk_text"))).alias("embedding"),
        F.lit("hash").alias("embedding_backend"),
        embedded_at.alias("embedded_at"),
    )


def text_queries(queries: DataFrame, body: str = "query_text") -> DataFrame:
    """Add the hashed query vector as ``terms``, an array of (slot, weight)."""
    return queries.withColumn("terms", F.map_entries(text.hashed_weights(F.col(body))))


def vector_queries(queries: DataFrame, vector: str) -> DataFrame:
    """Add a dense query vector as unit-length ``terms``."""

    def terms(v: Column) -> Column:
        return text.bind(
            text.norm(v),
            lambda size: F.transform(
                v,
                lambda x, i: F.struct(i.alias("key"), F.coalesce(F.try_divide(x, size), F.lit(0.0)).alias("value")),
            ),
        )

    return queries.withColumn("terms", text.bind(F.col(vector), terms))


def nearest(
    corpus: DataFrame,
    queries: DataFrame,
    key: str,
    vector: str,
    k: int,
    carry: Sequence[str] = (),
    by_class: bool = False,
) -> DataFrame:
    """The ``k`` most similar corpus rows of every query: ``(query_id, key, *carry, score, rank)``.

    ``queries`` has ``query_id``, ``terms`` and, for ``by_class``, ``failure_type``: then only rows of
    that class or of none compete, and rows of that class go first. Both sides are dealt into blocks whose
    number follows from their row counts, inside the plan; every pair of blocks is one matrix product that
    hands on its ``k`` best rows per query, from which the final ``k`` are ranked. Vectors that are null or
    of another length than the query count as unlike everything (score 0).
    """
    rows = corpus.select(
        key,
        *carry,
        (F.col("failure_type") if by_class else F.lit(None).cast("string")).alias("_class"),
        F.col(vector).alias("_v"),
    )
    wanted = queries.select(
        "query_id", "terms", (F.col("failure_type") if by_class else F.lit(None).cast("string")).alias("_class")
    )
    # one row with two numbers
    blocks = (
        corpus.agg(F.ceil(F.count(F.lit(1)) / CORPUS_BLOCK).cast("int").alias("_rows"))
        .crossJoin(queries.agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("_queries")))
        .withColumns({"_rows": F.greatest("_rows", F.lit(1)), "_queries": F.greatest("_queries", F.lit(1))})
    )

    def dealt(df: DataFrame, by: str, own: str, other: str) -> DataFrame:
        return (
            df.crossJoin(F.broadcast(blocks))
            .withColumn(f"{own}_at", F.pmod(F.xxhash64(by), F.col(own)).cast("int"))
            .withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            .drop("_rows", "_queries")
        )

    pairs = ["_rows_at", "_queries_at"]
    out = T.StructType(
        [
            queries.schema["query_id"],
            *[corpus.schema[c] for c in (key, *carry)],
            T.StructField("exact", T.BooleanType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    id_type = to_arrow_type(out["query_id"].dataType)

    def best(mine, asked):
        return _block_best(mine, asked, key, carry, k, id_type)

    found = (
        dealt(rows, key, "_rows", "_queries")
        .groupBy(*pairs)
        .cogroup(dealt(wanted, "query_id", "_queries", "_rows").groupBy(*pairs))
        .applyInArrow(best, out)
    )
    order = [F.col("exact").desc(), F.col("score").desc(), F.col(key)]
    return ranked_top(found, ["query_id"], order, k).drop("exact")


def _block_best(mine, asked, key: str, carry: Sequence[str], k: int, id_type):
    """The best ``k`` rows of one block for each query of another."""
    shown, n = [key, *carry], mine.num_rows
    names = ["query_id", *shown, "exact", "score"]
    vectors = mine.column("_v").combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy() if n else np.empty(0, np.int64)
    own = np.array(mine.column("_class").to_pylist(), dtype=object)
    # place in key order, to settle ties
    by_key = np.empty(n, np.int64)
    by_key[pc.sort_indices(mine.column(key)).to_numpy()] = np.arange(n)
    queries = asked.to_pylist()
    width = int(lengths.max()) if n else 0
    matrix = np.zeros((n, max(width, 0)))
    matrix[np.arange(matrix.shape[1])[None] < lengths[:, None]] = np.nan_to_num(
        pc.fill_null(vectors.drop_null().flatten(), 0.0).to_numpy(zero_copy_only=False) if n else np.empty(0)
    )
    size = np.linalg.norm(matrix, axis=1)
    size[size == 0] = 1.0
    matrix /= size[:, None]
    competing = {}  # of each class asked for: which rows are of it, which may be found
    for want in {query["_class"] for query in queries}:
        same = own == want if want is not None else np.zeros(n, dtype=bool)
        able = np.flatnonzero(same | (own == None)) if want is not None else np.arange(n)  # noqa: E711
        competing[want] = same, able
    # short texts fill few of the hashed slots, so many queries have equal vectors, which are scored once
    ranks = {}
    ranked_as = [
        ranks.setdefault((q["_class"], *[(p["key"], p["value"]) for p in q["terms"] or ()]), len(ranks)) for q in queries
    ]
    unlike = [queries[j] for j in np.unique(ranked_as, return_index=True)[1]]
    picked, exact, reached = [], [], []
    for first in range(0, len(unlike), QUERIES_AT_ONCE):
        some = unlike[first : first + QUERIES_AT_ONCE]
        terms = np.zeros((len(some), matrix.shape[1]))
        for j, query in enumerate(some):
            for pair in query["terms"] or ():
                if pair["key"] < terms.shape[1]:
                    terms[j, pair["key"]] = pair["value"]
        # rounded, so that equal scores tie whatever the order their terms were summed in
        scores = np.round(terms @ matrix.T, 9) + 0.0
        scores[:, lengths < width] = 0.0
        for j, query in enumerate(some):
            same, able = competing[query["_class"]]
            if len(able) > k:
                # exact classes above all others, then by score; ties at the cut go by key
                level = scores[j, able] + 4.0 * same[able]
                able = able[level >= np.partition(level, len(able) - k)[len(able) - k]]
            able = able[np.lexsort((by_key[able], -scores[j, able], ~same[able]))][:k]
            picked.append(able)
            exact.append(same[able])
            reached.append(scores[j, able])

    def of_all(found, kind):
        return np.concatenate([found[r] for r in ranked_as]) if ranked_as else np.empty(0, kind)

    at = pa.array(of_all(picked, np.int64))
    return pa.Table.from_arrays(
        [
            pa.array([q["query_id"] for q, r in zip(queries, ranked_as) for _ in picked[r]], id_type),
            *[mine.column(c).take(at) for c in shown],
            pa.array(of_all(exact, bool), pa.bool_()),
            pa.array(of_all(reached, np.float64), pa.float64()),
        ],
        names=names,
    )


def runbook_search(corpus: DataFrame, queries: DataFrame, top_k: int = 3) -> DataFrame:
    """Best runbook chunks for ``(query_id, query_text, failure_type)`` rows."""
    return nearest(
        corpus,
        text_queries(queries),
        "chunk_id",
        "embedding",
        top_k,
        carry=("runbook_path", "title"),
        by_class=True,
    )


# --- fixed values: review words ----------------------------------------------------
POSITIVE_WORDS = ("good", "great", "love", "excellent", "fast", "perfect", "happy")
NEGATIVE_WORDS = ("bad", "broken", "slow", "poor", "late", "refund", "disappointed")
TOPIC_WORDS = {
    "shipping": ("shipping", "delivery", "late", "package"),
    "quality": ("quality", "broken", "material", "defect"),
    "price": ("price", "cheap", "expensive", "refund"),
}


def reviews_enriched(
    reviews: DataFrame,
    positive: Sequence[str] = POSITIVE_WORDS,
    negative: Sequence[str] = NEGATIVE_WORDS,
    topics: Mapping[str, Sequence[str]] = TOPIC_WORDS,
) -> DataFrame:
    """Sentiment by word counts and the first matching topic of every review."""

    def hits(words: Sequence[str]) -> Column:
        return F.size(F.filter("_t", lambda t: t.isin(*words)))

    topic = None
    for name, words in topics.items():
        found = hits(words) > 0
        topic = F.when(found, name) if topic is None else topic.when(found, name)
    return (
        reviews.withColumn("_t", text.tokens(F.col("review_text")))
        .select("*", hits(positive).alias("positive_hits"), hits(negative).alias("negative_hits"), topic.alias("topic"))
        .withColumn("balance", F.col("positive_hits") - F.col("negative_hits"))
        .select(
            "review_id",
            "rating",
            "positive_hits",
            "negative_hits",
            F.when(F.col("balance") > 0, "positive")
            .when(F.col("balance") < 0, "negative")
            .otherwise("neutral")
            .alias("sentiment"),
            F.coalesce("topic", F.lit("other")).alias("topic"),
        )
    )
