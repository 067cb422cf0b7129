"""Passages of benchmark items in documents, by a prefix-filtered set join of word shingles.

A window of an item is a set of shingles at known offsets. A document holds the window only if it holds each of
these shingles, so the rarest one (counted over all documents) is a necessary prefix and the only one joined.
An occurrence of it fixes where the window must start; what would start before the document or end after it
falls by position and length, and the words of what is left are compared one by one.

Only DataFrame functions are used. Texts are tokenized twice and never shuffled with their occurrences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runwarden.llm.tables import stage

WINDOW = 10
SHINGLE = 3  # words of a shingle; windows of fewer words are one shingle
HELD_SHINGLES = 2_000_000  # item shingles that are sent to all executors, 16 bytes each; beyond, both sides are shuffled

_NO_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of digits, a-z and characters beyond ASCII, after A-Z are lower-cased; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.regexp_extract_all(lowered, F.lit(_NO_WORD), F.lit(0))


def shingles(tokens: Column, width: int) -> Column:
    """Hash of the ``width`` words from each position on; none if there are fewer words.

    ``tokens`` must be a plain column: it is read once for every position.
    """
    last = F.size(tokens) - width
    return F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(width)]),
        ),
    )


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Columns item_id, tokens: every ``size`` consecutive words of an item, or all words of a shorter one."""
    items = benchmark.select("item_id", words(F.col("text")).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - (size - 1), F.lit(1)))
    return items.select("item_id", "all", F.explode(starts).alias("at")).select(
        "item_id", F.slice("all", F.col("at"), F.lit(size)).alias("tokens")
    )


def _width() -> Column:
    return F.least(F.size("tokens"), F.lit(SHINGLE))


def _parts(distinct: DataFrame, widths: list[int]) -> DataFrame:
    """Columns window, width, offset, shingle: all shingles of all windows."""
    made = F.lit(None).cast("array<bigint>")
    for width in widths:
        made = F.when(_width() == width, shingles(F.col("tokens"), width)).otherwise(made)
    return distinct.select("window", _width().alias("width"), F.posexplode(made).alias("offset", "shingle"))


def _text_key() -> Column:
    """Rows of one key are confirmed against their own words, so texts that share a key by chance do no harm."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _occurrences(docs: DataFrame, parts: DataFrame, widths: list[int]) -> DataFrame:
    """Columns key, at, width, shingle: where shingles of items stand in documents."""
    texts = docs.select(_text_key().alias("key"), words(F.col("text")).alias("tokens"))
    found = None
    for width in widths:
        rows = texts.select("key", F.posexplode(shingles(F.col("tokens"), width)).alias("at", "shingle"))
        rows = rows.withColumn("width", F.lit(width))
        found = rows if found is None else found.union(rows)
    wanted = parts.select("width", "shingle").distinct()
    if wanted.count() <= HELD_SHINGLES:
        wanted = F.broadcast(wanted)
    return found.join(wanted, ["width", "shingle"], "left_semi")


def _covered(hits: Column) -> Column:
    """Number of words inside any of the hits."""
    ordered = F.array_sort(F.transform(hits, lambda h: F.struct(h["start"], (h["start"] + F.size(h["tokens"])).alias("end"))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))

    def add(now: Column, h: Column) -> Column:
        new = F.greatest(F.lit(0), h["end"] - F.greatest(now["upto"], h["start"]))
        return F.struct((now["n"] + new).alias("n"), F.greatest(now["upto"], h["end"]).alias("upto"))

    return F.aggregate(ordered, zero, add, lambda x: x["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Columns doc_id, n_words, n_hit, item_ids (sorted as strings) for every row of ``docs``.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; other columns are ignored. Null and empty
    texts have no words; such items have no windows. Rows of equal doc_id are searched each on its own; items
    that share an id count as one, an item without id counts for hit words only. Without items nothing is hit.
    """
    spans = windows(benchmark, size).withColumn("window", F.sha2(F.array_join("tokens", " "), 256))
    spans = stage(spans, "windows")
    distinct = spans.groupBy("window").agg(F.any_value("tokens").alias("tokens"))
    widths = sorted(r[0] for r in distinct.select(_width().alias("width")).distinct().collect()) or [SHINGLE]
    parts = stage(_parts(distinct, widths), "window-shingles")
    seen = stage(_occurrences(docs, parts, widths), "occurrences")

    counts = seen.groupBy("width", "shingle").agg(F.count(F.lit(1)).alias("n"))
    # a shingle that no document holds is the rarest of all and leaves its windows without candidates
    rarity = parts.join(counts, ["width", "shingle"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    prefix = rarity.groupBy("window").agg(F.min(F.struct("n", "shingle", "offset", "width")).alias("rarest"))
    prefix = prefix.where("rarest.n > 0").select("window", "rarest.shingle", "rarest.offset", "rarest.width")
    start = F.col("at") - F.col("offset")
    candidates = seen.join(prefix, ["width", "shingle"]).where(start >= 0).select("key", start.alias("start"), "window")
    candidates = candidates.distinct().join(distinct, "window")
    per_text = candidates.groupBy("key").agg(F.collect_list(F.struct("start", "window", "tokens")).alias("candidates"))

    texts = docs.select("doc_id", _text_key().alias("key"), "text").join(stage(per_text, "candidates"), "key", "left")
    texts = texts.withColumn("tokens", words(F.col("text")))

    def same(c: Column) -> Column:
        length = F.size(c["tokens"])
        fits = c["start"] + length <= F.size("tokens")
        return fits & (F.slice(F.col("tokens"), c["start"] + 1, length) == c["tokens"])

    hits = F.when(F.col("candidates").isNotNull(), F.filter("candidates", same))
    told = texts.withColumn("hits", hits).select(
        "doc_id",
        F.when(F.size("hits") > 0, F.sha2("text", 256)).alias("digest"),
        F.size("tokens").cast("long").alias("n_words"),
        F.coalesce(_covered(F.col("hits")), F.lit(0)).cast("long").alias("n_hit"),
        F.array_distinct(F.transform("hits", lambda h: h["window"])).alias("windows"),
    )
    told = stage(told, "searched")

    # copies of a text hold the same items, so these are gathered once for each text
    texts_hit = told.where("n_hit > 0").groupBy("digest").agg(F.any_value("windows").alias("windows"))
    owners = spans.where("item_id is not null").select("window", F.col("item_id").cast("string").alias("item")).distinct()
    items = texts_hit.select("digest", F.explode("windows").alias("window")).join(owners, "window")
    items = items.groupBy("digest").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    # rows without a hit find nothing; their own id keeps them apart in the join
    spread = told.withColumn("digest", F.coalesce("digest", F.concat(F.lit("-"), F.xxhash64("doc_id", "n_words").cast("string"))))
    found = F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids")
    return spread.join(items, "digest", "left").select("doc_id", "n_words", "n_hit", found)


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
