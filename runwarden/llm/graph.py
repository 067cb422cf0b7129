"""Connected components of a link table as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runwarden.llm.tables import stage


def _fingerprint(links: DataFrame) -> tuple:
    row = links.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable id of every linked id: columns ``id``, ``component_id``.

    ``links`` has the columns a, b (any order, repeats allowed). Rounds of pointing every id at the smallest
    id of its neighbourhood (large star) and every smaller neighbour at the smallest (small star); each round
    is a table in the shared folder, and the rounds end when the table stays the same. Minima combine before
    the shuffle and AQE splits an id with very many links.
    """
    links = (
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    now = stage(links, "links")
    before = _fingerprint(now)
    while before[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            now.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stage(small.union(lowest.select("a", F.col("m").alias("b"))).distinct(), "links")
        after = _fingerprint(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(
        now.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    )
