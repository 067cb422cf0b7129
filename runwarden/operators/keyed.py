"""Keyed building blocks that hold when one key owns a large share of all rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _orderable(df: DataFrame) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if not isinstance(f.dataType, (T.MapType, T.VariantType))
    ]


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy row work as many tasks as there are cores when a scan has fewer.

    A scan of large data has more partitions than that and is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """First ``k`` rows of each key in ``order`` (which should be total).

    Written as ``row_number() <= k`` because Spark then limits each group before the shuffle as well
    (WindowGroupLimit), so a hot key sends at most ``k`` rows per map task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).filter(F.col("_rn") <= k).drop("_rn")


def ranked_top(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank_name: str = "rank"
) -> DataFrame:
    """Like :func:`latest_per_key` but keeps the rank as a column."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank_name, rank).filter(F.col(rank_name) <= k)


def flag_latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], flag: str = "is_latest") -> DataFrame:
    """All rows, with exactly one row per key flagged, also among identical copies.

    Every row must stay, so nothing can be dropped before the shuffle. Ranking happens in two steps:
    inside (key, input partition), whose size one input split bounds however hot the key is, and then
    among the heads of those groups, of which a key has at most one per input split.
    """
    salt, first = "_part", "_first"
    total = [*order, *[F.col(c) for c in _orderable(df)]]
    local = df.withColumn(salt, F.spark_partition_id())
    # lag() instead of row_number() = 1: both branches below then share one exchange
    local = local.withColumn(
        first, F.lag(F.lit(1)).over(Window.partitionBy(*keys, salt).orderBy(*total)).isNull()
    )
    heads = local.filter(F.col(first)).withColumn(
        flag, F.lag(F.lit(1)).over(Window.partitionBy(*keys).orderBy(*total, F.col(salt))).isNull()
    )
    rest = local.filter(~F.col(first)).withColumn(flag, F.lit(False))
    return heads.unionByName(rest).drop(salt, first)


def order_number(*parts: tuple[Column, int]) -> Column:
    """One decimal that sorts like ``parts``, whole numbers from 0, each with its greatest number of digits.

    Minima of a decimal combine in a hash aggregation, those of a struct or text only by sorting.
    """
    return F.concat(*[F.lpad(value.cast("string"), digits, "0") for value, digits in parts]).cast("decimal(38,0)")


def micros(at: Column) -> Column:
    """A timestamp from 1970 on as a number of at most 17 digits."""
    return F.unix_micros(at)


def first_rows(
    df: DataFrame, keys: Sequence[str], number: Column, columns: Sequence[str], tie: Sequence[str] = (),
    also: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``keys`` and ``columns`` of the row of each key with the least ``number``, then the least ``tie``.

    The least number is found by a hash aggregation that combines before the shuffle, and the row is fetched by a
    join: only rows of that number are ordered by text. The join is by ``keys`` alone, so the aggregation before it and
    the ranking after it lie where the join puts the rows. ``also`` names further aggregates over all rows of a key.
    """
    also = dict(also or {})
    held = [c for c in dict.fromkeys([*tie, *columns]) if c not in keys]
    least = df.select("*", number.alias("_number")).groupBy(*keys).agg(
        F.min("_number").alias("_least"), *[c.alias(n) for n, c in also.items()]
    )
    # "not above the least" instead of "equal": an equality would become a part of the join's key
    met = df.select(*keys, *held, number.alias("_number")).join(least, [*keys]).where(F.col("_number") <= F.col("_least"))
    return latest_per_key(met, keys, [F.col(c) for c in held]).select(
        *keys, *[c for c in columns if c not in keys], *also
    )


def presence(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of two inputs with a flag for each side: a full outer match in one shuffle."""
    tagged = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    return tagged.groupBy(*keys).agg(
        (F.max("_l") == 1).alias("in_left"), (F.max("_r") == 1).alias("in_right")
    )
