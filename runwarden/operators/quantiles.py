"""Exact quantiles of a group by narrowing the interval that holds each rank, without a buffer of its values.

A round counts the values of the open intervals in bins of equal width; counts combine before the shuffle and
merge by adding. The bin that holds a rank is the next interval. After the last round a bin is one value. The
bits of a group's value range are shared among the rounds, so a range of 2**30 takes 1,024 bins a round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 3


def _shifted(name: str, value: Column, by: Column) -> Column:
    return F.call_function(name, value, by.cast("int"))


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    weight: str | None = None,
    rounds: int = ROUNDS,
) -> DataFrame:
    """Columns ``keys`` and q: the quantiles of ``value`` (whole numbers), interpolated like ``percentile``.

    ``weight`` counts how often a row stands for its value. NULL values are left out; a group without values has
    no row. The spread of a group's values must fit into 63 bits.
    """
    n = F.lit(1) if weight is None else F.col(weight)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("long").alias("_v"), n.cast("long").alias("_n"))
    groups = rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_of"))
    bits = F.when(F.col("_hi") > F.col("_lo"), F.length(F.bin(F.col("_hi") - F.col("_lo")))).otherwise(0)
    groups = groups.withColumn("_step", F.ceil(bits / rounds).cast("int"))

    places = [F.lit(p) * (F.col("_of") - 1) for p in probabilities]
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x), F.ceil(x)) for x in places])))
    # an interval is [_lo, _lo + 2 ** _bits); _rank counts the values of the interval below the wanted one
    open_ = groups.select(
        *keys, "_of", "_step", "_lo", (F.col("_step") * rounds).alias("_bits"), F.explode(wanted).alias("_at")
    ).withColumn("_rank", F.col("_at"))
    for _ in range(rounds):
        intervals = open_.select(*keys, "_lo", "_bits", (F.col("_bits") - F.col("_step")).alias("_shift")).distinct()
        offset = F.col("_v") - F.col("_lo")
        inside = (offset >= 0) & (_shifted("shiftright", offset, F.least("_bits", F.lit(63))) == 0)
        bins = (
            rows.join(intervals, list(keys))
            .where(inside)
            .groupBy(*keys, "_lo", "_shift", _shifted("shiftright", offset, F.col("_shift")).alias("_bin"))
            .agg(F.sum("_n").alias("_m"))
        )
        below = Window.partitionBy(*keys, "_lo").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("_below", F.coalesce(F.sum("_m").over(below), F.lit(0)))
        holds = (F.col("_rank") >= F.col("_below")) & (F.col("_rank") < F.col("_below") + F.col("_m"))
        open_ = open_.join(bins, [*keys, "_lo"]).where(holds).select(
            *keys,
            "_of",
            "_step",
            "_at",
            (F.col("_lo") + _shifted("shiftleft", F.col("_bin"), F.col("_shift"))).alias("_lo"),
            F.col("_shift").alias("_bits"),
            (F.col("_rank") - F.col("_below")).alias("_rank"),
        )

    def at(rank: Column) -> Column:
        return F.element_at("_found", rank)

    def quantile(place: Column) -> Column:
        low, high = F.floor(place), F.ceil(place)
        between = (high - place) * at(low) + (place - low) * at(high)
        return F.when(low == high, at(low).cast("double")).otherwise(between)

    found = open_.groupBy(*keys).agg(
        F.max("_of").alias("_of"), F.map_from_entries(F.collect_list(F.struct("_at", "_lo"))).alias("_found")
    )
    return found.select(*keys, F.array(*[quantile(x) for x in places]).alias("q"))
