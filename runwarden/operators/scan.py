"""Running values along the rows of a key, however many of all rows that key owns.

Rows are dealt by ranges of (keys, order) and written in that order, so a key with very many rows, all of one
hour or even of one instant, lies in many ranges. The task that writes a range sees its rows in order and adds what
came before each inside that range. Only the last key of a range goes on in the next one: what it leaves behind is one
row per range, these rows are composed in order, and all rows of that key in the next range add the result. Rows move
once, by the deal; what is carried over is as small as the number of ranges and meets them where they lie. Columns
that follow from others of their row (texts made of numbers) can be made behind the deal, so that they don't move.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from decimal import Decimal, localcontext
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from runwarden.session import staged

_AT, _SEGMENT = "_at", "_segment"
_TIES = 65536  # numbers that rows equal in keys and order are told apart by, a small one moves better than a place


def dealt(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    along: Callable[[DataFrame], DataFrame] = lambda ranged: ranged,
    made: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``df`` with its place in (keys, order) and its range, written once so that places stay the same.

    ``along`` may add columns row by row, in order, inside the task of a range. Rows that are equal in keys and order
    may take each other's place. ``made`` are columns over those of ``df``, which ``keys`` and ``order`` may name;
    they are there for ``along`` and move with no row.
    """
    made = dict(made or {})
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(_TIES)).alias("_tie")
    dealt_by = [made[c] if c in made else F.col(c) for c in (*keys, *order)]
    ranged = df.select("*", spread).repartitionByRange(*dealt_by, F.col("_tie"))
    ranged = ranged.withColumns(made).sortWithinPartitions(*keys, *order, "_tie")
    placed = staged(along(ranged.drop("_tie")).withColumn(_AT, F.monotonically_increasing_id()), "scans")
    return placed.withColumn(_SEGMENT, F.shiftright(_AT, 33))


def _sum_type(kind: T.DataType) -> T.DataType:
    return T.DecimalType(38, kind.scale) if isinstance(kind, T.DecimalType) else T.LongType()


def _before_each(
    batches: Iterator[pa.RecordBatch],
    keys: Sequence[str],
    totals: Mapping[str, str],
    lasts: Mapping[str, str],
    types: Mapping[str, pa.DataType],
    made: Sequence[str] = (),
) -> Iterator[pa.RecordBatch]:
    """Rows in order, each with the sums and last values of the rows of its key before it.

    ``totals`` and ``lasts`` name the added columns and the columns they run over, which are left out, as are those
    named by ``made``; ``types`` are those of the sums.
    """
    left_out = {*totals.values(), *lasts.values(), *made}
    held_key, sums, held = None, dict.fromkeys(totals, 0), {}
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        starts = np.zeros(n, dtype=bool)
        for k in keys:
            a, b = batch.column(k).slice(1), batch.column(k).slice(0, n - 1)
            same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
            starts[1:] |= ~same.to_numpy(zero_copy_only=False)
        starts[0] = held_key is None or held_key != tuple(batch.column(k)[0].as_py() for k in keys)
        held_key = tuple(batch.column(k)[n - 1].as_py() for k in keys)
        row = np.arange(n)
        start = np.maximum.accumulate(np.where(starts, row, 0))
        goes_on = (start == 0) & (not starts[0])  # rows of the key the batch before ended with
        added = []
        for name, column in totals.items():
            whole = pa.types.is_int64(types[name])
            values = batch.column(column)
            if whole:
                x = pc.fill_null(values.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
            else:
                x = np.array([v or Decimal(0) for v in values.to_pylist()], dtype=object)
            with localcontext() as exact:
                exact.prec = 76
                upto = np.concatenate([[0], np.cumsum(x)])
                out = upto[:-1] - upto[start] + np.where(goes_on, sums[name], 0)
                sums[name] = out[-1] + x[-1]
            added.append(pa.array(out if whole else [Decimal(v) for v in out], types[name]))
        for name, column in lasts.items():
            values = batch.column(column)
            there = np.maximum.accumulate(np.where(values.is_valid().to_numpy(zero_copy_only=False), row, -1))
            upto = np.concatenate([[-1], there[:-1]])
            at = np.where(upto >= start, upto, np.where(goes_on, n, -1))
            both = pa.concat_arrays([values, held.get(name, pa.nulls(1, values.type))])
            added.append(both.take(pa.array(at, mask=at < 0)))
            end = there[-1] if there[-1] >= start[-1] else n if goes_on[-1] else -1
            held[name] = both.slice(end, 1) if end >= 0 else pa.nulls(1, values.type)
        kept = [c for c in batch.schema.names if c not in left_out]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in kept], *added], [*kept, *totals, *lasts]
        )


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    totals: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    made: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``df`` with running values over the rows of the same keys that come before each row.

    ``totals`` names sums (0 where nothing came before; NULLs add nothing), ``lasts`` the last non-NULL value (NULL
    where there is none). Sums should be of whole or decimal numbers, so that their grouping doesn't show. NULL
    keys are one key; NULLs come first in the order. ``made`` adds columns over those of ``df`` that any of the others
    may name; they are neither moved nor written, but made where they are used.
    """
    totals, lasts, made = dict(totals or {}), dict(lasts or {}), dict(made or {})
    whole = df.withColumns(made)
    added = whole.select(
        *[c.cast(_sum_type(whole.select(c).schema[0].dataType)).alias(f"_i_{n}") for n, c in totals.items()],
        *[c.alias(f"_i_{n}") for n, c in lasts.items()],
    ).schema
    kind = {n: added[f"_i_{n}"].dataType for n in totals}
    types = {f"_i_{n}": to_arrow_type(t) for n, t in kind.items()}
    sums, held = {f"_i_{n}": f"_v_{n}" for n in totals}, {f"_i_{n}": f"_v_{n}" for n in lasts}
    made_keys = [k for k in keys if k in made]
    schema = T.StructType([*df.schema.fields, *[T.StructField(f.name, f.dataType) for f in added]])

    def along(ranged: DataFrame) -> DataFrame:
        # the values are made behind the deal, which moves the columns of ``df`` alone
        valued = ranged.select(
            *[F.col(f"`{c}`") for c in df.columns],
            *made_keys,
            *[c.alias(f"_v_{n}") for n, c in (totals | lasts).items()],
        )
        return valued.mapInArrow(lambda batches: _before_each(batches, keys, sums, held, types, made_keys), schema)

    rows = dealt(df, keys, order, along, made).withColumns(made)
    ends = rows.groupBy(_SEGMENT).agg(F.max(_AT).alias(_AT))
    # what the last key of a range leaves behind, one row per range
    left = rows.join(F.broadcast(ends.select(_AT)), _AT).select(
        *keys,
        _SEGMENT,
        *[(F.col(f"_i_{n}") + F.coalesce(c, F.lit(0))).alias(f"_c_{n}") for n, c in totals.items()],
        *[F.coalesce(c, f"_i_{n}").alias(f"_c_{n}") for n, c in lasts.items()],
    )
    upto = Window.partitionBy(*keys).orderBy(_SEGMENT)
    following = ends.select(_SEGMENT, F.lead(_SEGMENT).over(Window.orderBy(_SEGMENT)).alias("_next"))
    carried = left.join(F.broadcast(following), _SEGMENT).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_next"),
        *[F.sum(f"_c_{n}").over(upto).alias(f"_c_{n}") for n in totals],
        *[F.last(f"_c_{n}", ignorenulls=True).over(upto).alias(f"_c_{n}") for n in lasts],
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = rows.join(F.broadcast(carried), reduce(and_, same, F.col(_SEGMENT) == F.col("_next")), "left")
    return joined.select(
        *[f"`{c}`" for c in whole.columns],
        *[(F.col(f"_i_{n}") + F.coalesce(f"_c_{n}", F.lit(0))).cast(kind[n]).alias(n) for n in totals],
        *[F.coalesce(f"_i_{n}", f"_c_{n}").alias(n) for n in lasts],
    )
