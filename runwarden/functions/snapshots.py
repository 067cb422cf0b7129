"""Schema snapshots (column -> type) as maps, and the difference of two of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(snapshot_json: Column) -> Column:
    """Map of a snapshot; malformed JSON is NULL, JSON that is not an object is an empty map."""
    text = F.nullif(snapshot_json, F.lit(""))
    as_map = F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"})
    other = F.try_parse_json(text)
    is_object = F.regexp_like(text, F.lit(r"^\s*\{"))
    empty = F.create_map().cast("map<string,string>")
    return F.when(is_object, as_map).when(other.isNotNull(), empty)


def added(current: Column, previous: Column) -> Column:
    return F.array_sort(F.array_except(F.map_keys(current), F.map_keys(previous)))


def removed(current: Column, previous: Column) -> Column:
    return F.array_sort(F.array_except(F.map_keys(previous), F.map_keys(current)))


def type_changes(current: Column, previous: Column) -> Column:
    """Array of (column, from, to) for columns of both whose type differs, in column order."""
    shared = F.array_sort(F.array_intersect(F.map_keys(current), F.map_keys(previous)))
    moved = F.filter(
        shared, lambda c: ~F.element_at(current, c).eqNullSafe(F.element_at(previous, c))
    )
    return F.transform(
        moved,
        lambda c: F.struct(
            c.alias("column"),
            F.element_at(previous, c).alias("from"),
            F.element_at(current, c).alias("to"),
        ),
    )


def snapshot_of(df: DataFrame) -> Column:
    """JSON snapshot of a DataFrame's own schema, as a literal; nothing is read."""
    import json

    return F.lit(json.dumps({f.name: f.dataType.simpleString() for f in df.schema.fields}))
