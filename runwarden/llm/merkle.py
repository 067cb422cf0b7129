"""Merkle manifest of a dataset: leaves per row, a tree per group, a tree over the groups, proofs for every row.

A level is a table of nodes (grp, idx, digest, n). Every node sends its digest to its sibling indices (XOR for
a binary tree, the other slots of its run otherwise) and meets the nodes there by an equijoin on (grp, idx);
rows of slot zero then hold a whole run and emit its parent. Keys are unique, so a group that holds most rows
is spread like any other. Going back down, a node takes the path of its parent, so no key meets more than one
run and the top of a tree is never joined with all rows.

Digests are SHA-256; inside tables they are 32 bytes, hashed as lowercase hex text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runwarden.llm.tables import stage

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 8
_SIZE = 32  # bytes of a digest
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def joined_digest(parts: Column) -> Column:
    """Digest of one or more digests that lie one after another, taken as hex text."""
    return F.unhex(F.sha2(hex_of(parts), 256))


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def numbered(rows: DataFrame, grp: str, *order: Column | str) -> DataFrame:
    """``rows`` with idx (0, 1, ... inside each ``grp`` by ``order``) and n, the group's number of rows.

    Rows are dealt by ranges of (grp, order) and numbered inside their range; what precedes a range is a
    running sum over one row per group and range. The dealt rows are written first, so that numbers stay the
    same when an executor is lost. Rows that are equal in ``order`` may take each other's place.
    """
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [F.col(grp), *order, F.col("_tie")]
    dealt = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    dealt = stage(dealt.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    dealt = dealt.withColumn("_range", F.shiftright("_place", 33))
    ranges = dealt.groupBy(grp, "_range").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(grp).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    ranges = ranges.withColumn("n", F.sum("_rows").over(Window.partitionBy(grp))).drop("_rows")
    return (
        dealt.join(ranges, [grp, "_range"])
        .withColumn("idx", F.col("_place") - F.col("_first") + F.col("_before"))
        .drop("_place", "_range", "_first", "_before")
    )


def _siblings(idx: Column, arity: int) -> Column:
    if arity == 2:
        return F.array(idx.bitwiseXOR(F.lit(1)))
    first = idx - idx % arity
    return F.filter(F.sequence(first, first + (arity - 1)), lambda x: x != idx)


def _linked(nodes: DataFrame, arity: int) -> DataFrame:
    """Columns grp, idx, n, digest, siblings (digests of the run's other nodes, left to right, joined)."""
    sent = nodes.select(
        "grp",
        F.explode(_siblings(F.col("idx"), arity)).alias("idx"),
        F.struct(F.col("idx").alias("at"), "digest").alias("sibling"),
        F.col("n").alias("of"),
    )
    sent = sent.where("idx < of").drop("of")
    met = nodes.join(sent, ["grp", "idx"], "left").groupBy("grp", "idx", "n", "digest")
    run = F.array_sort(F.collect_list("sibling"))
    return met.agg(
        F.aggregate(run, F.lit(b""), lambda all_, s: F.concat(all_, s["digest"])).alias("siblings")
    )


@dataclass(frozen=True)
class Forest:
    """One tree per group. ``levels``: linked nodes of groups that go on; ``tops``: grp, digest, level of its top."""

    arity: int
    levels: list[DataFrame]
    tops: DataFrame


def forest(nodes: DataFrame, arity: int = ARITY) -> Forest:
    """Trees over ``nodes`` (grp, idx, n, digest); a group of one node is its own top."""
    levels, tops, nodes = [], None, stage(nodes.select("grp", "idx", "n", "digest"), "nodes")
    while True:
        done = nodes.where("n = 1").select("grp", "digest", F.lit(len(levels)).alias("level"))
        tops = done if tops is None else tops.union(done)
        if (nodes.agg(F.max("n")).first()[0] or 0) <= 1:
            return Forest(arity, levels, tops)
        linked = stage(_linked(nodes.where("n > 1"), arity), "linked")
        levels.append(linked)
        parents = linked.where(F.col("idx") % arity == 0).select(
            "grp",
            F.floor(F.col("idx") / arity).alias("idx"),
            F.ceil(F.col("n") / arity).alias("n"),
            joined_digest(F.concat("digest", "siblings")).alias("digest"),
        )
        nodes = stage(parents, "nodes")


def paths(trees: Forest, above: DataFrame) -> DataFrame:
    """Columns grp, idx, path and those of ``above``, for every bottom node.

    ``above`` has one row per grp with ``path``, the steps from the group's top on. A step is the struct of the
    node's slot and its siblings.
    """
    carried = [c for c in above.columns if c not in ("grp", "path")]
    tops = trees.tops.select("grp", "level").join(above, "grp")

    def ended(level: int) -> DataFrame:
        return tops.where(F.col("level") == level).select("grp", F.lit(0).cast("long").alias("idx"), "path", *carried)

    found = ended(len(trees.levels))
    for level in range(len(trees.levels) - 1, -1, -1):
        step = F.struct((F.col("idx") % trees.arity).cast("int").alias("slot"), "siblings")
        nodes = trees.levels[level].select(
            "grp", "idx", F.floor(F.col("idx") / trees.arity).alias("parent"), step.alias("step")
        )
        higher = found.withColumnRenamed("idx", "parent")
        here = nodes.join(higher, ["grp", "parent"]).select(
            "grp", "idx", F.concat(F.array("step"), "path").alias("path"), *carried
        )
        found = here.union(ended(level))
    return found


def folded(start: Column, path: Column) -> Column:
    """The root that ``start`` gives with the siblings of ``path``."""

    def step(now: Column, at: Column) -> Column:
        cut = at["slot"] * _SIZE
        return joined_digest(
            F.concat(
                F.substring(at["siblings"], F.lit(1), cut),
                now,
                F.substring(at["siblings"], cut + 1, F.octet_length(at["siblings"]) - cut),
            )
        )

    return F.aggregate(path, start, step)


def manifest(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """Columns doc_id, text_changed, leaf, changed_leaf, subroot, root (binary digests) and path, for every row of ``docs``.

    Leaves of one lang ascend by doc_id (nulls first); rows of equal doc_id by their leaf, so that repeated rows
    give the same tree in any order. The tree over langs puts null first, then UTF-8 order. ``changed_leaf`` is
    the leaf after A-Z of the text are lower-cased, where 3 divides the CRC of the decimal doc_id, else null; a
    null doc_id has no CRC and stays. Any column may be null, an empty lang is a lang of its own, an empty table
    gives no rows, other columns are ignored.
    """
    columns = [F.col(f"`{c}`") for c in COLUMNS]
    lowered = F.translate(F.col("text"), _UPPER, _LOWER)
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    rows = docs.select(
        F.col("doc_id"),
        # '-' sorts before ':', so null comes first
        F.coalesce(F.concat(F.lit(":"), F.col("lang").cast("string")), F.lit("-")).alias("grp"),
        leaf(*columns).alias("digest"),
        F.when(chosen, leaf(*columns[:-1], lowered)).alias("changed"),
    )
    rows = numbered(rows, "grp", F.col("doc_id").asc_nulls_first(), F.col("digest"))
    rows = stage(rows, "leaves")
    langs = forest(rows, arity)

    subroots = langs.tops.select(F.lit(0).alias("all"), F.col("grp").alias("lang"), "digest")
    subroots = stage(numbered(subroots, "all", F.col("lang").asc()), "subroots")
    whole = forest(subroots.select(F.col("all").cast("string").alias("grp"), "idx", "n", "digest"), arity)
    empty = F.array().cast("array<struct<slot:int,siblings:binary>>")
    root = whole.tops.select("grp", F.col("digest").alias("root"), empty.alias("path"))
    above = paths(whole, root).drop("grp").join(subroots, "idx")
    above = above.select(F.col("lang").alias("grp"), F.col("digest").alias("subroot"), "root", "path")
    above = stage(above, "above")

    return rows.join(paths(langs, above), ["grp", "idx"]).select(
        "doc_id", F.col("digest").alias("leaf"), F.col("changed").alias("changed_leaf"), "subroot", "root", "path"
    )


def verified(found: DataFrame) -> DataFrame:
    """Proof digests and the roots folded from changed leaves, else from the original ones, as hex text."""
    siblings = F.array_join(F.transform("path", lambda s: hex_of(s["siblings"])), "")
    found = found.withColumn("folded", folded(F.coalesce("changed_leaf", "leaf"), F.col("path")))
    return found.select(
        "doc_id",
        hex_of(F.col("leaf")).alias("leaf"),
        hex_of(F.col("subroot")).alias("subroot"),
        hex_of(F.col("root")).alias("root"),
        F.sha2(siblings, 256).alias("proof_sha256"),
        hex_of(F.col("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )
