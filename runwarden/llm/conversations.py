"""Repair of the turn structure of conversations at least cost, with the least audit among the cheapest.

Roles must spell ``(s?(ua)+)?``: four states (start, after s, after u, after a). A row is kept, re-roled or
deleted, turns without text may be inserted; the nodes (position, state) and these edits form a graph.

1. Rows lose their texts: what counts is the role's initial and the fault. They are sorted by ranges of
   (conversation, turn), and the run of a conversation inside a range, cut after ``SEGMENT`` rows, becomes a
   string of row kinds. Nearly all conversations are one such segment; one that holds most rows is many.
2. A cost DP runs backwards over all segments of a batch in step. Of a conversation of several segments, each
   gives its 4 x 4 least costs first, and a pass over these settles the costs at every border.
3. Nodes are ranked by their least audits of 1, 2, 4, ... edits along cheapest arcs, each round from pairs of
   ranks, with pointers that double; the ranks choose among a node's arcs and the pointers unroll the path.
4. The texts meet their audit, sorted by conversation and turn, and are hashed as they stream by.

The hash of a conversation is one sequence, so its texts pass through one task, which holds a batch of them
and the audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runwarden.llm.tables import stage

SEGMENT = 1 << 15
_SPACE = " \t\n\x0b\x0c\r"
_INITIALS = "sua"  # any other initial is the fourth class
_LABELS = np.frombuffer(b"DIKR", np.uint8)  # in ASCII order, which is the order of ranks
_FAR = np.int64(1) << 40
_KEEP, _REROLE, _DELETE, _INSERT, _TRUNCATED = 0, 2, 3, 2, 1
_NEXT = np.array([2, 2, 3, 2])  # the state after a user or assistant turn, whichever is due
_KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])  # state, initial
_END = np.array([0, 4, 2, 0], np.int64)  # least cost of what still has to be inserted at the end
_COUNTS = ("blank", "duplicate", "truncated", "illegal")


# -- damage and faults as columns ------------------------------------------------------
def damaged(conversations: DataFrame) -> DataFrame:
    """Rows conv, conv_id, turn, role, text, copies; conv is a text that tells null from any id."""
    as_text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")}
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(
        F.coalesce(F.concat(F.lit(":"), F.col("conv_id").cast("string")), F.lit("-")).alias("conv"),
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        (F.crc32(F.concat(as_text["conv_id"], F.lit(":"), as_text["turn"]).cast("binary")) % 20).alias("kind"),
    )
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.where("kind <> 0").select(
        "conv",
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        changed.alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def _digest() -> Column:
    """128 bits that stand for role and text."""
    told = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return F.substring(F.unhex(F.sha2(told, 256)), 1, 16)


def _described(rows: DataFrame) -> DataFrame:
    """conv, turn, role, digest, initial, blank, open (ends without a stop), later (stands in an earlier turn)."""
    bare = F.rtrim(F.col("text"), F.lit(_SPACE))
    rows = rows.select(
        "conv",
        "turn",
        "role",
        _digest().alias("digest"),
        F.instr(F.lit(_INITIALS), F.substring("role", 1, 1)).alias("initial"),
        (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("open"),
        F.explode(F.sequence(F.lit(1), "copies")).alias("copy"),
    ).drop("copy")
    rows = rows.withColumn("initial", F.when(F.col("role") == "", 0).otherwise(F.col("initial")))
    again = rows.groupBy("conv", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.min("turn").alias("first"), F.count("turn").alias("numbered")
    )
    again = again.where("n > 1").select("conv", "digest", "first", (F.col("numbered") < F.col("n")).alias("from_null"))
    later = F.when(F.col("from_null"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first"))
    return rows.join(again, ["conv", "digest"], "left").withColumn("later", F.coalesce(later, F.lit(False)))


# -- segments ----------------------------------------------------------------------------
class _Open:
    """The segment that rows are added to."""

    def __init__(self, conv: str) -> None:
        self.conv, self.kinds, self.rows = conv, [], 0
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.low = self.high = None
        self.turns = 0

    def add(self, kinds: np.ndarray, faults: np.ndarray, turns: np.ndarray, illegal: int) -> None:
        initials = kinds // 3
        if self.kinds:
            illegal += not _legal(self.kinds[-1][-1] // 3, initials[0])
        self.kinds.append(kinds)
        self.rows += len(kinds)
        for fault, name in ((1, "truncated"), (2, "blank"), (3, "duplicate")):
            self.counts[name] += int(np.count_nonzero(faults == fault))
        self.counts["illegal"] += int(illegal)
        if len(turns):
            new = 1 + int(np.count_nonzero(turns[1:] != turns[:-1]))
            self.turns += new - (self.high is not None and int(turns[0]) == self.high)
            self.low = int(turns[0]) if self.low is None else self.low
            self.high = int(turns[-1])

    def row(self, place: int) -> dict:
        kinds = np.concatenate(self.kinds)
        return {
            "conv": self.conv,
            "place": place,
            "kinds": (kinds + 97).astype(np.uint8).tobytes().decode("ascii"),
            **self.counts,
            "low": self.low,
            "high": self.high,
            "turns": self.turns,
        }


def _legal(a, b):
    """Whether the classes of two neighbouring initials are su, ua or au."""
    return ((b == 1) & ((a == 0) | (a == 2))) | ((a == 1) & (b == 2))


_SEGMENTS = "conv string, place long, kinds string, " + ", ".join(f"{c} long" for c in (*_COUNTS, "low", "high", "turns"))
_SEGMENT_SCHEMA = pa.schema(
    [("conv", pa.string()), ("place", pa.int64()), ("kinds", pa.string())]
    + [(c, pa.int64()) for c in (*_COUNTS, "low", "high", "turns")]
)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv, turn, digest, initial, blank, open, later) as one row per segment."""
    place, now, before, done = TaskContext.get().partitionId() << 32, None, None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(0)
        changed = np.ones(batch.num_rows, bool)
        new_conv = np.ones(batch.num_rows, bool)
        turn, digest = batch.column(1), batch.column(2)
        numbered = turn.is_valid().to_numpy(zero_copy_only=False)
        turns = turn.fill_null(0).to_numpy(zero_copy_only=False)
        convs, digests = conv.to_numpy(zero_copy_only=False), digest.to_numpy(zero_copy_only=False)
        new_conv[1:] = convs[1:] != convs[:-1]
        same = (turns[1:] == turns[:-1]) & (numbered[1:] == numbered[:-1]) & (digests[1:] == digests[:-1])
        changed[1:] = new_conv[1:] | ~same
        if before is not None:
            new_conv[0] = convs[0] != before[0]
            changed[0] = new_conv[0] or (turns[0], numbered[0], digests[0]) != before[1:]
        before = convs[-1], turns[-1], numbered[-1], digests[-1]
        initial = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
        initial = np.where(initial == 0, 3, initial - 1)
        blank, open_, later = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5, 6))
        faults = np.where(blank, 2, np.where(later | ~changed, 3, np.where(open_, 1, 0)))
        kinds = initial * 3 + np.minimum(faults, 2)
        broken = np.concatenate(([0], np.cumsum(~_legal(initial[:-1], initial[1:]))))
        edges = np.flatnonzero(new_conv | (np.arange(len(convs)) == 0)).tolist() + [len(convs)]
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            if new_conv[start] and now is not None:
                done.append(now.row(place))
                place, now = place + 1, None
            while start < end:
                if now is None:
                    now = _Open(convs[start])
                stop = min(end, start + SEGMENT - now.rows)
                inside = turns[start:stop][numbered[start:stop]]
                now.add(kinds[start:stop], faults[start:stop], inside, broken[stop - 1] - broken[start])
                start = stop
                if now.rows >= SEGMENT:
                    done.append(now.row(place))
                    place, now = place + 1, None
        if len(done) >= 4096 or sum(len(d["kinds"]) for d in done) > 1 << 20:
            yield pa.RecordBatch.from_pylist(done, _SEGMENT_SCHEMA)
            done = []
    if now is not None:
        done.append(now.row(place))
    if done:
        yield pa.RecordBatch.from_pylist(done, _SEGMENT_SCHEMA)


# -- costs, ranks, paths -----------------------------------------------------------------
def _arcs() -> tuple[np.ndarray, np.ndarray]:
    """Target state and cost of every kind of row, state and edit (D, K, R); -1 where there is none."""
    to, cost = np.full((12, 4, 3), -1), np.full((12, 4, 3), _FAR)
    for kind in range(12):
        initial, fault = divmod(kind, 3)
        for state in range(4):
            to[kind, state, 0], cost[kind, state, 0] = state, _DELETE
            if fault == 2:
                continue
            more = _TRUNCATED if fault == 1 else 0
            if _KEPT[state, initial] >= 0:
                to[kind, state, 1], cost[kind, state, 1] = _KEPT[state, initial], _KEEP + more
            to[kind, state, 2], cost[kind, state, 2] = _NEXT[state], _REROLE + more
    return to, cost


_TO, _COST = _arcs()


def _with_inserts(costs: np.ndarray) -> np.ndarray:
    """Least costs when turns may be inserted first."""
    out = costs.copy()
    out[:, 2] = np.minimum(costs[:, 2], _INSERT + costs[:, 3])
    out[:, 3] = np.minimum(costs[:, 3], _INSERT + costs[:, 2])
    for state in (0, 1):
        out[:, state] = np.minimum(costs[:, state], _INSERT + out[:, 2])
    return out


def costs_to_go(kinds: list[np.ndarray], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least costs at every position of every segment (rows of four states), and where each segment begins.

    ``ends`` holds the costs behind each segment's last row. All segments take a step at once, from their ends.
    """
    sizes = np.array([len(k) for k in kinds])
    first = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    order = np.argsort(-sizes, kind="stable")
    last = first[order] + sizes[order]
    costs = np.empty((int((sizes + 1).sum()), 4), np.int64)
    costs[last] = ends[order]
    flat = np.zeros(len(costs), np.int64)
    for at, kind in zip(first, kinds, strict=True):
        flat[at : at + len(kind)] = kind
    live = np.searchsorted(-sizes[order], -np.arange(1, sizes.max(initial=0) + 1), side="right")
    for step, n in enumerate(live.tolist(), 1):
        at = last[:n] - step
        to, cost = _TO[flat[at]], _COST[flat[at]]
        after = np.take_along_axis(costs[at + 1], np.maximum(to, 0).reshape(n, 12), 1).reshape(n, 4, 3)
        costs[at] = _with_inserts((cost + after).min(2))
    return costs, first


def _cheapest(kinds: list[np.ndarray], costs: np.ndarray, first: np.ndarray, last: bool) -> np.ndarray:
    """Targets of the arcs D, I, K, R of every node (position * 4 + state) that lie on a cheapest path, else -1.

    Positions behind a segment have no arcs, unless it is the last one of its conversation: turns may still be
    inserted there.
    """
    sizes = np.array([len(k) for k in kinds])
    to = np.full((len(costs), 4, 4), -1)
    ends = first + sizes
    at = np.setdiff1d(np.arange(len(costs)), ends, assume_unique=True)
    kind = np.concatenate(kinds)
    state, cost = _TO[kind], _COST[kind]
    after = np.take_along_axis(costs[at + 1], np.maximum(state, 0).reshape(len(at), 12), 1).reshape(len(at), 4, 3)
    best = (cost + after == costs[at][:, :, None]) & (costs[at] < _FAR)[:, :, None]
    found = np.where(best, (at[:, None, None] + 1) * 4 + state, -1)
    to[at[:, None], :, [[0, 2, 3]]] = np.moveaxis(found, 2, 1)
    where = np.arange(len(costs)) if last else at
    insert = (costs[where] == _INSERT + costs[where][:, _NEXT]) & (costs[where] < _FAR)
    to[where, :, 1] = np.where(insert, where[:, None] * 4 + _NEXT, -1)
    return to.reshape(-1, 4)


def least_paths(to: np.ndarray, starts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The ASCII-least audit from every start along the arcs ``to``, and the node where it ends.

    Rounds rank all nodes by their least audits of twice as many edits: the pair of a node's rank and the rank
    of the node that its pointer names is the next rank, and the pointer's pointer the next pointer. An audit
    that has ended sorts first. A node's arcs bear different letters, so an audit names one path.
    """
    nodes = np.arange(len(to))
    has = to >= 0
    label = np.where(has.any(1), has.argmax(1), -1)
    after = np.where(label >= 0, to[nodes, np.maximum(label, 0)], nodes)
    rank, jump, jumps = label + 1, after, []
    while True:
        jumps.append(jump)
        pair = rank.astype(np.int64) * (int(rank.max()) + 1) + rank[jump]
        rank, jump = np.unique(pair, return_inverse=True)[1].reshape(-1), jump[jump]
        if (label[jump] < 0).all():
            break
    # whole audits are ranked now: a letter, then the rank of what follows it
    behind = np.where(has, np.arange(4) * (int(rank.max()) + 1) + rank[np.maximum(to, 0)], np.iinfo(np.int64).max)
    chosen = behind.argmin(1)
    walk = starts[:, None]
    for pointer in jumps:
        if (label[walk[:, -1]] < 0).all():
            break
        walk = np.concatenate([walk, pointer[walk]], axis=1)
    letters = _LABELS[chosen[walk]]
    lengths = (label[walk] >= 0).sum(1)
    return [row[:n].tobytes() for row, n in zip(letters, lengths.tolist(), strict=True)], jump[starts]


def _kinds(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.encode("ascii"), np.uint8).astype(np.int64) - 97 for x in column.to_pylist()]


def _by_size(kinds: list[np.ndarray], most: int = 1 << 16) -> Iterator[np.ndarray]:
    """Indices of segments of similar size, so that doubled walks of a part stay small."""
    sizes = np.array([len(k) for k in kinds])
    order = np.argsort(sizes, kind="stable")
    start = 0
    while start < len(order):
        least = max(int(sizes[order[start]]), 1)
        end = start + 1
        while end < len(order) and sizes[order[end]] <= 2 * least and (end - start + 1) * sizes[order[end]] <= most:
            end += 1
        yield order[start:end]
        start = end


_WHOLE = "conv string, audit string, cost long, gaps long, " + ", ".join(f"{c} long" for c in _COUNTS)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audits of conversations that are one segment."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
        kinds = _kinds(batch.column(batch.schema.names.index("kinds")))
        audits, least = [b""] * len(kinds), np.zeros(len(kinds), np.int64)
        for part in _by_size(kinds):
            some = [kinds[i] for i in part]
            costs, first = costs_to_go(some, np.tile(_END, (len(some), 1)))
            found, _ = least_paths(_cheapest(some, costs, first, True), first * 4)
            least[part] = costs[first, 0]
            for i, audit in zip(part.tolist(), found, strict=True):
                audits[i] = audit
        gaps = [0 if lo is None else hi - lo + 1 - n for lo, hi, n in zip(rows["low"], rows["high"], rows["turns"], strict=True)]
        yield pa.RecordBatch.from_pydict(
            {
                "conv": pa.array(rows["conv"], pa.string()),
                "audit": pa.array([a.decode("ascii") for a in audits], pa.string()),
                "cost": pa.array(least, pa.int64()),
                "gaps": pa.array(gaps, pa.int64()),
                **{c: pa.array(rows[c], pa.int64()) for c in _COUNTS},
            }
        )


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per segment the least costs from each state before it to each state behind its last row (rows, joined)."""
    for batch in batches:
        kinds, out = _kinds(batch.column(2)), []
        for kind in kinds:
            ends = np.where(np.eye(4, dtype=bool), 0, _FAR)
            costs, first = costs_to_go([kind] * 4, ends)
            out.append(np.minimum(costs[first].T, _FAR).reshape(-1))
        edge = [[int(k[0] // 3), int(k[-1] // 3)] for k in kinds]
        columns = [batch.column(i) for i in range(batch.num_columns) if i != 2]
        names = [n for n in batch.schema.names if n != "kinds"]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array([x.tolist() for x in out], pa.list_(pa.int64())), pa.array(edge, pa.list_(pa.int64()))],
            names=[*names, "least", "edge"],
        )


def _borders(rows: pd.DataFrame) -> pd.DataFrame:
    """Costs behind every segment of one conversation, and the counts of the whole conversation."""
    rows = rows.sort_values("place").reset_index(drop=True)
    ends, now = [], _END
    for least in reversed(rows["least"].tolist()):
        ends.append(now.tolist())
        now = (np.asarray(least).reshape(4, 4) + now).min(1)
    edges, illegal, turns = rows["edge"].tolist(), int(rows["illegal"].sum()), int(rows["turns"].sum())
    illegal += sum(not _legal(a[1], b[0]) for a, b in zip(edges[:-1], edges[1:], strict=True))
    numbered = rows[rows["turns"] > 0]
    highs, lows = numbered["high"].tolist(), numbered["low"].tolist()
    turns -= sum(h == lo for h, lo in zip(highs[:-1], lows[1:], strict=True))
    gaps = int(highs[-1]) - int(lows[0]) + 1 - turns if highs else 0
    return pd.DataFrame(
        {
            "conv": rows["conv"],
            "place": rows["place"],
            "ends": ends[::-1],
            "last": rows["place"] == rows["place"].max(),
            "cost": int(now[0]),
            "gaps": gaps,
            "blank": int(rows["blank"].sum()),
            "duplicate": int(rows["duplicate"].sum()),
            "truncated": int(rows["truncated"].sum()),
            "illegal": illegal,
        }
    )


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least audits of a segment (conv, place, kinds, ends, last) from each state, and the states behind it."""
    for batch in batches:
        kinds, audits, exits = _kinds(batch.column(2)), [], []
        ends, lasts = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        for kind, end, last in zip(kinds, ends, lasts, strict=True):
            costs, first = costs_to_go([kind], np.array([end], np.int64))
            found, reached = least_paths(_cheapest([kind], costs, first, last), np.arange(4))
            audits.append([a.decode("ascii") for a in found])
            exits.append((reached % 4).tolist())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(audits, pa.list_(pa.string())), pa.array(exits, pa.list_(pa.int64()))],
            names=["conv", "place", "audits", "exits"],
        )


def _entries(rows: pd.DataFrame) -> pd.DataFrame:
    """The state before every segment of one conversation."""
    rows, state, states = rows.sort_values("place"), 0, []
    for exits in rows["exits"].tolist():
        states.append(state)
        state = int(exits[state])
    return pd.DataFrame({"conv": rows["conv"], "place": rows["place"], "state": states})


def audits(conversations: DataFrame) -> DataFrame:
    """Columns conv, audit, cost, gaps and the fault counts, for conversations that have rows after damage."""
    rows = _described(damaged(conversations)).select("conv", "turn", "digest", "initial", "blank", "open", "later", "role")
    keys = ["conv", F.col("turn").asc_nulls_first(), "role", "digest"]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("role")
    segments = stage(dealt.mapInArrow(_segments, _SEGMENTS), "segments")
    several = stage(segments.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("conv"), "several")
    alone = segments.join(several, "conv", "left_anti").mapInArrow(_whole, _WHOLE)

    many = segments.join(several, "conv", "left_semi")
    whole = "cost long, gaps long, blank long, duplicate long, truncated long, illegal long"
    described = ", ".join(f"{c} long" for c in (*_COUNTS, "low", "high", "turns"))
    least = many.mapInArrow(_matrices, f"conv string, place long, {described}, least array<long>, edge array<long>")
    bordered = least.groupBy("conv").applyInPandas(
        _borders, f"conv string, place long, ends array<long>, last boolean, {whole}"
    )
    bordered = stage(bordered, "borders")
    known = many.select("conv", "place", "kinds").join(bordered.select("conv", "place", "ends", "last"), ["conv", "place"])
    ways = known.select("conv", "place", "kinds", "ends", "last").mapInArrow(
        _ways, "conv string, place long, audits array<string>, exits array<long>"
    )
    ways = stage(ways, "ways")
    states = ways.select("conv", "place", "exits").groupBy("conv").applyInPandas(
        _entries, "conv string, place long, state int"
    )
    parts = ways.join(states, ["conv", "place"]).select("conv", "place", F.get("audits", "state").alias("audit"))
    joined = parts.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("place", "audit"))).alias("parts"))
    totals = bordered.where("last").select("conv", "cost", "gaps", *_COUNTS)
    composed = joined.join(totals, "conv").select(
        "conv", F.array_join(F.transform("parts", lambda p: p["audit"]), "").alias("audit"), "cost", "gaps", *_COUNTS
    )
    return alone.unionByName(composed)


# -- repaired texts ----------------------------------------------------------------------
class _Replay:
    """Applies an audit to the rows of one conversation, hashing what comes out."""

    _STATES = {"s": 1, "u": 2, "a": 3}

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, 0
        self.hash, self.lines = hashlib.sha256(), 0

    def _line(self, role: str, text: str) -> None:
        if self.lines:
            self.hash.update(b"\n")
        self.lines += 1
        self.hash.update(role.encode("utf-8", "surrogatepass") + b":" + text.encode("utf-8", "surrogatepass"))
        self.state = self._STATES[role[:1]]

    def _due(self) -> str:
        return "assistant" if self.state == 2 else "user"

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._line(self._due(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._line(role if edit == "K" else self._due(), text)

    def digest(self) -> str:
        self._inserts()
        return self.hash.hexdigest()


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conv: the head with its audit, then the texts; one digest per conv."""
    conv, now, names, found = None, None, [], []

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.string())], ["conv", "digest"])

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(5)]
        for name, audit, role, text, copies in zip(*columns, strict=True):
            if role is None:
                if now is not None:
                    names.append(conv)
                    found.append(now.digest())
                conv, now = name, _Replay(audit)
                continue
            for _ in range(copies):
                now.row(role, text)
        if len(names) >= 4096:
            yield flush()
            names, found = [], []
    if now is not None:
        names.append(conv)
        found.append(now.digest())
    if names:
        yield flush()


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations``: gaps, fault counts, cost, audit, repaired_sha256.

    Needs conv_id, turn, role and text; other columns are ignored. A null role or text is one space, so is a null
    conv_id or turn in the key of the damage; null conv_ids are one conversation, null turns come first. Rows of
    equal turn stand in the order of their role, then of a digest of role and text, so repeated rows are
    neighbours and all but the first are duplicates. Empty tables give no rows.
    """
    heads = conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_rows"))
    key = F.coalesce(F.concat(F.lit(":"), F.col("conv_id").cast("string")), F.lit("-"))
    told = stage(audits(conversations), "audits")
    heads = heads.select("conv_id", key.alias("conv")).join(told, "conv", "left")
    heads = heads.fillna(0, ["gaps", *_COUNTS, "cost"]).fillna("", ["audit"])

    none = F.lit(None).cast("string")
    first = heads.select(
        "conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"),
        "audit", none.alias("role"), none.alias("text"), F.lit(0).alias("copies"),
    )
    texts = damaged(conversations).select(
        "conv", F.lit(1).alias("kind"), "turn", _digest().alias("digest"), none.alias("audit"), "role", "text", "copies"
    )
    order = ["conv", "kind", F.col("turn").asc_nulls_first(), "role", "digest"]
    sorted_ = first.union(texts).repartition("conv").sortWithinPartitions(*order)
    hashed = sorted_.select("conv", "audit", "role", "text", "copies").mapInArrow(_replayed, "conv string, digest string")
    return heads.join(hashed, "conv").select(
        "conv_id", "gaps", *_COUNTS, "cost", "audit", F.col("digest").alias("repaired_sha256")
    )
