"""Conversation structure repair: the cheapest edits that give every conversation a legal order of roles.

Roles must read `(s?(ua)+)?` by their initials. A row is kept (0), given the role user or assistant (3) or
deleted (4); turns without text can be put in anywhere (3). A truncated row that stays costs 3 more; blank rows
and copies of earlier rows must go. Of all cheapest edits those win whose initials (D, I, K, R), in order, are
least as a text: the audit.

A node is (row, state), with the states: nothing yet, after the system turn, after user, after assistant.
1. Costs. The cost to go is a dynamic programme from the last row back. An arc (an edit) is optimal if its
   cost and the cost to go behind it add up to the cost to go before it.
2. Ranks. Nodes are ranked by the least audit of 1, 2, 4, ... edits that starts on them: the rank for twice the
   length is the rank of the pair (own rank, rank at the place the pointer leads to), and the pointer is
   doubled. The optimal arcs of one node have different initials, so the rank of length 1 leaves one arc, and
   the doubled pointers are unique. An audit that is over is less than any that goes on.
3. The least path is read by halving: from each place the pointers of half the length give the place between.

A conversation can have any number of rows. Rows are numbered over the whole table and handled in blocks of
4,096 numbers. A block turns costs at its end into costs at its start, a 4 x 4 matrix in (min, +), and the state
at its start into the state at its end, a pointer; both are composed over the blocks of a conversation in a
tree of 512 children a node. Only the digest of a repaired conversation has to see its turns in order: there one
task streams over them, with one batch in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_numbers, scratch

BLOCK = 4096
CHILDREN = 512
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

# States: nothing yet, after system, after user, after assistant. NEXT: after the turn that must come next.
NEXT = np.array([2, 2, 3, 2])
# Where a kept row leads, by the class of its role (system, user, assistant, other); -1: not allowed.
KEPT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
# Costs to go at the end of a conversation: what must still be put in.
AT_END = [0, 2 * INSERT, INSERT, 0]
NEVER = 1 << 40
LABELS = "DIKR"
NOT_BLANK = r"[^\x20\x09-\x0D]"
# The summary of a conversation without rows.
NOTHING_LEFT = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0) | {
    "audit": "",
    "repaired_sha256": hashlib.sha256(b"").hexdigest(),
}


def damage(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) of `turns`, a part of them damaged by the crc32 of `conv_id:turn`.

    Of 20 remainders, 0 drops the row, 1 empties its text, 2 takes `.`, `!` and `?` out of it, 3 repeats the row
    and 4 makes it a user's. A null in any column counts as one space in the key and in role and text.
    """
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.encode(F.concat_ws(":", *shown), "UTF-8")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return (
        turns.select(
            "conv_id",
            "turn",
            F.when(kind == 4, "user").otherwise(role).alias("role"),
            F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
            F.explode(F.array_repeat(F.lit(0), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1))).alias("copy"),
        )
        .drop("copy")
    )


def _matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on `keys`, a null conv_id being a conversation like any other."""
    renamed = right.select(*[F.col(c).alias(f"_{c}" if c in keys else c) for c in right.columns])
    same = [left[k].eqNullSafe(renamed[f"_{k}"]) if k == "conv_id" else left[k] == renamed[f"_{k}"] for k in keys]
    joined = left.join(renamed, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_{k}" for k in keys])


# Work on the rows of a batch of blocks. `codes` holds 4 * class of role + fault for each row.


def costs_before(after: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Costs to go before one row of each block from those after it, both of shape (blocks, columns, 4)."""
    kind, fault = codes // 4, codes % 4
    more = np.where(fault == 1, TRUNCATED, np.where(fault >= 2, NEVER, 0))[:, None, None]
    place = KEPT[kind]
    kept = np.take_along_axis(after, np.broadcast_to(np.maximum(place, 0)[:, None, :], after.shape), 2)
    kept = kept + np.where(place < 0, NEVER, 0)[:, None, :]
    stays = np.minimum(kept, after[:, :, NEXT] + REROLE) + more
    cost = np.minimum(stays, after + DELETE)
    return np.minimum(cost, np.minimum(cost[:, :, NEXT] + INSERT, cost[:, :, NEXT[NEXT]] + 2 * INSERT))


def costs_to_go(codes: np.ndarray, offsets: np.ndarray, ends: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Costs at the start of each block from those at its end, shape (blocks, columns, 4), and if asked those before each row."""
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    now, last = ends[order].copy(), offsets[1:][order] - 1
    rows = np.zeros((len(codes), 4), np.int64) if keep else None
    for back in range(int(lengths.max(initial=0))):
        n = int(np.searchsorted(-lengths[order], -back, "left"))  # blocks with more than `back` rows
        at = last[:n] - back
        now[:n] = costs_before(now[:n], codes[at])
        if keep:
            rows[at] = now[:n, 0]
    out = np.empty_like(now)
    out[order] = now
    return out, rows


@dataclass
class Ranked:
    """Nodes row * 4 + state, then block * 4 + state for the ends of the blocks, from `first_end` on."""

    rank: np.ndarray
    labels: np.ndarray
    pointers: list[np.ndarray]
    first_end: int


def ranked_paths(codes: np.ndarray, offsets: np.ndarray, ends: np.ndarray) -> tuple[Ranked, np.ndarray]:
    """Nodes ranked by their least optimal audits, with a pointer for each power of two; costs at the starts of the blocks.

    `ends` has the costs to go at the end of each block, shape (blocks, 4).
    """
    starts, before = costs_to_go(codes, offsets, ends[:, None, :], True)
    rows, blocks = len(codes), len(offsets) - 1
    first_end = 4 * rows
    is_last = np.zeros(rows, bool)
    is_last[offsets[1:] - 1] = True
    block_of = np.repeat(np.arange(blocks), np.diff(offsets))
    after = np.where(is_last[:, None], ends[block_of], np.roll(before, -1, axis=0))
    base = np.where(is_last, first_end + 4 * block_of, 4 * np.arange(1, rows + 1))[:, None]
    kind, fault = codes // 4, codes % 4
    more = np.where(fault == 1, TRUNCATED, np.where(fault >= 2, NEVER, 0))[:, None]
    place = KEPT[kind]
    states = np.arange(4)
    own = 4 * np.arange(rows)[:, None]
    # In the order of the initials: (cost of the arc and behind it, node it leads to).
    arcs = (
        (after + DELETE, base + states),
        (before[:, NEXT] + INSERT, own + NEXT),
        (np.take_along_axis(after, np.maximum(place, 0), 1) + more + np.where(place < 0, NEVER, 0), base + np.maximum(place, 0)),
        (after[:, NEXT] + REROLE + more, base + NEXT),
    )
    labels = np.zeros(first_end + 4 * blocks, np.int64)
    pointer = np.arange(len(labels))
    for initial in reversed(range(4)):  # the least initial is written last
        cost, leads_to = arcs[initial]
        optimal = np.flatnonzero((cost == before).ravel())
        labels[optimal] = initial + 1
        pointer[optimal] = np.broadcast_to(leads_to, (rows, 4)).ravel()[optimal]
    rank, pointers = labels, [pointer]
    while (pointer < first_end).any():
        pair = rank * (int(rank.max()) + 1) + rank[pointer]
        rank = np.unique(pair, return_inverse=True)[1].reshape(-1)
        pointer = pointer[pointer]
        pointers.append(pointer)
    return Ranked(rank, labels, pointers, first_end), starts[:, 0]


def least_path(ranked: Ranked, nodes: np.ndarray) -> np.ndarray:
    """The nodes of the least paths that start on `nodes`, path after path, without the ends of blocks."""
    for pointer in reversed(ranked.pointers):
        both = np.empty(2 * len(nodes), np.int64)
        both[0::2], both[1::2] = nodes, pointer[nodes]
        nodes = both[both < ranked.first_end]
    return nodes


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64), offsets - offsets[0]


def _vectors(column: pa.Array) -> np.ndarray:
    return _lists(column)[0].reshape(len(column), -1)


# Trees over the blocks of a conversation. An element is a list of whole numbers, as is what is handed down.


def matrix_after(first: list[int], second: list[int]) -> list[int]:
    """The matrix of two neighbouring runs of rows; entry 4 * i + j is the cost from state i to state j."""
    a, b = np.array(first).reshape(4, 4), np.array(second).reshape(4, 4)
    return np.minimum((a[:, :, None] + b[None]).min(1), NEVER).ravel().tolist()


def costs_through(matrix: list[int], ends: list[int]) -> list[int]:
    return (np.array(matrix).reshape(4, 4) + np.array(ends)).min(1).tolist()


def states_after(first: list[int], second: list[int]) -> list[int]:
    return [second[s] for s in first]


def state_through(states: list[int], start: list[int]) -> list[int]:
    return [states[start[0]]]


def handed_down(items: DataFrame, blocks: int, join: Callable, through: Callable, start: list[int], backwards: bool) -> DataFrame:
    """What reaches each block (conv_id, block, given) if `start` enters its conversation at one side.

    `items`: conv_id, block (less than `blocks`), element. Elements are joined up the tree, then what is given
    goes down it through each child in turn; `backwards` from the last child on.
    """
    child = F.struct(F.col("block").alias("block"), F.col("element").alias("element"))

    def gathered(level: DataFrame) -> DataFrame:
        parent = F.floor(F.col("block") / CHILDREN).cast("long")
        return level.groupBy("conv_id", parent.alias("parent")).agg(F.sort_array(F.collect_list(child)).alias("children"))

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for children in batch.column(2).to_pylist():
                element = children[0]["element"]
                for c in children[1:]:
                    element = join(element, c["element"])
                found.append(element)
            columns = [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "block", "element"])

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, reached, owners = [], [], []
            for i, (children, given) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for c in reversed(children) if backwards else children:
                    owners.append(i)
                    places.append(c["block"])
                    reached.append(given)
                    given = through(c["element"], given)
            columns = [batch.column(0).take(pa.array(owners, pa.int64())), pa.array(places, pa.int64()), pa.array(reached, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "block", "given"])

    levels = []
    while True:
        levels.append(scratch(gathered(items), "repair-tree"))
        blocks = -(-blocks // CHILDREN)
        if blocks <= 1:
            break
        items = levels[-1].mapInArrow(up, "conv_id bigint, block bigint, element array<bigint>")
    given = levels[-1].select("conv_id", F.col("parent").alias("block"), F.array(*map(F.lit, start)).cast("array<bigint>").alias("given"))
    for level in reversed(levels):
        met = _matched(level.withColumnRenamed("parent", "block"), given, ["conv_id", "block"])
        given = met.select("conv_id", "children", "given").mapInArrow(down, "conv_id bigint, block bigint, given array<bigint>")
    return given


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


@dataclass(frozen=True)
class Repair:
    """Numbered rows, their blocks with edits, and what was counted for each conversation."""

    rows: DataFrame
    edits: DataFrame
    counts: DataFrame

    def _in_order(self, work: Callable, schema: str) -> DataFrame:
        """`work` over the rows in order, each block's edits before its rows, whole conversations in one task."""
        texts = self.rows.select("conv_id", "at", F.lit(1).alias("kind"), "turn", "role", "text", F.lit(None).cast("binary").alias("edits"), F.lit(0).cast("long").alias("spent"))
        edits = self.edits.select("conv_id", "at", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "edits", "spent")
        both = texts.unionByName(edits).repartition("conv_id")
        return both.sortWithinPartitions("conv_id", "at", "kind").mapInArrow(work, schema)

    def turns(self) -> DataFrame:
        """conv_id, position (from 0), role, text, edit (K, R, I) and turn of every repaired turn."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for event, found in _followed(batches):
                if event == "batch" and found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names
                    )

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
        names = ["conv_id", "position", "role", "text", "edit", "turn"]
        return self._in_order(work, "conv_id bigint, position bigint, role string, text string, edit string, turn bigint")

    def summary(self) -> DataFrame:
        """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done: list[tuple] = []
            for event, found in _followed(batches):
                if event == "end":
                    done.append(found)
                elif done:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names
                    )
                    done = []

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["conv_id", "cost", "audit", "repaired_sha256"]
        ended = self._in_order(work, "conv_id bigint, cost bigint, audit string, repaired_sha256 string")
        return _matched(self.counts, ended, ["conv_id"]).select(
            "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
        )


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, object]]:
    """Apply the edits to sorted rows: ("end", summary) after each conversation, ("batch", turns) after each batch.

    The state between rows is one conversation's: its last role, digest and audit.
    """
    nobody = object()
    conversation, role, digest, audit, cost, position = nobody, None, None, None, 0, 0
    edits, at = b"", 0
    turns: list[tuple] = []

    def put(new_role: str, text: str, edit: str, turn: int | None) -> None:
        nonlocal role, position
        digest.update(f"{chr(10) if position else ''}{new_role}:{text}".encode())
        turns.append((conversation, position, new_role, text, edit, turn))
        role, position = new_role, position + 1

    def expected() -> str:
        return "assistant" if role is not None and role[:1] == "u" else "user"

    def ended() -> tuple:
        nonlocal cost
        while role is not None and role[:1] != "a":
            audit.append(ord("I"))
            cost += INSERT
            put(expected(), "", "I", None)
        return conversation, cost, audit.decode(), digest.hexdigest()

    for batch in batches:
        for conv, _, kind, turn, own_role, text, block, spent in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if conversation is nobody or conv != conversation:
                if conversation is not nobody:
                    yield "end", ended()
                conversation, role, digest, audit, cost, position = conv, None, hashlib.sha256(), bytearray(), 0, 0
            if kind == 0:
                edits, at, cost = block, 0, cost + spent
                continue
            inserts, label = divmod(edits[at], 4)
            at += 1
            for _ in range(inserts):
                audit.append(ord("I"))
                put(expected(), "", "I", None)
            initial = LABELS[label]
            audit.append(ord(initial))
            if initial == "K":
                put(own_role, text, "K", turn)
            elif initial == "R":
                put(expected(), text, "R", turn)
        yield "batch", turns
        turns = []
    if conversation is not nobody:
        yield "end", ended()
        yield "batch", turns


def repair_conversations(turns: DataFrame) -> Repair:
    """Faults and cheapest edits of all conversations of `turns` (conv_id, turn, role, text; other columns are left out).

    Rows of a conversation are ordered by turn, a null turn first, then role, then text. A null role or text
    counts as one space, a null conv_id is a conversation. Rows that repeat are copies of the first. Texts of any
    length and conversations of any number of rows are worked on whole; an empty table gives empty results. The
    audit of a conversation is one text, so it has to fit a cell.
    """
    rows = turns.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    # The last key parts equal rows, however many there are, over the sorted ranges.
    rows = rows.withColumn("tail", F.monotonically_increasing_id())
    rows, total = row_numbers(rows, ["conv_id", "turn", "role", "text", "tail"], "at")
    rows = rows.drop("tail")

    text = F.col("text")
    judged = rows.select(
        "conv_id",
        "at",
        "turn",
        _initial(F.col("role")).alias("kind"),
        (~text.rlike(NOT_BLANK)).alias("blank"),
        (~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("open"),
        F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", text), 256).alias("content"),
    )
    firsts = judged.filter(~F.col("blank")).groupBy("conv_id", "content").agg(F.min("at").alias("at"))
    firsts = firsts.select("at", F.lit(True).alias("is_first"))
    fault = F.when(F.col("blank"), 2).when(F.col("is_first").isNull(), 3).when(F.col("open"), 1).otherwise(0)
    coded = scratch(
        judged.join(firsts, "at", "left").select("conv_id", "at", "turn", (F.col("kind") * 4 + fault).alias("code")),
        "repair-codes",
    )
    block = F.floor(F.col("at") / BLOCK).cast("long").alias("block")
    gathered = coded.groupBy("conv_id", block).agg(F.sort_array(F.collect_list(F.struct("at", "code"))).alias("rows"))
    blocks = scratch(
        gathered.select("conv_id", "block", F.col("rows")[0]["at"].alias("at"), F.transform("rows", lambda r: r["code"]).alias("codes")),
        "repair-blocks",
    )
    n_blocks = total // BLOCK + 1
    if n_blocks > 1:
        several = blocks.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        multi = scratch(_matched(blocks, several.select("conv_id"), ["conv_id"], "left_semi"), "repair-long")
        costs = handed_down(multi.mapInArrow(_matrices, "conv_id bigint, block bigint, element array<bigint>"), n_blocks, matrix_after, costs_through, AT_END, True)
        costed = scratch(_matched(multi, costs, ["conv_id", "block"]).select("conv_id", "block", "codes", F.col("given").alias("ends")), "repair-ends")
        states = handed_down(costed.mapInArrow(_states, "conv_id bigint, block bigint, element array<bigint>"), n_blocks, states_after, state_through, [0], False)
        known = _matched(costed.select("conv_id", "block", "ends"), states, ["conv_id", "block"])
        blocks_known = _matched(blocks, known, ["conv_id", "block"], "left")
    else:
        blocks_known = blocks.withColumn("ends", F.lit(None)).withColumn("given", F.lit(None))
    ready = blocks_known.select(
        "conv_id",
        "at",
        "codes",
        F.coalesce(F.col("ends").cast("array<bigint>"), F.array(*map(F.lit, AT_END)).cast("array<bigint>")).alias("ends"),
        F.coalesce(F.col("given").cast("array<bigint>"), F.array(F.lit(0).cast("bigint"))).alias("given"),
    )
    edits = ready.mapInArrow(_edits, "conv_id bigint, at bigint, edits binary, spent bigint")

    def of_fault(number: int) -> Column:
        return F.count(F.when(F.col("code") % 4 == number, 1))

    tallied = coded.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        of_fault(2).alias("blank"),
        of_fault(3).alias("duplicate"),
        of_fault(1).alias("truncated"),
    )
    counts = _matched(tallied, _illegal(blocks), ["conv_id"])
    return Repair(rows, edits, counts)


def _illegal(blocks: DataFrame) -> DataFrame:
    """conv_id, illegal: neighbouring roles other than system-user, user-assistant, assistant-user."""

    def bad(before: Column, after: Column) -> Column:
        return ~(F.floor(before / 4) * 4 + F.floor(after / 4)).isin(1, 6, 9)

    pairs = F.zip_with(F.slice("codes", 1, F.size("codes") - 1), F.slice("codes", 2, F.size("codes") - 1), bad)
    inside = F.size(F.filter(pairs, lambda p: p)).cast("long")
    found = blocks.select("conv_id", "block", inside.alias("inside"), F.col("codes")[0].alias("first"), F.element_at("codes", -1).alias("last"))
    # A block and the one after it meet under one number.
    edges = found.select("conv_id", F.explode(F.array(F.struct(F.col("block").alias("edge"), F.lit(None).cast("int").alias("before"), F.col("first").alias("after")), F.struct((F.col("block") + 1).alias("edge"), F.col("last").alias("before"), F.lit(None).cast("int").alias("after")))).alias("e"))
    met = edges.groupBy("conv_id", "e.edge").agg(F.max("e.before").alias("before"), F.max("e.after").alias("after"))
    crossing = met.filter("before is not null and after is not null").select("conv_id", bad(F.col("before"), F.col("after")).cast("long").alias("inside"))
    return found.select("conv_id", "inside").unionByName(crossing).groupBy("conv_id").agg(F.sum("inside").alias("illegal"))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, block, costs between each state at the start and each at the end."""
    for batch in batches:
        codes, offsets = _lists(batch.column("codes"))
        unit = np.where(np.eye(4, dtype=bool), 0, NEVER).astype(np.int64)
        starts, _ = costs_to_go(codes, offsets, np.repeat(unit[None], batch.num_rows, 0), False)
        flat = np.minimum(starts.transpose(0, 2, 1), NEVER).reshape(batch.num_rows, 16).tolist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("block"), pa.array(flat, pa.list_(pa.int64()))],
            names=["conv_id", "block", "element"],
        )


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, block, the state at the end of the least path from each state at the start."""
    for batch in batches:
        codes, offsets = _lists(batch.column("codes"))
        ranked, _ = ranked_paths(codes, offsets, _vectors(batch.column("ends")))
        ends = ranked.pointers[-1][4 * offsets[:-1, None] + np.arange(4)] - ranked.first_end
        flat = (ends - 4 * np.arange(batch.num_rows)[:, None]).tolist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("block"), pa.array(flat, pa.list_(pa.int64()))],
            names=["conv_id", "block", "element"],
        )


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, at, edits (a byte a row: 4 * turns put in before it + place of its initial), cost of the block's edits."""
    for batch in batches:
        if not batch.num_rows:
            continue
        codes, offsets = _lists(batch.column("codes"))
        ends, given = _vectors(batch.column("ends")), _vectors(batch.column("given"))[:, 0]
        ranked, starts = ranked_paths(codes, offsets, ends)
        first = 4 * offsets[:-1] + given
        nodes = least_path(ranked, first)
        per_row = np.bincount(nodes // 4, minlength=len(codes))  # its inserts and its own edit
        own = ranked.labels[nodes[np.cumsum(per_row) - 1]] - 1
        packed = (4 * (per_row - 1) + own).astype(np.uint8).tobytes()
        reached = ranked.pointers[-1][first] - ranked.first_end - 4 * np.arange(len(first))
        at = np.arange(len(first))
        spent = starts[at, given] - ends[at, reached]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conv_id"),
                batch.column("at"),
                pa.array([packed[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary()),
                pa.array(spent, pa.int64()),
            ],
            names=["conv_id", "at", "edits", "spent"],
        )
