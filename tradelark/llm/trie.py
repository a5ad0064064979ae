"""Prefix trie of conversations: which share their first turns, and what sharing them saves.

A turn is known by the digest of its role and text (120 bits), a conversation by the
digests of its turns one after the other. Equal conversations are one row from there on.
Rows are dealt into shards by ranges of these sequences, so that a shard's trie is a
stretch of the whole one.

In a shard the turn ids stand in a matrix with one row per sequence, padded behind its
end and worked on in bands of columns. ``numpy.lexsort`` brings the rows into order, the
change masks of neighbouring rows are OR-accumulated over the columns, and where a mask is
set a node starts; ``reduceat`` sums the rows of every node, depth by depth.

Only nodes above a shard's first or last row can go on in another shard. These boundary
nodes are left open: they carry what their finished children sum to, and neighbouring
shards are recombined, some at a time, until nothing is open.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelark.plans.staging import lasting, staged, workspace

# Turns that a shard holds on average, and neighbouring shards recombined at once.
SHARD_TURNS, FAN = 1 << 18, 64
# Columns of the matrix that are sorted at once.
BAND = 8
# Bytes of a turn in a sequence: 01, 15 bytes of digest, code points as 8 bytes.
TURN = 24
# Bytes of conversation ids that are hashed at once.
IDS_PIECE = 1 << 16

NO_IDS = hashlib.sha256(b"").hexdigest()

_NODES = (
    "unit long, open_left boolean, open_right boolean, node binary, parent binary, depth long, conv_id long, "
    "parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, points long, ends_sha256 string"
)


# ---------------------------------------------------------------- sequences of turns


def head_length(conv_id: Column, most: int) -> Column:
    """How many turns a conversation takes from its group's first one."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (most + 1)).cast("int")


def rebuilt_sequences(turns: DataFrame, *, group: int = 100, most: int = 5) -> DataFrame:
    """conv_id and sequence (binary, TURN bytes a turn) of every rebuilt conversation.

    A conversation's turns are those of ``turns`` (conv_id, turn, role, text) in the order of turn
    (null first), then role, then text. Its first turns, at most ``most`` of them by its
    id's checksum, give way to those of the conversation whose id is the multiple of ``group`` at or
    before its own; where that has fewer or is absent, fewer take their place.
    """
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("role", "text"))
    # The length of the role keeps apart what ends the role and what begins the text.
    digest = F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text).cast("binary"), 256)
    points = F.lpad(F.hex(F.length(text).cast("long")), 16, "0")
    element = F.concat(F.lit("01"), F.substring(digest, 1, 30), points)
    rows = turns.where("conv_id IS NOT NULL")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), element.alias("element"), text.alias("text"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "element")))
    convs = rows.groupBy("conv_id").agg(ordered.alias("turns"))
    pairs = F.arrays_zip(F.slice("turns", 1, F.size("turns") - 1).alias("one"), F.slice("turns", 2, F.size("turns")).alias("two"))
    tied = F.exists(
        pairs,
        lambda pair: pair["one"]["turn"].eqNullSafe(pair["two"]["turn"]) & (pair["one"]["role"] == pair["two"]["role"]) & (pair["one"]["element"] != pair["two"]["element"]),
    )
    convs = staged(convs.select("conv_id", F.col("turns.element").alias("own"), tied.alias("tied")), "trie-conversations")
    if convs.where("tied").isEmpty():
        return _with_heads(convs.select("conv_id", "own"), group, most)
    # Texts are only shuffled for conversations whose order depends on them.
    again = rows.join(convs.where("tied").select("conv_id"), "conv_id", "left_semi")
    by_text = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "element")))["element"]
    convs = convs.where("NOT tied").select("conv_id", "own").unionByName(again.groupBy("conv_id").agg(by_text.alias("own")))
    return _with_heads(convs, group, most)


def _with_heads(convs: DataFrame, group: int, most: int) -> DataFrame:
    """conv_id and sequence, after the first turns of ``convs`` (conv_id, own) are exchanged."""
    heads = convs.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, most).alias("head"))
    joined = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(heads, "base", "left")
    taken = head_length(F.col("conv_id"), most)
    rest = F.when(F.size("own") > taken, F.slice("own", taken + 1, F.greatest(F.size("own") - taken, F.lit(0))))
    whole = F.concat(*(F.coalesce(one, F.array().cast("array<string>")) for one in (F.slice("head", 1, taken), rest)))
    return joined.select("conv_id", F.unhex(F.array_join(whole, "")).alias("sequence"))


_STRETCH = {"key": pa.binary(), "first": pa.int64(), "n": pa.int64(), "ids": pa.string()}
_HASHED = {"key": pa.binary(), "least": pa.int64(), "n": pa.int64(), "ends_sha256": pa.string()}


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds.values())], list(kinds))


def _equal_ids(batches: Iterator[pa.RecordBatch], piece: int) -> Iterator[pa.RecordBatch]:
    """Stretches of the ids of each key, in the sorted order of the input: key, first, n, ids."""
    key, first, n, parts, held, rows = None, 0, 0, [], 0, []
    for batch in batches:
        for own, conv_id in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
            if own != key or held > piece:
                if parts:
                    rows.append((key, first, n, ",".join(parts)))
                    if len(rows) >= 4096 or held > piece:
                        yield _batch(rows, _STRETCH)
                        rows = []
                key, first, n, parts, held = own, conv_id, 0, [], 0
            text = str(conv_id)
            parts.append(text)
            n, held = n + 1, held + len(text) + 1
    if parts:
        rows.append((key, first, n, ",".join(parts)))
    if rows:
        yield _batch(rows, _STRETCH)


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, least, n, ends_sha256 from the stretches of each key in ascending order."""
    key, least, total, sha, rows = None, 0, 0, None, []
    for batch in batches:
        columns = (batch.column(name).to_pylist() for name in ("key", "first", "n", "ids"))
        for own, first, n, ids in zip(*columns):
            if own != key:
                if sha is not None:
                    rows.append((key, least, total, sha.hexdigest()))
                key, least, total, sha = own, first, 0, hashlib.sha256()
            else:
                sha.update(b",")
            total += n
            sha.update(ids.encode())
        if len(rows) >= 4096:
            yield _batch(rows, _HASHED)
            rows = []
    if sha is not None:
        rows.append((key, least, total, sha.hexdigest()))
        yield _batch(rows, _HASHED)


def distinct_sequences(rebuilt: DataFrame, *, piece: int = IDS_PIECE) -> DataFrame:
    """sequence, n, least, ends_sha256: every distinct sequence, its conversations and their digest.

    The ids of one sequence are dealt over tasks by range and written out there; only the
    hashing, which is sequential by nature, goes through them in one task, as a stream.
    """
    keyed = rebuilt.withColumn("key", F.unhex(F.substring(F.sha2("sequence", 256), 1, 32)))
    ids = keyed.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    stretches = ids.mapInArrow(partial(_equal_ids, piece=piece), "key binary, first long, n long, ids string")
    dealt = stretches.repartition("key").sortWithinPartitions("key", "first")
    hashed = dealt.mapInArrow(_hash_ids, "key binary, least long, n long, ends_sha256 string")
    return keyed.select("key", "sequence").distinct().join(hashed, "key").select("sequence", "n", "least", "ends_sha256")


# ---------------------------------------------------------------- the trie of one shard


def sorted_rows(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of distinct sequences, and how many leading turns each shares with the one before it.

    ``ids`` has two columns and one row per turn; sequence i has ``lengths[i]`` of them from ``starts[i]`` on.
    The first sequence shares -1 turns: not even the root came before it.
    """
    order = np.arange(len(lengths))
    shared = np.zeros(len(lengths), dtype=np.int64)
    slots, run = np.arange(len(lengths)), np.zeros(len(lengths), dtype=np.int64)
    column = 0
    while len(slots):
        rows = order[slots]
        place = column + np.arange(BAND)
        inside = place < lengths[rows][:, None]
        # Behind its end a row is padded with zeros, which no turn has.
        matrix = np.zeros((len(rows), BAND, 2), dtype=np.uint64)
        matrix[inside] = ids[(starts[rows][:, None] + place)[inside]]
        keys = matrix.reshape(len(rows), -1).T[::-1]
        found = np.lexsort((*keys, run))
        order[slots], matrix = rows[found], matrix[found]
        new_run = np.append(True, run[1:] != run[:-1])
        changed = np.append(np.ones((1, BAND), bool), (matrix[1:] != matrix[:-1]).any(axis=2), axis=0)
        changed = np.logical_or.accumulate(changed, axis=1)
        same = np.where(new_run, 0, (~changed).sum(axis=1))
        shared[slots] += same
        # Rows that equal a neighbour over the whole band go on.
        starts_run = new_run | (same < BAND)
        runs = np.cumsum(starts_run)
        kept = np.bincount(runs)[runs] > 1
        slots, run = slots[kept], runs[kept]
        column += BAND
    if len(shared):
        shared[0] = -1
    return order, shared


@dataclass
class Shard:
    """Distinct sequences of one shard with the number and smallest id of their conversations."""

    sequences: list[bytes]
    n: np.ndarray
    least: np.ndarray
    ends: list[str]
    nodes: dict[str, np.ndarray] = field(default_factory=dict)

    def build(self) -> None:
        """All nodes, depth by depth; those above the first or last sequence are open.

        n_children, n_leaves and saved are those of the whole subtree for the others; for the open
        ones they sum the children that are not open.
        """
        lengths = np.array([len(one) // TURN for one in self.sequences], dtype=np.int64)
        flat = np.frombuffer(b"".join(self.sequences), ">u8").reshape(-1, 3).astype(np.uint64)
        starts = np.cumsum(lengths) - lengths
        order, shared = sorted_rows(flat[:, :2], starts, lengths)
        self.order = order
        lengths, starts = lengths[order], starts[order]
        n, least, points = self.n[order], self.least[order], flat[:, 2].astype(np.int64)

        columns: dict[str, list[np.ndarray]] = {name: [] for name in ("depth", "n", "least", "points", "parent", "row", "left", "right")}
        node_of = np.zeros(len(order), dtype=np.int64)
        active, depth, before = np.arange(len(order)), 0, 0
        while len(active):
            first = np.flatnonzero(shared[active] < depth)
            rows = active[first]
            count = len(rows)
            columns["depth"].append(np.full(count, depth))
            columns["n"].append(np.add.reduceat(n[active], first))
            columns["least"].append(np.minimum.reduceat(least[active], first))
            columns["points"].append(points[starts[rows] + depth - 1] if depth else np.zeros(count, np.int64))
            columns["parent"].append(node_of[rows] if depth else np.full(count, -1))
            # The sequence that ends at a node is the first of its rows.
            columns["row"].append(np.where(lengths[rows] == depth, rows, -1))
            own = np.repeat(np.arange(before, before + count), np.diff(np.append(first, len(active))))
            node_of[active] = own
            left, right = np.zeros(count, bool), np.zeros(count, bool)
            left[0], right[-1] = active[0] == 0, active[-1] == len(order) - 1
            columns["left"].append(left)
            columns["right"].append(right)
            before += count
            depth += 1
            active = active[lengths[active] >= depth]
        node = {name: np.concatenate(parts) for name, parts in columns.items()}
        closed = ~(node["left"] | node["right"])

        children, leaves = np.zeros(before, np.int64), np.zeros(before, np.int64)
        saved = np.where(closed, (node["n"] - 1) * node["points"], 0)
        ends = np.cumsum([len(part) for part in columns["depth"]])
        for last, size in zip(ends[::-1], [len(part) for part in columns["depth"]][::-1]):
            some = np.arange(last - size, last)[closed[last - size : last]]
            leaves[some] = np.where(children[some] > 0, leaves[some], 1)
            if last > size:  # all but the root have a parent
                parent = node["parent"][some]
                np.add.at(children, parent, 1)
                np.add.at(leaves, parent, leaves[some])
                np.add.at(saved, parent, saved[some])
        self.nodes = {**node, "children": children, "leaves": leaves, "saved": saved, "closed": closed}

    def paths(self) -> dict[int, bytes]:
        """A key per open node: the digest of the turns that lead to it."""
        keys = {}
        node = self.nodes
        for side, row in (("left", self.order[0]), ("right", self.order[-1])):
            sequence, sha = self.sequences[row], hashlib.sha256()
            for number in np.flatnonzero(node[side]).tolist():
                depth = int(node["depth"][number])
                if depth:
                    sha.update(sequence[(depth - 1) * TURN : depth * TURN])
                keys[number] = sha.digest()[:16]
        return keys

    def batches(self, unit: int, size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        node, keys = self.nodes, self.paths()
        for at in range(0, len(node["n"]), size):
            some = slice(at, at + size)
            numbers = range(at, min(at + size, len(node["n"])))
            parent = node["parent"][some]
            open_parent = (parent >= 0) & ~node["closed"][parent]
            count = len(parent)
            yield pa.record_batch({
                "unit": pa.array([unit] * count, pa.int64()),
                "open_left": pa.array(node["left"][some]),
                "open_right": pa.array(node["right"][some]),
                "node": pa.array([keys.get(number) for number in numbers], pa.binary()),
                "parent": pa.array([keys[up] if open_ else None for up, open_ in zip(parent.tolist(), open_parent)], pa.binary()),
                "depth": pa.array(node["depth"][some]),
                "conv_id": pa.array(node["least"][some]),
                # An open parent's smallest member may be in another shard.
                "parent_conv_id": pa.array(node["least"][parent], mask=open_parent | (parent < 0)),
                "n_convs": pa.array(node["n"][some]),
                "n_children": pa.array(node["children"][some]),
                "n_leaves": pa.array(node["leaves"][some]),
                "saved_tokens": pa.array(node["saved"][some]),
                "points": pa.array(node["points"][some]),
                "ends_sha256": pa.array([NO_IDS if row < 0 else self.ends[self.order[row]] for row in node["row"][some].tolist()]),
            })


def _build_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [[], [], [], []]
    for batch in batches:
        for part, name in zip(parts, ("sequence", "n", "least", "ends_sha256")):
            part.extend(batch.column(name).to_pylist())
    if parts[0]:
        shard = Shard(parts[0], np.array(parts[1], np.int64), np.array(parts[2], np.int64), parts[3])
        shard.build()
        yield from shard.batches(TaskContext.get().partitionId())


# ---------------------------------------------------------------- recombination


def recombined(rows: list[dict], unit: int, last: bool) -> list[dict]:
    """Open nodes of neighbouring units, merged; what no other unit can go on with is closed."""
    first_unit, last_unit = min(row["unit"] for row in rows), max(row["unit"] for row in rows)
    merged: dict[bytes, dict] = {}
    for row in rows:
        left = row["open_left"] and row["unit"] == first_unit and not last
        right = row["open_right"] and row["unit"] == last_unit and not last
        own = merged.get(row["node"])
        if own is None:
            merged[row["node"]] = {**row, "unit": unit, "open_left": left, "open_right": right}
            continue
        for name in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
            own[name] += row[name]
        own["conv_id"] = min(own["conv_id"], row["conv_id"])
        own["open_left"], own["open_right"] = own["open_left"] or left, own["open_right"] or right
        if own["ends_sha256"] == NO_IDS:
            own["ends_sha256"] = row["ends_sha256"]
    for own in sorted(merged.values(), key=lambda one: -one["depth"]):
        if own["open_left"] or own["open_right"]:
            continue
        own["n_leaves"] = own["n_leaves"] if own["n_children"] else 1
        own["saved_tokens"] += (own["n_convs"] - 1) * own["points"]
        above = merged.get(own["parent"])
        if above is not None:
            above["n_children"] += 1
            above["n_leaves"] += own["n_leaves"]
            above["saved_tokens"] += own["saved_tokens"]
    return list(merged.values())


def _recombine(open_nodes: DataFrame, fan: int, last: bool) -> DataFrame:
    schema = open_nodes.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, list[dict]] = {}
        kinds = None
        for batch in batches:
            kinds = batch.schema
            for row in batch.to_pylist():
                groups.setdefault(row["unit"] // fan, []).append(row)
        for unit, rows in groups.items():
            yield pa.RecordBatch.from_pylist(recombined(rows, unit, last), schema=kinds)

    groups = F.floor(F.col("unit") / fan)
    return open_nodes.repartition(groups).mapInArrow(run, schema)


def prefix_trie(turns: DataFrame, *, group: int = 100, most: int = 5, shard_turns: int = SHARD_TURNS, fan: int = FAN) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations of ``turns`` (conv_id, turn, role, text).

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. Null roles and texts count as empty. Rows that share conv_id
    and turn are all turns, ordered by role and then by text; repeated rows are turns of their own. Rows without conv_id belong to no conversation. A table without conversations has no
    nodes. Other columns are ignored. The turn ids (not the texts) of one conversation must fit a task.
    """
    with workspace(turns.sparkSession):
        return lasting(_trie(turns, group, most, shard_turns, fan), "trie")


def _trie(turns: DataFrame, group: int, most: int, shard_turns: int, fan: int) -> DataFrame:
    rebuilt = staged(rebuilt_sequences(turns, group=group, most=most), "trie-rebuilt")
    sequences = staged(distinct_sequences(rebuilt), "trie-sequences")
    held = sequences.agg(F.sum(F.octet_length("sequence") + TURN).alias("bytes")).first()["bytes"] or 0
    shards = max(1, -(-held // (TURN * shard_turns)))
    nodes = staged(sequences.repartitionByRange(shards, "sequence").mapInArrow(_build_shard, _NODES), "trie-nodes", settle=True)

    closed = nodes.where("NOT (open_left OR open_right)")
    opened, units, finished = nodes.where("open_left OR open_right"), shards, []
    while True:
        units = -(-units // fan)
        step = staged(_recombine(opened, fan, units == 1), "trie-boundaries")
        finished.append(step.where("NOT (open_left OR open_right)"))
        if units == 1:
            break
        opened = step.where("open_left OR open_right")

    boundary = finished[0]
    for more in finished[1:]:
        boundary = boundary.unionByName(more)
    least = boundary.select(F.col("node").alias("parent"), F.col("conv_id").alias("open_parent"))
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    every = closed.unionByName(boundary)
    below = every.where("parent IS NOT NULL").join(least, "parent").select(*columns, F.col("open_parent").alias("parent_conv_id"))
    rest = every.where("parent IS NULL").select(*columns, "parent_conv_id")
    found = rest.unionByName(below)
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
