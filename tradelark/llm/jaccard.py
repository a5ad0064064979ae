"""Similarity join of word-shingle sets with a token-group matrix.

Equal sets are one node. Nodes that may be similar share one of their rarest shingles (as
many as a partner may lack, plus one), and nodes that share one within reach of their
sizes form a family; no link leaves a family. Within a family similar nodes are put into
groups, and the token-group matrix says which groups hold a shingle. The matrix bounds
the overlap of a node with all members of a group at once; only groups whose bound
qualifies are opened and their members counted exactly. Groups that the node is already
connected with need not be opened.

In a large corpus unlike nodes share rare shingles by chance, and chains of them would grow into
families without bound. The links of a family too large for one task are therefore looked
at again: pairs of its nodes that share a rare shingle stay linked if their spreads allow
it. A spread counts a node's shingles by classes of their hash; two spreads differ by no
more than the sets do, so that no similar pair is parted.

A family still too large for one task is dealt into parts. Parts are joined through hubs of
their largest components; then all nodes outside the family's largest component, in blocks
of the size of a part, meet every part, so that no link is lost; nodes that are connected by
then are not compared again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradelark.llm.graph import components
from tradelark.llm.words import mixed, shingle_sets
from tradelark.plans.staging import lasting, staged, workspace

# One shingle in SAMPLED is counted over all documents; counts are kept in so many cells, which
# show this at most.
SAMPLED, CELL_BITS, MOST_COUNT = 4, 22, 65_000
# Members of a group at most, and shingles that the nodes of a part hold together.
GROUP, PART = 64, 1 << 21
# Texts worked on at once.
TEXTS = 512
# Nodes of a large family that share a rare shingle are compared pair by pair up to so many, and
# classes of a spread, as powers of two: of the smallest sets and of the largest. Classes compared at once.
PAIRED, LEAST_CLASSES, MOST_CLASSES = 32, 4, 16
CLASSES = 1 << 20


def _node(tokens: np.ndarray) -> int:
    """A number that stands for a set of shingles."""
    total = mixed(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))
    return int(mixed(np.array([total], np.uint64)).view(np.int64)[0])


def _slices(batches: Iterator[pa.RecordBatch], size: int = TEXTS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _counted(tokens: np.ndarray) -> np.ndarray:
    return tokens % np.uint64(SAMPLED) == 0


def _frequencies(docs: DataFrame, k: int) -> np.ndarray:
    """Per cell, in how many documents its counted shingles are that several documents have.

    Any fixed order of shingles finds all links. This one puts counted shingles first, those of
    a single document before shared ones, and the most frequent behind all others: what many
    documents share says little about their similarity and would tie unlike ones together.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            tokens = np.concatenate(shingle_sets(batch.column("text").to_pylist(), k))
            upper = (tokens[_counted(tokens)] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.record_batch({"upper": pa.array(upper)})

    shared = docs.select("text").mapInArrow(emit, "upper int").groupBy("upper").count().where("count > 1")
    cell = F.shiftrightunsigned(F.col("upper"), 32 - CELL_BITS)
    found = shared.groupBy(cell.alias("cell")).agg(F.least(F.sum("count"), F.lit(MOST_COUNT)).cast("int").alias("n")).toArrow()
    total = np.zeros(1 << CELL_BITS, dtype=np.uint16)
    total[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return total


def _standing(tokens: np.ndarray, total: np.ndarray, common: int) -> np.ndarray:
    """Where shingles stand in the order, the rarest first; ``common`` is for those not counted."""
    counts = total[(tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
    return np.where(_counted(tokens), counts, np.uint16(common))


def _spread(tokens: np.ndarray) -> bytes:
    """How many shingles of a set are in each class of their hashes, up to 255; about four on average."""
    bits = min(max((len(tokens) // 4).bit_length(), LEAST_CLASSES), MOST_CLASSES)
    classes = (tokens >> np.uint64(16) & np.uint64((1 << bits) - 1)).astype(np.int64)
    return np.minimum(np.bincount(classes, minlength=1 << bits), 255).astype(np.uint8).tobytes()


def spreads_apart(one: pa.Array, two: pa.Array) -> np.ndarray:
    """By how much the spreads of each pair of sets differ: at most by the shingles that only one of both has."""
    result = np.zeros(len(one), dtype=np.int64)
    sizes = np.stack([pc.binary_length(side).to_numpy(zero_copy_only=False) for side in (one, two)])
    for pair in np.unique(sizes, axis=1).T:
        at = np.flatnonzero((sizes == pair[:, None]).all(axis=0))
        few = int(pair.min())
        for some in np.array_split(at, -(-len(at) * int(pair.max()) // CLASSES)):
            # The classes of the finer spread that make one of the other's are added up.
            sides = [
                np.frombuffer(b"".join(side.take(pa.array(some)).to_pylist()), np.uint8).reshape(len(some), -1, few).sum(axis=1, dtype=np.int32)
                for side in (one, two)
            ]
            result[some] = np.abs(np.minimum(sides[0], 255) - np.minimum(sides[1], 255)).sum(axis=1)
    return result


def shingled(docs: DataFrame, k: int, pct: int) -> DataFrame:
    """doc_id, n, node, rare, spread of every row: set size, the set's number, its rarest shingles, its spread."""
    total = _frequencies(docs, k)
    # What is not counted stands behind what all but the fullest cells hold: cells also hold
    # shingles of a single document that share them with others by chance.
    common = int(np.quantile(total, 0.98)) + 1
    frequency = docs.sparkSession.sparkContext.broadcast(total)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = shingle_sets(batch.column("text").to_pylist(), k)
            rare = []
            for tokens in sets:
                n = len(tokens)
                first = np.argsort(_standing(tokens, frequency.value, common), kind="stable")[: n - -(-pct * n // 100) + 1 if n else 0]
                rare.append(tokens[first].view(np.int64))
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"),
                "n": pa.array([len(tokens) for tokens in sets], pa.int64()),
                "node": pa.array([_node(tokens) for tokens in sets], pa.int64()),
                "rare": pa.array(rare, pa.list_(pa.int64())),
                "spread": pa.array([_spread(tokens) for tokens in sets], pa.binary()),
            })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        work, "doc_id long, n long, node long, rare array<long>, spread binary"
    )


def _stretched(tokens: DataFrame, pct: int) -> DataFrame:
    """Links a, b of the nodes (token, node, n) that share a token: in each stretch of sizes within reach, with its first."""
    order = Window.partitionBy("token").orderBy("n", "node")
    before = F.lag("n").over(order)
    apart = before.isNull() | (before * 100 < F.col("n") * pct)
    marked = tokens.withColumn("first", F.when(apart, F.col("node")))
    # The first node of each stretch of sizes within reach of the next.
    stretch = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hub = F.last("first", ignorenulls=True).over(stretch)
    return marked.withColumn("hub", hub).where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))


def _families(nodes: DataFrame, pct: int) -> DataFrame:
    """node, family of every node (node, n, rare) that shares a rare shingle with another."""
    links = _stretched(nodes.select("node", "n", F.explode("rare").alias("token")), pct)
    return components(staged(links.distinct(), "family-links", settle=True)).withColumnRenamed("component", "family")


def _parted(nodes: DataFrame, pct: int, paired: int) -> DataFrame:
    """node, family of the nodes (node, n, rare, spread) of large families: linked if they share a rare shingle and may be similar."""
    tokens = nodes.select("node", "n", F.explode("rare").alias("token"))
    shared = tokens.groupBy("token").count().where("count > 1")
    tokens = staged(tokens.join(shared, "token"), "shared-shingles", settle=True)
    few = tokens.where(F.col("count") <= paired)
    # Of a pair, a is the smaller set.
    one = few.select("token", F.col("node").alias("a"), F.col("n").alias("n_a"))
    two = few.select("token", F.col("node").alias("b"), F.col("n").alias("n_b"))
    within = (F.struct("n_a", "a") < F.struct("n_b", "b")) & (F.col("n_a") * 100 >= F.col("n_b") * pct)
    pairs = one.join(two, "token").where(within).select("a", "n_a", "b", "n_b").distinct()
    pairs = staged(pairs, "family-pairs", settle=True)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = spreads_apart(batch.column("spread_a"), batch.column("spread_b"))
            total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            # Similar sets of so many shingles together differ by no more than this.
            yield batch.select(["a", "b"]).filter(pa.array(apart * (100 + pct) <= total * (100 - pct)))

    for side in ("a", "b"):
        spread = nodes.select(F.col("node").alias(side), F.col("spread").alias(f"spread_{side}"))
        pairs = pairs.join(spread.hint("shuffle_hash"), side)
    links = pairs.select("a", "b", "n_a", "n_b", "spread_a", "spread_b").mapInArrow(linked, "a long, b long")
    many = _stretched(tokens.where(F.col("count") > paired), pct)
    links = staged(links.unionByName(many).distinct(), "parted-links", settle=True)
    return components(links).withColumnRenamed("component", "family")


class _Forest:
    """Connected numbers 0 to n - 1."""

    def __init__(self, labels: np.ndarray):
        _, first, where = np.unique(labels, return_index=True, return_inverse=True)
        self.parent = first[where]

    def roots(self, at: np.ndarray) -> np.ndarray:
        found = self.parent[at]
        while True:
            above = self.parent[found]
            if np.array_equal(above, found):
                return found
            found = above

    def join(self, one: int, others: np.ndarray) -> None:
        roots = np.unique(self.roots(np.append(others, one)))
        self.parent[roots] = roots[0]


def connect(sets: list[np.ndarray], pct: int, labels: np.ndarray, asking: np.ndarray, group: int = GROUP) -> np.ndarray:
    """New labels 0.. of the sets: those connected already (equal label) or by links of sets in ``asking``."""
    n = np.array([len(tokens) for tokens in sets], dtype=np.int64)
    forest = _Forest(labels)
    every, tokens = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), n)
    # Similar sets next to each other: by their smallest mixed shingle, then size.
    spread = mixed(every)[tokens]
    least = np.minimum.reduceat(spread, np.cumsum(n) - n)
    order = np.lexsort((n, least))
    change = np.concatenate(([True], least[order][1:] != least[order][:-1]))
    run_start = np.maximum.accumulate(np.where(change, np.arange(len(order)), 0))
    starts = (np.arange(len(order)) - run_start) % group == 0
    group_of = np.empty(len(sets), dtype=np.int64)
    group_of[order] = np.cumsum(starts) - 1
    groups = int(group_of.max()) + 1
    by_group = np.argsort(group_of, kind="stable")
    member_start = np.searchsorted(group_of[by_group], np.arange(groups + 1))
    smallest = np.minimum.reduceat(n[by_group], member_start[:-1])
    largest = np.maximum.reduceat(n[by_group], member_start[:-1])
    # The token-group matrix: the groups of each token, one after the other.
    cells = np.unique(tokens * groups + group_of[owner])
    holding = cells % groups
    token_start = np.searchsorted(cells // groups, np.arange(len(every) + 1))
    own_start = np.append(np.cumsum(n) - n, n.sum())
    # The members' tokens, group by group: those of a group are one stretch.
    grouped = np.concatenate([tokens[own_start[x] : own_start[x + 1]] for x in by_group])
    grouped_start = np.append(0, np.cumsum(n[by_group]))
    mark = np.zeros(len(every), dtype=bool)
    for at in asking.tolist():
        mine = tokens[own_start[at] : own_start[at + 1]]
        counts = token_start[mine + 1] - token_start[mine]
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        bound = np.bincount(holding[np.repeat(token_start[mine], counts) + inside], minlength=groups)
        qualifies = (100 * bound >= pct * n[at]) & (100 * largest >= pct * n[at]) & (pct * smallest <= 100 * n[at])
        opened = np.flatnonzero(qualifies)
        mark[mine] = True
        for number in opened[np.argsort(-bound[opened], kind="stable")]:
            first, last = member_start[number], member_start[number + 1]
            members = by_group[first:last]
            apart = forest.roots(members) != forest.roots(np.array([at]))[0]
            if not apart.any():
                continue
            start = grouped_start[first]
            shared = np.add.reduceat(mark[grouped[start : grouped_start[last]]].astype(np.int64), grouped_start[first:last] - start)
            linked = members[apart & (100 * shared >= pct * (n[at] + n[members] - shared))]
            if len(linked):
                forest.join(at, linked)
        mark[mine] = False
    return forest.roots(np.arange(len(sets)))


@dataclass
class _Held:
    """What is kept of some rows of a part: their sets, not their texts."""

    node: np.ndarray
    sets: list[np.ndarray]
    label: np.ndarray
    asking: np.ndarray


def _held(rows: pa.RecordBatch, k: int) -> Iterator[_Held]:
    """The rows whose text has the wanted set (a doc_id may stand for several texts), TEXTS at a time."""
    for at in range(0, rows.num_rows, TEXTS):
        some = rows.slice(at, TEXTS)
        node = some.column("node").to_numpy()
        sets = shingle_sets(some.column("text").to_pylist(), k)
        right = np.flatnonzero(np.array([_node(tokens) for tokens in sets]) == node)
        labels, asking = np.zeros(len(node), np.int64), np.ones(len(node), bool)
        if "label" in some.schema.names:
            labels, asking = some.column("label").to_numpy(), some.column("asking").to_numpy(zero_copy_only=False)
        yield _Held(node[right], [sets[place] for place in right], labels[right], asking[right])


def _by_part(rows: DataFrame, keys: list[str], schema: str, k: int, work: Callable[[list[_Held]], pa.RecordBatch]) -> DataFrame:
    """Apply ``work`` to the sets of each key; the texts of a key stream through one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[_Held] = []
        current = None
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.stack([batch.column(key).to_numpy() for key in keys])
            edges = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1
            for first, last in zip([0, *edges], [*edges, batch.num_rows]):
                key = tuple(values[:, first].tolist())
                if key != current and held:
                    yield work(held)
                    held = []
                current = key
                held.extend(_held(batch.slice(first, last - first), k))
        if held:
            yield work(held)

    # Of a node's rows in a part, the one that asks comes first.
    order = [*keys, "node", *([F.desc("asking")] if "asking" in rows.columns else [])]
    return rows.repartition(*keys).sortWithinPartitions(*order).mapInArrow(run, schema)


def _labelled(pct: int, group: int, own_labels: bool = False) -> Callable[[list[_Held]], pa.RecordBatch]:
    """node, label: label is the smallest node each is connected with.

    With ``own_labels`` nodes of one label are connected already, and only asking ones look for links.
    """

    def work(held: list[_Held]) -> pa.RecordBatch:
        node = np.concatenate([some.node for some in held])
        sets = [tokens for some in held for tokens in some.sets]
        # Of a node's rows the first one counts: if any asks, that does.
        chosen = np.sort(np.unique(node, return_index=True)[1])
        node, sets = node[chosen], [sets[at] for at in chosen]
        labels, asking = np.arange(len(sets)), np.arange(len(sets))
        if own_labels:
            labels = np.concatenate([some.label for some in held])[chosen]
            asking = np.flatnonzero(np.concatenate([some.asking for some in held])[chosen])
        found = connect(sets, pct, labels, asking, group) if sets else np.zeros(0, np.int64)
        least = np.full(len(sets), np.iinfo(np.int64).max)
        np.minimum.at(least, found, node)
        return pa.record_batch({"node": pa.array(node), "label": pa.array(least[found])})

    return work


def jaccard_components(
    docs: DataFrame, *, k: int = 3, pct: int = 90, group: int = GROUP, part: int = PART, hubs: int = 8, paired: int = PAIRED
) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    Rows link when ``pct`` percent of the union of their shingle sets is shared. component_id
    is the smallest doc_id reachable by links, the own included. A null text or one without
    words has no shingles and is linked with nothing. Repeated rows are rows of one set; rows
    that share an id but not a text are separate rows. Other columns are ignored.
    """
    with workspace(docs.sparkSession):
        return lasting(_joined(docs, k, pct, group, part, hubs, paired), "jaccard-components")


def _joined(docs: DataFrame, k: int, pct: int, group: int, part: int, hubs: int, paired: int) -> DataFrame:
    rows = staged(shingled(docs, k, pct), "shingled", settle=True)
    nodes = rows.where("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.min_by("rare", F.coalesce("doc_id", F.lit(0))).alias("rare")
    )
    families = staged(_families(nodes, pct), "families", settle=True)
    least = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    known = staged(families.join(least, "node"), "family-nodes")
    large = known.groupBy("family").agg(F.sum("n").alias("n")).where(F.col("n") > part).select("family")
    if not large.isEmpty():
        inside = known.join(large, "family", "left_semi").select("node")
        inside = rows.where("n > 0").join(inside, "node", "left_semi").dropDuplicates(["node"])
        inside = staged(inside.select("node", "n", "rare", "spread"), "large-family-nodes", settle=True)
        parted = _parted(inside, pct, paired).join(least, "node")
        known = staged(known.join(large, "family", "left_anti").unionByName(parted), "parted-nodes")
    sizes = known.groupBy("family").agg(F.ceil(F.sum("n") / part).alias("parts"))
    dealt = known.join(sizes, "family").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    wanted = dealt.select("node", "n", "family", "parts", "part", F.col("doc_id").alias("wanted_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    # The wanted ids are the small side: hashed, so that no text is sorted.
    same = F.col("doc_id").eqNullSafe(F.col("wanted_id"))
    read = texts.join(wanted.hint("shuffle_hash"), same).select("node", "n", "family", "parts", "part", "text")
    read = staged(read, "family-texts", settle=True)
    schema = "node long, label long"
    local = staged(_by_part(read, ["family", "part"], schema, k, _labelled(pct, group)), "part-labels", settle=True)
    labels = local
    if not sizes.where("parts > 1").isEmpty():
        labels = _across_parts(read, local, pct, k, group, part, hubs)
    # Every row of a node takes the smallest doc_id of the node's component.
    named = rows.where("n > 0").select("node", "doc_id").join(labels, "node", "left")
    found = named.withColumn("label", F.coalesce("label", "node"))
    smallest = found.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    by_node = labels.join(smallest, "label").select("node", "component_id")
    own = least.join(labels, "node", "left_anti").select("node", F.col("doc_id").alias("component_id"))
    linked = rows.where("n > 0").join(by_node.unionByName(own), "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def _across_parts(
    read: DataFrame, local: DataFrame, pct: int, k: int, group: int, part: int, hubs: int
) -> DataFrame:
    """node, label over whole families that were dealt into parts."""
    schema = "node long, label long"
    texts = read.where("parts > 1")
    held = staged(texts.join(local, "node"), "large-families", settle=True)
    # Hubs: a few nodes of the largest components of each part.
    size = F.count(F.lit(1)).over(Window.partitionBy("family", "part", "label"))
    by_size = Window.partitionBy("family", "part").orderBy(F.desc("size"), "label", "node")
    ranked = held.select("node", "family", "part", "label").withColumn("size", size).withColumn("rank", F.row_number().over(by_size))
    chosen = ranked.where(F.col("rank") <= hubs).select("node")
    meeting = held.join(chosen, "node", "left_semi").withColumns({"part": F.lit(0).cast("long"), "asking": F.lit(True)})
    met = _by_part(meeting, ["family", "part"], schema, k, _labelled(pct, group, own_labels=True))
    joined = met.select(F.col("node"), F.col("label").alias("other")).join(local, "node")
    first = staged(_merged(local, joined), "hub-labels")
    # Blocks of the nodes outside their family's largest component meet all parts of the family.
    now = held.drop("label").join(first, "node")
    sizes = now.groupBy("family", "label").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n"))
    main = F.max_by("label", F.struct("size", -F.col("label"))).alias("main")
    outside = F.sum("n") - F.max_by("n", F.struct("size", -F.col("label")))
    largest = sizes.groupBy("family").agg(main, F.ceil(outside / part).alias("blocks")).where("blocks > 0")
    marked = now.join(largest, "family")
    # The list of numbers from 0 on.
    numbers = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    block = F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks"))
    visiting = marked.where("label <> main").withColumn("block", block).withColumn("part", numbers("parts"))
    staying = marked.withColumn("block", numbers("blocks"))
    everyone = staying.withColumn("asking", F.lit(False)).unionByName(visiting.withColumn("asking", F.lit(True)))
    checked = _by_part(
        everyone.select("family", "part", "block", "node", "text", "label", "asking"),
        ["family", "part", "block"], schema, k, _labelled(pct, group, own_labels=True),
    )
    found = checked.select("node", F.col("label").alias("other")).distinct().join(first, "node")
    return staged(_merged(first, found), "across-labels", settle=True)


def _merged(labels: DataFrame, found: DataFrame) -> DataFrame:
    """Labels after joining those whose nodes (label) were found connected with another node (other)."""
    other = labels.select(F.col("node").alias("other"), F.col("label").alias("b"))
    links = found.join(other, "other").select(F.col("label").alias("a"), "b").where("a <> b").distinct()
    named = components(links).select(F.col("node").alias("label"), "component")
    return labels.join(named, "label", "left").select("node", F.coalesce("component", "label").alias("label"))
