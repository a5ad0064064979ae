"""Histogram sort: cut a table into shards of equal bytes at exactly counted splitters.

Rows are ordered by (hash of the text, hash of the id), so equal texts are neighbours.
Each round counts the exact bytes below evenly spaced probe keys across all
partitions and narrows the interval of every boundary to the probes around its target.
A boundary is settled once the bytes below it are within the tolerance of its target.
The rows are exchanged once, after all splitters stand; the rounds read a staged
table of keys and sizes only. The driver sees one number per probe, never a row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelark.plans.staging import staged

LAW = "bytes"
# A row is put into one of so many bytes' worth of slots counted together.
SLOT_BYTES = 32 << 20


def _hashed(*columns: Column) -> Column:
    """A key of 63 bits: differences of two keys fit a long."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 1)


@dataclass
class _Boundary:
    """A splitter in the making: it lies in [low, high) of the key, then of the tie."""

    target: int
    low: int
    high: int
    below: int = 0
    key: int | None = None
    splitter: tuple[int, int] | None = field(default=None)

    def interval(self) -> tuple:
        return (-1 if self.key is None else self.key, self.low, self.high)


def _probe(keys: DataFrame, intervals: list[tuple], probes: int) -> dict[tuple[int, int], tuple[int, int, int]]:
    """Bytes, smallest and largest value between neighbouring probes of every interval."""
    where = F.lit(None).cast("int")
    step_no = F.lit(None).cast("long")
    value = F.lit(None).cast("long")
    for at, (key, low, high) in enumerate(intervals):
        column = F.col("tie") if key >= 0 else F.col("key")
        inside = (column >= F.lit(low)) & (column < F.lit(high))
        if key >= 0:
            inside = inside & (F.col("key") == F.lit(key))
        step = max(1, -(-(high - low) // probes))
        where = F.when(inside, F.lit(at)).otherwise(where)
        step_no = F.when(inside, F.expr(f"({'tie' if key >= 0 else 'key'} - {low}L) div {step}L")).otherwise(step_no)
        value = F.when(inside, column).otherwise(value)
    counted = (
        keys.select(where.alias("at"), step_no.alias("step"), value.alias("value"), "size")
        .where("at IS NOT NULL")
        .groupBy("at", "step")
        .agg(F.sum("size").alias("bytes"), F.min("value").alias("least"), F.max("value").alias("most"))
    )
    return {(row["at"], row["step"]): (row["bytes"], row["least"], row["most"]) for row in counted.collect()}


def _refine(boundary: _Boundary, steps: list[tuple[int, int, int]], tolerance: int) -> None:
    """Settle the boundary or narrow it to the filled step that holds its target."""
    below = boundary.below
    for size, least, most in steps:
        nearest = min((below, least), (below + size, most + 1), key=lambda end: abs(end[0] - boundary.target))
        last = (size, least, most) == steps[-1]
        if abs(nearest[0] - boundary.target) <= tolerance:
            at = nearest[1]
            boundary.splitter = (at, 0) if boundary.key is None else (boundary.key, at)
            return
        if below + size >= boundary.target or last:
            if least == most and boundary.key is None:
                boundary.key, boundary.low, boundary.high, boundary.below = least, 0, 1 << 62, below
                boundary.high = (1 << 63) - 1
            elif least == most:
                boundary.splitter = (boundary.key, nearest[1])
            else:
                boundary.low, boundary.high, boundary.below = least, most + 1, below
            return
        below += size


def find_splitters(keys: DataFrame, shards: int, *, tolerance: float = 0.005, probes: int = 64) -> list[tuple[int, int]]:
    """Splitters (key, tie) between shards of equal bytes; rows at or above one lie behind it.

    ``keys`` has key, tie (both 63 bits, not negative) and size. ``tolerance`` is the
    share of a shard's bytes by which a boundary may miss. Where no key comes that near,
    the nearest is taken: rows equal in key and tie are never told apart.
    """
    total, low, high = keys.agg(F.sum("size"), F.min("key"), F.max("key")).first()
    if not total:
        return [((1 << 63) - 1, 0)] * (shards - 1)
    boundaries = [_Boundary(total * number // shards, low, high + 1) for number in range(1, shards)]
    allowed = int(tolerance * total / shards)
    while open_ := [boundary for boundary in boundaries if boundary.splitter is None]:
        intervals = sorted({boundary.interval() for boundary in open_})
        counted = _probe(keys, intervals, probes)
        for boundary in open_:
            at = intervals.index(boundary.interval())
            steps = [found for (where, _), found in sorted(counted.items()) if where == at]
            _refine(boundary, steps, allowed)
    return [boundary.splitter for boundary in boundaries]


def shard_by_bytes(
    docs: DataFrame, shards: int = 8, *, text: str = "text", doc_id: str = "doc_id",
    tolerance: float = 0.005, probes: int = 64, slot_bytes: int = SLOT_BYTES,
) -> DataFrame:
    """All rows and columns of ``docs`` plus size, law, shard, slot and grown_shard.

    size is the bytes of the text plus 1; a null text has no bytes. Equal texts share a
    shard unless a boundary has to fall between them to keep the bytes equal. slot counts
    the rows of a shard from 0 without a gap. grown_shard is null: this law keeps bytes
    equal, not rows in place. Columns of ``docs`` that have a name of a new column are
    replaced. An empty table gives an empty result; repeated rows each get a slot.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    key, tie = _hashed(F.coalesce(F.col(text), F.lit(""))), _hashed(F.col(doc_id).cast("string"))
    keys = staged(docs.select(key.alias("key"), tie.alias("tie"), size.alias("size")), "shard-keys")
    splitters = find_splitters(keys, shards, tolerance=tolerance, probes=probes)
    total = keys.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-total // (shards * slot_bytes)))

    def shard(of: Column, then: Column) -> Column:
        behind = [((of > F.lit(k)) | ((of == F.lit(k)) & (then >= F.lit(t)))).cast("int") for k, t in splitters]
        return sum(behind, F.lit(0))

    def part(of: Column, then: Column) -> Column:
        return F.pmod(F.xxhash64(of, then), F.lit(parts))

    counts = (
        keys.select(shard(F.col("key"), F.col("tie")).alias("_shard"), part(F.col("key"), F.col("tie")).alias("_part"))
        .groupBy("_shard", "_part")
        .count()
    )
    before = Window.partitionBy("_shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_shard", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    made = ("size", "law", "shard", "slot", "grown_shard")
    kept = docs.drop(*made, "_key", "_tie", "_shard", "_part", "_start")
    rows = kept.withColumns({"_key": key, "_tie": tie, "size": size}).withColumns(
        {"_shard": shard(F.col("_key"), F.col("_tie")), "_part": part(F.col("_key"), F.col("_tie"))}
    )
    order = Window.partitionBy("_shard", "_part").orderBy("_key", "_tie")
    placed = rows.withColumn("_row", F.row_number().over(order)).join(starts, ["_shard", "_part"])
    return placed.select(
        *kept.columns,
        "size",
        F.lit(LAW).alias("law"),
        F.col("_shard").alias("shard"),
        (F.col("_start") + F.col("_row") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
