"""Exact quantiles without gathering a group in one place.

Spark's exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer, and a rank window sorts a whole group in one task. Neither
holds when one group has a third of all rows. Here a value is located top-down:
count rows per coarse bucket, find the bucket holding the wanted rank, then look
only inside that bucket with finer buckets, until the bucket is the value itself.
Only bucket counts are ever shuffled, combined before the shuffle.

Where there are few groups, a mergeable sketch says in one pass between which values a
quantile lies, and one more pass counts exactly there (``bracketed_quantiles``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Size of the sketches, and the share of all rows by which a bracket reaches beyond its quantile
# on either side: four times the error that such a sketch keeps in 99 of 100 cases.
SKETCH_SIZE, MARGIN = 1 << 15, 0.0008


def whole_number_ladder(value: Column) -> list[Column]:
    """Buckets for whole numbers: at most 2**16 per parent for values below 2**48."""
    value = value.cast("bigint")
    return [F.shiftright(value, 32), F.shiftright(value, 16), value]


def degree_ladder(value: Column) -> list[Column]:
    """Buckets for coordinates: about a kilometre, about ten centimetres, the value."""
    return [F.floor(value * 100), F.floor(value * 1_000_000), value]


def scaled_quantiles(
    data: DataFrame,
    keys: Sequence[str],
    ladder: Sequence[Column],
    *,
    parts: int,
    slots: Sequence[int],
    few_groups: bool = False,
) -> DataFrame:
    """Per group, ``parts`` times the ``slot / parts`` quantile, linearly interpolated.

    The position of a quantile is ``slot * (n - 1) / parts``. Scaling by ``parts``
    keeps whole numbers whole, so comparisons with the result are exact.

    ``ladder`` holds monotone bucket expressions from coarse to fine and ends with
    the value itself; rows where it is null are left out. Set ``few_groups`` only
    where the number of groups is fixed by the caller: the wanted positions are
    then at most ``groups * 2 * slots`` rows and are broadcast.

    Returns columns ``keys..., slot, mark``; a group without values has no rows.
    """
    keys = list(keys)
    steps = [f"_step{depth}" for depth in range(len(ladder))]
    rows = data.select(*keys, *[bucket.alias(step) for bucket, step in zip(ladder, steps)]).where(
        F.col(steps[-1]).isNotNull()
    )

    found = None
    for depth, step in enumerate(steps):
        # All earlier steps: a coarse and a finer bucket of rounded numbers need not nest.
        parent = keys + steps[:depth]
        inside = rows
        if found is not None:
            targets = found.groupBy(*parent).agg(F.collect_list("target").alias("targets"))
            if few_groups:
                targets = F.broadcast(targets)
                inside = rows.join(targets.select(*parent), parent)
        # With many groups the rows are counted before they meet the targets, so a
        # group or bucket with very many rows arrives at the join already combined.
        counts = inside.groupBy(*parent, step).agg(F.count("*").alias("_rows"))

        group = Window.partitionBy(*parent)
        upto = F.sum("_rows").over(group.orderBy(step).rowsBetween(Window.unboundedPreceding, 0))
        if found is None:
            sized = counts.select("*", upto.alias("_until"), F.sum("_rows").over(group).alias("_size"))
            placed = sized.withColumn("targets", _wanted(parts, slots))
        else:
            placed = counts.join(targets, parent).select("*", upto.alias("_until"))
        placed = placed.withColumn("_before", F.col("_until") - F.col("_rows"))

        # The wanted ranks that lie in this bucket, counted from its first row.
        here = """transform(
            filter(targets, target -> target.rank >= _before AND target.rank < _until),
            target -> struct(target.slot, target.rank - _before AS rank, target.weight))"""
        found = placed.select(*parent, step, F.explode(F.expr(here)).alias("target"))

    return found.groupBy(*keys, F.col("target.slot").alias("slot")).agg(
        F.sum(F.col(steps[-1]) * F.col("target.weight")).alias("mark")
    )


def _wanted(parts: int, slots: Sequence[int]) -> Column:
    """The two neighbours of each quantile position in a group of ``_size`` rows.

    Each has a weight. A neighbour of weight zero is left out, so a quantile that
    falls on a row takes that row's value alone.
    """
    every = ", ".join(f"{slot}L" for slot in slots)
    position = "(slot * (_size - 1))"
    return F.expr(
        f"""filter(
            flatten(transform(array({every}), slot -> array(
                struct(slot, {position} div {parts} AS rank, {parts} - {position} % {parts} AS weight),
                struct(slot, {position} div {parts} + 1 AS rank, {position} % {parts} AS weight)))),
            target -> target.weight > 0)"""
    )


def bracketed_quantiles(
    data: DataFrame, names: Sequence[str], *, parts: int, slots: Sequence[int], sketch_size: int = SKETCH_SIZE, margin: float = MARGIN
) -> DataFrame:
    """Per column of whole numbers, ``parts`` times the ``slot / parts`` quantile, linearly interpolated.

    The same marks as ``scaled_quantiles`` for a few columns of one table, bit by bit, from two passes:
    the sketches of all columns in one row give a bracket of values per quantile; rows outside all
    brackets are then counted as such, rows inside by value. Only a share of about ``2 * margin`` of the rows
    per quantile is so shuffled by value, combined before the shuffle. That the wanted ranks
    lie inside is checked: a bracket that misses one is an error, never a wrong mark.

    Returns columns ``measure, slot, mark``; a column without values has no rows.
    """
    names = list(names)
    sketches = data.agg(
        *[F.kll_sketch_agg_bigint(name, F.lit(sketch_size)).alias(f"_sketch_{name}") for name in names],
        *[F.count(name).alias(f"_size_{name}") for name in names],
    )
    known = sketches.select(
        F.inline(F.array(*[
            F.struct(
                F.lit(name).alias("measure"),
                F.col(f"_size_{name}").alias("_size"),
                # A sketch of nothing has no quantiles.
                F.when(F.col(f"_size_{name}") > 0, _brackets(F.col(f"_sketch_{name}"), F.col(f"_size_{name}"), parts, slots, margin)).alias("_brackets"),
            )
            for name in names
        ]))
    )
    rows = data.select(*names).unpivot([], names, "measure", "value").where(F.col("value").isNotNull())
    rows = rows.join(F.broadcast(known), "measure")  # one row per column
    begun = F.size(F.filter("_brackets", lambda bracket: bracket["low"] <= F.col("value")))
    ended = F.size(F.filter("_brackets", lambda bracket: bracket["high"] < F.col("value")))
    # Zones follow each other as the values do; inside a bracket a value counts by itself.
    zoned = rows.select("measure", "_size", (begun + ended).alias("_zone"), F.when(begun > ended, F.col("value")).alias("value"))
    counts = zoned.groupBy("measure", "_size", "_zone", "value").agg(F.count("*").alias("_rows"))

    # One row per value inside the brackets, a few for all others.
    upto = Window.partitionBy("measure").orderBy("_zone", "value").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("_until", F.sum("_rows").over(upto)).withColumn("targets", _wanted(parts, slots))
    here = F.expr("""transform(
        filter(targets, target -> value IS NOT NULL AND target.rank >= _until - _rows AND target.rank < _until),
        target -> struct(target.slot, target.weight, value * target.weight AS part))""")
    hits = placed.groupBy("measure").agg(F.flatten(F.collect_list(F.when(F.size(here) > 0, here))).alias("hits"))

    zero = F.lit(0).cast("bigint")
    weight = F.aggregate("hits", zero, lambda total, hit: total + hit["weight"])
    marks = F.transform(
        F.array(*[F.lit(slot).cast("bigint") for slot in slots]),
        lambda slot: F.struct(
            slot.alias("slot"),
            F.aggregate(F.filter("hits", lambda hit: hit["slot"] == slot), zero, lambda total, hit: total + hit["part"]).alias("mark"),
        ),
    )
    # Both neighbours of every quantile must have been met: their weights add up to ``parts``.
    missed = F.raise_error(F.concat(F.lit("a bracket misses a quantile of "), F.col("measure"))).cast("array<struct<slot:bigint,mark:bigint>>")
    return hits.select("measure", F.inline(F.when(weight == parts * len(slots), marks).otherwise(missed)))


def _brackets(sketch: Column, size: Column, parts: int, slots: Sequence[int], margin: float) -> Column:
    """Values between which both neighbours of each quantile lie, by the sketch.

    The neighbours of a quantile stand within two rows of its share of the rows. In a column of
    more than 20 / margin rows that is a tenth of the margin; a smaller one is all inside.
    """

    def at(shares: list[float], every: float) -> Column:
        few = F.array(*[F.lit(every) for _ in shares])
        many = F.array(*[F.lit(min(1.0, max(0.0, share))) for share in shares])
        return F.when(size * margin > 20, F.kll_sketch_get_quantile_bigint(sketch, many)).otherwise(F.kll_sketch_get_quantile_bigint(sketch, few))

    low = at([slot / parts - 1.1 * margin for slot in slots], 0.0)
    high = at([slot / parts + 1.1 * margin for slot in slots], 1.0)
    return F.arrays_zip(low.alias("low"), high.alias("high"))
