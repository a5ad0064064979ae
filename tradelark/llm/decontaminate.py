"""Benchmark decontamination: MinHash containment search, verified exactly.

Items are partitioned by the size of their shingle set, in powers of two. Every class has
its own candidate step: how many of an item's sketch hashes a document must hold to be a
candidate, more for larger items, whose sketches have more frequent shingles. Containment
of at least the threshold leaves at most a known number of an item's shingles unmatched,
so of that many smallest hashes and ``step`` more (its MinHash sketch, of a depth fixed by
size and class) a document that contains the item holds at least ``step``, however long it
is. Candidates are then counted exactly, on the words themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelark.plans.staging import lasting, staged, workspace

SHINGLE = 5
THRESHOLD_PCT = 80
_WORDS = [f"w{at}" for at in range(SHINGLE)]
# Sizes of a class double; every so many classes a candidate must hold one hash more.
CLASSES_PER_STEP = 3
_GAPS = "[\\x20\\x09-\\x0D]+"


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(text), _GAPS), "")


def shingles(frame: DataFrame, key: str, text: str) -> DataFrame:
    """One row per word position: the key, the five words as columns and their hash.

    A text of fewer words is one shingle, filled up with empty words; a text without
    words has none. Repeated shingles are repeated rows.
    """
    words = frame.select(F.col(key).alias(key), _words(text).alias("words")).where(F.size("words") > 0)
    missing = F.greatest(F.lit(SHINGLE) - F.size("words"), F.lit(0))
    words = words.select(key, F.concat("words", F.array_repeat(F.lit(""), missing)).alias("words"))
    count = F.size("words") - (SHINGLE - 1)
    columns = [F.slice("words", F.lit(at + 1), count).alias(name) for at, name in enumerate(_WORDS)]
    return words.select(key, F.inline(F.arrays_zip(*columns))).withColumn(
        "hash", F.xxhash64(*_WORDS)
    )


def item_sketches(items: DataFrame, threshold_pct: int) -> DataFrame:
    """item_id, hash, need, step, size_class: of each item the hashes of which a match holds ``step`` or more.

    A match holds ``need`` of an item's n hashes, so it misses n - need of any. The step of a
    class never exceeds what an item needs.
    """
    distinct = shingles(items, "item_id", "text").select("item_id", "hash").distinct()
    n = F.count("hash").over(Window.partitionBy("item_id"))
    need = F.expr(f"greatest(({threshold_pct} * n + 99) div 100, 1)")
    size_class = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    ranked = (
        distinct.withColumn("n", n)
        .withColumn("need", need)
        .withColumn("size_class", size_class)
        .withColumn("step", F.expr(f"least(1 + size_class div {CLASSES_PER_STEP}, need)"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("hash")))
    )
    return ranked.where("rank <= n - need + step").select("item_id", "hash", "need", "step", "size_class")


def contained_items(docs: DataFrame, items: DataFrame, *, threshold_pct: int = THRESHOLD_PCT) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment of every item held by a document.

    docs has doc_id and text, items has item_id and text; other columns are ignored. Words
    are lower-cased and cut at white space; the share is of the item's distinct five-word
    shingles, counted on words, and ``threshold_pct`` percent or more is held. An item of
    fewer than five words is held by documents of exactly these words. Null and empty
    texts hold nothing and are held by nothing, rows without an id take no part, rows
    that share an id count as one document (or item). Empty tables give no rows.
    """
    with workspace(docs.sparkSession):
        return lasting(_verified(docs, items, threshold_pct), "contained-items")


def _verified(docs: DataFrame, items: DataFrame, threshold_pct: int) -> DataFrame:
    docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    items = items.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    # Written, so that the planner knows its size and broadcasts it only below its limit.
    sketches = staged(item_sketches(items, threshold_pct), "item-sketches")
    hits = (
        shingles(docs, "doc_id", "text")
        .join(sketches, "hash")
        .select("doc_id", "item_id", "step", "hash")
        .distinct()
        .groupBy("doc_id", "item_id", "step")
        .agg(F.count(F.lit(1)).alias("held"))
        .where("held >= step")
        .select("doc_id", "item_id")
    )
    candidates = staged(hits, "contained-candidates")
    wanted = shingles(items, "item_id", "text").select("item_id", "hash", *_WORDS).distinct()
    sizes = wanted.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_shingles"))
    full = staged(wanted.join(candidates.select("item_id").distinct(), "item_id", "left_semi"), "item-shingles")
    suspects = docs.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    shared = (
        shingles(suspects, "doc_id", "text")
        .join(full, ["hash", *_WORDS])
        .select("doc_id", "item_id", "hash", *_WORDS)
        .distinct()
        .groupBy("doc_id", "item_id")
        .agg(F.count(F.lit(1)).alias("n_shared"))
    )
    verified = shared.join(candidates, ["doc_id", "item_id"], "left_semi").join(sizes, "item_id")
    return verified.where(F.col("n_shared") * 100 >= F.col("n_shingles") * threshold_pct).select(
        "doc_id", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment")
    )


def decontaminate(docs: DataFrame, items: DataFrame, *, threshold_pct: int = THRESHOLD_PCT) -> DataFrame:
    """The rows of ``docs`` that hold no item; rows without an id or a text stay."""
    with workspace(docs.sparkSession):
        found = contained_items(docs, items, threshold_pct=threshold_pct)
        held = lasting(found.select(F.col("doc_id").alias("_held")).distinct(), "holding-documents")
    return docs.join(held, docs["doc_id"] == held["_held"], "left_anti")
