"""From raw documents to packed training sequences, in five stages.

Every stage takes what the one before kept, as written and read back from Parquet, and all
but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelark.llm import langid
from tradelark.llm.decontaminate import decontaminate
from tradelark.llm.dedup import PASSAGE_WORDS, without_passages
from tradelark.llm.jaccard import jaccard_components
from tradelark.llm.packing import pack_documents
from tradelark.llm.queries import tokenizer_path
from tradelark.plans.staging import lasting, staged, workspace

# A document stays if this share of its n-grams belongs to its language.
LEAST_LANGUAGE_SCORE = 0.3
# Near duplicates: five-word shingles, similarity in percent.
SHINGLE, SIMILAR_PCT = 5, 80


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; texts without a letter go."""
    model = langid.train(docs)
    judged = langid.identify(docs.withColumnsRenamed({"lang_pred": "_lang_pred", "score": "_score"}), model)
    kept = judged.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.drop("lang_pred", "score").withColumnsRenamed({"_lang_pred": "lang_pred", "_score": "score"})


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Rows that share an id are one document: they stay or go together, but equal rows stay
    once. Documents without words and rows without an id stay.
    """
    with workspace(spark):
        grouped = jaccard_components(docs, k=SHINGLE, pct=SIMILAR_PCT)
        ids = grouped.groupBy("doc_id").agg(
            F.min(F.col("doc_id") == F.col("component_id")).alias("heads"), F.count(F.lit(1)).alias("rows")
        )
        ids = lasting(ids.where("doc_id IS NOT NULL AND (NOT heads OR rows > 1)"), "near-duplicates")
    kept = docs.join(ids.where("NOT heads").select("doc_id").hint("shuffle_hash"), "doc_id", "left_anti")
    repeated = ids.where("heads AND rows > 1").select("doc_id")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages that occur elsewhere; n_chars follows the text."""
    left = without_passages(docs, words=PASSAGE_WORDS)
    return left.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))) if "n_chars" in docs.columns else left


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids and their place in a sequence."""
    return pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_bitmask", language_stage),
    ("token_group_join", near_duplicate_stage),
    ("suffix_array_dedup", passage_stage),
    ("benchmark_containment", benchmark_stage),
    ("best_fit_packing", packing_stage),
]

# The trained stages and the suffix and packing stages have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each result is written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
