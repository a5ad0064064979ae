"""Recency, frequency and monetary value of buyers.

``rfm_base`` is the costly part. The scores read it three times (sketches, counts inside their
brackets, scoring), so give them a base that has been written
(``tradelark.plans.staging.staged``). Only the edges of the measures that are asked for are computed.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Literal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelark.functions.clock import floor_days
from tradelark.functions.labels import frequency_score, value_segment
from tradelark.functions.numbers import hundredths, mean_of_whole, percent, ratio, total
from tradelark.functions.order_stats import bracketed_quantiles
from tradelark.market import Market
from tradelark.operators.cleaning import PURCHASED
from tradelark.operators.master import BUYER, completed_market, order_facts, with_buyer

QUINTILES = 5
RepeatedEdges = Literal["raise", "collapse"]


def rfm_base(market: Market) -> DataFrame:
    """Per buyer: last purchase, orders, spend, days before the day after the last sale."""
    done = completed_market(market)
    per_customer = order_facts(done, payments=True).groupBy("customer_id").agg(
        F.max(PURCHASED).alias("last_purchase"),
        F.count("*").alias("frequency"),
        total("payment_value").alias("monetary"),
    )
    bought = with_buyer(per_customer, market.customers, "drop").where(F.col(BUYER).isNotNull())
    snapshot = done.orders.agg((F.max(PURCHASED) + F.make_dt_interval(F.lit(1))).alias("snapshot")).scalar()
    return (
        bought.groupBy(BUYER)
        .agg(
            F.max("last_purchase").alias("last_purchase"),
            F.sum("frequency").alias("frequency"),
            total("monetary").alias("monetary"),
        )
        .withColumn("_snapshot", snapshot)
        .withColumn("recency_days", floor_days(F.col("_snapshot"), F.col("last_purchase")))
        .drop("_snapshot")
    )


def _measures() -> dict[str, Column]:
    """The scored columns as whole numbers: days, and hundredths of money."""
    return {
        "recency": F.col("recency_days").cast("bigint"),
        "monetary": hundredths("monetary"),
    }


def quintile_edges(
    base: DataFrame, *, repeated: RepeatedEdges = "raise", measures: Sequence[str] = ("recency", "monetary")
) -> DataFrame:
    """Per measure the six edges of its quintiles (times five), as an array.

    Edges are exact and linearly interpolated. Heavily tied data can make edges
    coincide; that is an error unless asked for, since some bins would be empty.
    """
    names = list(measures)
    values = base.select(*[_measures()[name].alias(name) for name in names])
    marks = bracketed_quantiles(values, names, parts=QUINTILES, slots=range(QUINTILES + 1))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("slot", "mark"))), lambda edge: edge["mark"])
    edges = marks.groupBy("measure").agg(ordered.alias("edges"))
    if repeated == "raise":
        message = F.concat(F.lit("quintile edges repeat for "), F.col("measure"))
        distinct = F.size(F.array_distinct("edges")) == F.size("edges")
        edges = edges.withColumn(
            "edges", F.when(distinct, F.col("edges")).otherwise(F.raise_error(message).cast("array<bigint>"))
        )
    return edges


def _quintile(value: Column, edges: Column) -> Column:
    """1 for values up to the first inner edge, one more for every inner edge below the value."""
    inner = [edges.getItem(slot) for slot in range(1, QUINTILES)]
    above = [(value * QUINTILES > edge).cast("int") for edge in inner]
    return sum(above[1:], above[0]) + 1


def with_quintile_scores(
    base: DataFrame, *, repeated: RepeatedEdges = "raise", measures: Sequence[str] = ("recency", "monetary")
) -> DataFrame:
    """Add recency_score, monetary_score or both: newest and highest spend score 5."""
    edges = quintile_edges(base, repeated=repeated, measures=measures)
    # One row with all edges; Spark runs it once and hands the value to every task.
    lookup = edges.agg(F.map_from_entries(F.collect_list(F.struct("measure", "edges")))).scalar()
    quintile = {name: _quintile(_measures()[name], F.col("_edges")[name]) for name in measures}
    if "recency" in quintile:
        quintile["recency"] = QUINTILES + 1 - quintile["recency"]
    scored = base.withColumn("_edges", lookup).withColumns({f"{name}_score": score for name, score in quintile.items()})
    return scored.drop("_edges")


def rfm_scores(base: DataFrame, *, repeated: RepeatedEdges = "raise") -> DataFrame:
    """Add the three scores: newest, most frequent and highest spend score 5."""
    return with_frequency_score(with_quintile_scores(base, repeated=repeated))


def with_frequency_score(base: DataFrame) -> DataFrame:
    return base.withColumn("frequency_score", frequency_score(F.col("frequency")))


def rfm_segments(scores: DataFrame) -> DataFrame:
    """Add the customer segment."""
    return scores.withColumn(
        "customer_segment",
        value_segment(F.col("recency_score"), F.col("frequency_score"), F.col("monetary_score")),
    )


def segment_summary(segments: DataFrame) -> DataFrame:
    """Per segment: buyers, means, revenue and both shares; highest revenue first."""
    summary = segments.groupBy("customer_segment").agg(
        F.count("*").alias("customers"),
        mean_of_whole(F.col("recency_days")).alias("average_recency_days"),
        mean_of_whole(F.col("frequency")).alias("average_orders"),
        total("monetary").alias("total_revenue"),
        ratio(total("monetary"), F.count("monetary")).alias("average_customer_value"),
    )
    # Totals over at most one row per segment.
    everyone = Window.partitionBy()
    return summary.withColumns(
        {
            "customer_share_pct": percent(F.col("customers"), F.sum("customers").over(everyone)),
            "revenue_share_pct": percent(F.col("total_revenue"), F.sum("total_revenue").over(everyone)),
        }
    ).orderBy(F.desc("total_revenue"), "customer_segment")


def top_customers(segments: DataFrame, n: int = 10) -> DataFrame:
    """The buyers with the highest spend and their segment."""
    return (
        segments.select(BUYER, "frequency", "monetary", "recency_days", "customer_segment")
        .orderBy(F.desc("monetary"), BUYER)
        .limit(n)
    )
