"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelark.plans.staging import staged


def components(links: DataFrame) -> DataFrame:
    """node, component of every node in ``links`` (a, b: long); component is its smallest node.

    Each round every node takes the name of its smallest neighbour (or its own, if smaller)
    and links between the names remain. Names within a component only get smaller, and at
    least the largest of them disappears; stars and bushes collapse in one or two rounds. A
    node's names are followed back through the rounds at the end.
    """
    both = links.select("a", "b").where("a <> b")
    both = staged(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    rounds = []
    while not both.isEmpty():
        named = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("name"))
        named = staged(named.select(F.col("a").alias("node"), "name"), "names")
        rounds.append(named)
        one = both.join(named.select(F.col("node").alias("a"), F.col("name").alias("x")), "a")
        two = one.join(named.select(F.col("node").alias("b"), F.col("name").alias("y")), "b")
        both = staged(two.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
    if not rounds:
        return both.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = rounds[0].select("node", F.col("name").alias("component"))
    for named in rounds[1:]:
        later = named.select(F.col("node").alias("component"), F.col("name").alias("next"))
        found = found.join(later, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return found
