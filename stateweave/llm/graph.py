"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest member of each node's component: columns ``node`` and ``label``, for nodes that have a link.

    In each round every node takes the smallest node around it, then that node's own choice, and links shrink to those
    between different choices.  A group whose members all know its smallest one is done in a single round; a chain
    takes a number of rounds that grows with the logarithm of its length.  Links with a null end are ignored.
    """
    edges = stored(links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    labels = None
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        choice = stored(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")))
        for _ in range(2):
            choice = stored(follow(choice, choice))
        step = choice if labels is None else stored(follow(labels, choice))
        if labels is not None:
            discard(labels)
        labels = step
        ends = lambda x, y: choice.select(F.col("node").alias(x), F.col("label").alias(y))
        moved = edges.join(ends("a", "la"), "a").join(ends("b", "lb"), "b").where("la <> lb")
        edges = stored(moved.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
        if not edges.limit(1).count():
            return labels


def follow(labels: DataFrame, choice: DataFrame) -> DataFrame:
    """Each label replaced by the choice that the node of that name has made, if it is one."""
    after = choice.select(F.col("node").alias("label"), F.col("label").alias("next"))
    return labels.join(after, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
