"""Connected components by least label, for operators that link rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import written


def _roots(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest (node, parent) whose roots are their own parents; depths halve each round."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("higher"))
        fresh = written(parents.join(up, "parent").select("node", F.col("higher").alias("parent"), F.col("parent").alias("before")), "roots")
        if fresh.where("parent <> before").isEmpty():
            return fresh.select("node", F.col("parent").alias("root"))
        parents = fresh.select("node", "parent")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b): the least node it can reach.

    Each round every node of a link goes to its least neighbour if that is less, and with it up to the top; links are
    then carried over to the tops, and those inside one are done. So nodes at least halve, chains too, and a link that
    has done its work isn't read again. Rounds end when no link is left; each is written, none is held by the driver.
    A node with very many links is combined before the shuffle.
    """
    links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    labels = None
    while labels is None or not links.isEmpty():
        ways = links.select(F.col("a").alias("node"), F.col("a").alias("low")).union(links.select("b", "a"))
        roots = _roots(ways.groupBy("node").agg(F.least("node", F.min("low")).alias("parent")))
        if labels is None:
            labels = roots.select("node", F.col("root").alias("component"))
        else:
            above = roots.select(F.col("node").alias("component"), "root")
            labels = labels.join(above, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        labels = written(labels, "labels")
        tops = links.join(roots.select(F.col("node").alias("a"), F.col("root").alias("first")), "a")
        tops = tops.join(roots.select(F.col("node").alias("b"), F.col("root").alias("second")), "b").where("first <> second")
        links = written(tops.select(F.least("first", "second").alias("a"), F.greatest("first", "second").alias("b")).distinct(), "links")
    return labels
