"""Connected components: spanning forests inside tasks, then large-star / small-star rounds on DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links (a, b): (member, smallest member), without the smallest itself."""
    if not len(a):
        return np.zeros(0, np.asarray(a).dtype), np.zeros(0, np.asarray(a).dtype)
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    member = np.flatnonzero(label != np.arange(len(names)))
    return names[member], names[label[member]]


def components(links: DataFrame) -> DataFrame:
    """`(node, component)` for every node of `links(a, b)`; component is the smallest node reachable.

    Each round replaces links by links to smallest neighbours until every component is a star. A round is
    an aggregation with partial sums and a join that adaptive execution can split, so hubs do not end up
    in one task. Rounds are written to the shared folder.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both if large else both.filter("b < a")
        low = near.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        out = near.join(low, "a")
        if large:
            return out.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        return out.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = scratch.stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    seen = mark(edges)
    while seen[0]:
        edges = scratch.stored(star(star(edges, True).filter("a <> b").distinct(), False).filter("a <> b").distinct())
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


#: Spare numbers begin here, for nodes of null id beside ids that all lie below.
UNNAMED = 0x7000000000000000


def numbered(nodes: DataFrame, first: str, kind: str) -> tuple[DataFrame, str]:
    """`nodes`, stored, with `node`, a number of each, and which of the numbers are ids: "all", "below" `UNNAMED` or "none".

    A node bears its smallest id, so that components bear the smallest id without being gathered, where ids are
    whole numbers and no two nodes have one in common. Nodes of null id get spare numbers beyond the ids; where
    ids reach into these, or are of another type or not unique, all nodes get numbers of the row.
    """
    nodes = scratch.stored(nodes.withColumn("_spare", F.monotonically_increasing_id()))
    ids = "none"
    if kind in ("tinyint", "smallint", "int", "bigint"):
        n, own, distinct, high = nodes.agg(F.count("*"), F.count(first), F.count_distinct(first), F.max(first)).first()
        if own == distinct:
            ids = "all" if own == n else "below" if own == 0 or high < UNNAMED else "none"
    spare = {"all": F.lit(None), "below": F.lit(UNNAMED) + F.col("_spare"), "none": F.col("_spare")}[ids]
    own_id = F.lit(None) if ids == "none" else F.col(first)
    return nodes.withColumn("node", F.coalesce(own_id.cast("long"), spare.cast("long"))).drop("_spare"), ids


def named(nodes: DataFrame, links: DataFrame, first: str, ids: str) -> DataFrame:
    """`nodes` with `component_id`, the smallest id in the component of each; links are between nodes of `numbered`."""
    found = nodes.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    if ids != "none":
        known = F.lit(True) if ids == "all" else F.col("component") < UNNAMED
        return found.withColumn("component_id", F.when(known, F.col("component")).cast(nodes.schema[first].dataType)).drop("component")
    best = found.groupBy("component").agg(F.min(first).alias("component_id"))
    return found.join(best, "component").drop("component")
