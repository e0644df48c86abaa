"""Connected components of a link table, by joins and aggregates only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.session import materialize


def spanning_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same nodes as the pairs (a, b): each node with the smallest of its group.

    Runs inside a task on the pairs found there, so that a group of n nodes costs
    n links in the shuffle and not n * n.
    """
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable node of every linked node: (node, component), for links (a, b) of longs.

    Every round hangs each node under its smallest neighbour and shortens the path
    to it by one hop more, so a chain of n nodes takes about log2(n) rounds. A round
    is written to the shared folder, which cuts the lineage. Hubs are split by the
    adaptive skew join, as both sides of each join are read from files. Nodes without
    a link, links with a null end and links of a node to itself yield no row.
    """
    a, b = F.col("a"), F.col("b")
    ends = links.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    links, seen = materialize(ends.distinct(), "links"), None
    while True:
        lowest = materialize(links.groupBy("hi").agg(F.min("lo").alias("m")), "lowest")
        hung = links.join(lowest, "hi").select(
            F.explode(F.array(F.struct(F.col("hi").alias("x"), "m"), F.struct(F.col("lo").alias("x"), "m"))).alias("e")
        )
        up = lowest.select(F.col("hi").alias("m"), F.col("m").alias("above"))
        shorter = (
            hung.select("e.*")
            .where("x != m")
            .join(up, "m", "left")
            .select(F.col("x").alias("hi"), F.coalesce("above", "m").alias("lo"))
        )
        links = materialize(shorter.distinct(), "links")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == seen:
            return links.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        seen = state
