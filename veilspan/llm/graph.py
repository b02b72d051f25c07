"""Connected components of an edge table: of few edges at once on the driver, else by alternating large-star and
small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Edges (16 bytes each) that the driver takes at once. More go round by round, which writes a table a round.
FEW = 500_000


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, ascending, and the least node that each can reach."""
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(names))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return names, names[root]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))  # hang a root on a lesser one, then all on their roots
        while (root[root] != root).any():
            root = root[root]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the (materialised) edges (a, b); the component is its least node. ``FEW`` edges
    or fewer are counted first and solved on the driver. Beyond that both steps are a minimum for each node and a join
    back, so a node with very many neighbours is never gathered in one place, and every round is written to the shared folder."""
    if edges.count() <= FEW:
        few = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").toArrow()
        node, component = least_nodes(few["a"].to_numpy(), few["b"].to_numpy())
        return materialise(edges.sparkSession.createDataFrame(pa.table({"node": node, "component": component})), "components")
    edges = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    last = _mark(edges)
    while last[0]:
        # large star: hang every larger neighbour of u on the least node around u
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: hang u and its lesser neighbours on the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialise(hung.filter("u <> v").distinct(), "edges")
        now = _mark(edges)
        if now == last:
            break
        last = now
    stars = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return materialise(stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct()), "components")
