"""Connected components of an edge table, by hooking, pointer jumping and contraction.

Every round hooks each vertex to its smallest neighbour below it, shortens the trees
to stars, and replaces edges by edges between roots. The rounds needed grow with the
logarithm of the graph; links and labels never leave the executors, and every round's
tables go to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import materialise, settled


def _undirected(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _flat(hooks: DataFrame) -> DataFrame:
    """Trees (node, parent) with parent < node, as stars (node, parent is the root)."""
    while True:
        up = hooks.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        step = materialise(hooks.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")))
        hooks = step.select("node", "parent")
        if step.where("moved").isEmpty():
            return hooks


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every vertex of edges (a, b) but the roots themselves.

    root is the smallest vertex of the component. Loops, repeated edges and nulls
    don't matter; no edges give an empty table.
    """
    return settled(lambda: _contracted(materialise(_undirected(edges))))


def _contracted(edges: DataFrame) -> DataFrame:
    found = None
    while not edges.isEmpty():
        hooks = _flat(materialise(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))))
        to = lambda c: hooks.select(F.col("node").alias(c), F.col("parent").alias(f"{c}_root"))  # noqa: B023, E731
        moved = edges.join(to("a"), "a", "left").join(to("b"), "b", "left")
        edges = materialise(_undirected(moved.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))))
        hooks = hooks.withColumnRenamed("parent", "root")
        if found is not None:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            hooks = hooks.unionByName(found.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")))
        found = materialise(hooks)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if found is None else found
