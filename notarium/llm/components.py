"""Connected components of an edge table by contraction.

While more than LOCAL edges are left, a round gives each node its best-ranked neighbour (or itself, if that ranks
better) as parent, follows parents once more, and replaces the ends of the edges by their parents.  Ranks are hashes
that change with the round, so a round shrinks any graph by a constant factor, whatever the nodes are called.  What is
left then, LOCAL edges at most, is solved by union-find in one task.  Every round's tables are written to the shared
folder: lineage stays short, and lost executors cost one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import discard, giving_back, materialise

LOCAL = 200_000


@giving_back
def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict = {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field("a").type
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if kind is not None:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], names=["node", "root"])


def _contracted(edges: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(parents (node, p), edges between parents) after round k."""
    rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("v"))
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    parent = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least(rank("a"), F.col("m"))["v"].alias("p"))
    grand = parent.alias("x").join(parent.alias("y"), F.col("x.p") == F.col("y.node")).select("x.node", F.col("y.p").alias("p"))
    grand = materialise(grand, "parents")
    moved = (
        edges.join(grand.select(F.col("node").alias("a"), F.col("p").alias("pa")), "a").join(grand.select(F.col("node").alias("b"), F.col("p").alias("pb")), "b")
        .where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
    )
    return grand, materialise(moved, "edges")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is one fixed node of its component.  Self-loops are allowed."""
    edges = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    kind = edges.schema["a"].dataType.simpleString()
    roots, k = None, 0
    while edges.count() > LOCAL:
        grand, moved = _contracted(edges, k)
        if roots is None:
            new = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(grand.withColumnRenamed("p", "root"), "node")
        else:
            new = roots.join(grand.select(F.col("node").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        new = materialise(new, "roots")
        for old in (edges, roots, grand):
            if old is not None:
                discard(old)
        edges, roots, k = moved, new, k + 1
    last = edges.coalesce(1).mapInArrow(_solve, f"node {kind}, root {kind}")
    if roots is not None:
        last = roots.join(last.select(F.col("node").alias("root"), F.col("root").alias("p")), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
    out = materialise(last, "roots")
    discard(edges)
    return out
