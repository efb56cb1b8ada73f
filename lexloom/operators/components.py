"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import Scratch, stored

#: A node with more than a 1 / HEAVY_SHARE of all edges' ends is heavy, so there are at most HEAVY_SHARE of them.
HEAVY_SHARE = 4_096
#: Distinct edges up to which one task settles the graph by union-find (some tens of MB); with more it is contracted in rounds.
FEW_EDGES = 300_000


def _fingerprint(edges: DataFrame) -> tuple[int, object]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return (row["n"], row["h"])


def _lowered(edges: DataFrame, least: DataFrame, ends: int) -> DataFrame:
    """``edges`` (u, v) with the ``m`` of u from ``least`` (u, m, degree) as ``(v, m)``.

    The rows of a heavy u aren't dealt by u: heavy nodes are at most ``HEAVY_SHARE`` and their minima are broadcast, so a hub's star
    is worked on where its edges lie.
    """
    heavy = F.broadcast(least.where(F.col("degree") * HEAVY_SHARE > ends).select("u", "m"))
    marked = edges.join(heavy, "u", "left")
    near = marked.where("m is not null").select("v", "m")
    far = marked.where("m is null").select("u", "v").join(least.where(F.col("degree") * HEAVY_SHARE <= ends).select("u", "m").hint("merge"), "u").select("v", "m")
    return near.unionByName(far)


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges in one task to ``node, component`` by union-find, the smaller root on top."""
    parent: dict = {}

    def find(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(u), find(v)
            if x != y:
                parent[max(x, y)] = min(x, y)
    if parent:
        yield pa.RecordBatch.from_arrays([pa.array(list(parent), kind), pa.array([find(x) for x in list(parent)], kind)], ["node", "component"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, few_edges: int = FEW_EDGES) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; the component is its smallest node.

    Up to ``few_edges`` distinct edges, which are counted first, are settled by one task. More are contracted, with the same result:
    alternating large-star and small-star steps, of which every round is two aggregations (with a map-side minimum) and two
    joins, in which a hub with very many neighbours doesn't gather in one task (see ``_lowered``). The number of rounds grows with the logarithm
    of the longest path. Rows with a null end are ignored, loops count as isolated nodes, repeated edges as one. Each round's edges are written to the
    shared folder and those of the round before deleted; the result is written there too.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    try:
        pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null").distinct()
        pairs = scratch.keep(pairs, "pairs")
        if pairs.count() <= few_edges:
            kind = pairs.schema["u"].dataType.simpleString()
            return stored(pairs.repartition(1).mapInArrow(_settled, f"node {kind}, component {kind}"), "components")
        nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
        current = scratch.keep(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        seen = _fingerprint(current)
        for _ in range(max_rounds):
            if not seen[0]:
                break
            # large star: every larger neighbour of u hangs below the smallest of u and its neighbours
            both = current.union(current.select("v", "u"))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("degree"))
            large = _lowered(both.where("v > u"), least, 2 * seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            # small star: u and its smaller neighbours hang below the smallest of them
            small = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
            moved = _lowered(large, small, seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
            before, current = current, scratch.keep(moved.union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
            scratch.drop(before)
            now = _fingerprint(current)
            if now == seen:
                break
            seen = now
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        labels = current.groupBy("u").agg(F.min("v").alias("m"))
        return stored(nodes.join(labels, nodes.node == labels.u, "left").select("node", F.coalesce("m", "node").alias("component")), "components")
    finally:
        scratch.close()
