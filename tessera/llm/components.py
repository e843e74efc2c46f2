"""Connected components of an edge table, without collecting it anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop, joined, ship, stored

#: Edges that one union-find holds before it hands on its forest.
FOREST_EDGES = 200_000


def union_find(edges: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Each node's root; a root is the least node of its set."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while (up := parent[x]) != top:
            parent[x], x = top, up
        return top

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def _forest(batches: Iterator[pa.RecordBatch], roots: bool = False) -> Iterator[pa.RecordBatch]:
    """(node, root) of every node that is no root, with ``roots`` of those too; edges in groups of FOREST_EDGES."""
    held: list[tuple[int, int]] = []

    def flush() -> pa.RecordBatch:
        pairs = [(x, r) for x, r in union_find(iter(held)).items() if roots or x != r]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], names=["u", "v"])

    for batch in batches:
        if len(held) + batch.num_rows > FOREST_EDGES:
            yield flush()
        held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
    if held:
        yield flush()


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Joins the larger neighbours of each node to its least neighbour."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return joined(both, least, "u", 2 * n).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Joins each node and its smaller neighbours to the least of them; u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = joined(edges, least, "u", n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (two long columns, no nulls), stored.

    Each partition's union-find first thins its edges to a forest.  Then
    alternating large-star and small-star steps, each stored in the shared
    folder, run until every edge leads to the least node of its component; once
    a single union-find can hold the forest, one task ends the matter.  A
    hub's rows are aggregated where they are and meet their least neighbour by
    a broadcast of few rows, so no task gathers a hub.
    """
    ship(edges.sparkSession)
    a, b = edges.columns[:2]
    forest = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").mapInArrow(_forest, "u long, v long")
    now, mark = stored(forest, "edges"), None
    while True:
        said = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if said[0] <= FOREST_EDGES:  # one union-find holds them all
            out = stored(now.coalesce(1).mapInArrow(lambda x: _forest(x, True), "node long, root long"), "roots")
            break
        if tuple(said) == mark:
            pairs = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out = stored(pairs.unionAll(now.select("v", "v").distinct()), "roots")
            break
        mark, last = tuple(said), now
        now = stored(_small_star(_large_star(now, said[0]), said[0]), "edges")
        drop(last)
    drop(now)
    return out
