"""Connected components by contraction, with every level written to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import arrow_task, saved


class Union:
    """Disjoint sets of ids within one task; the root of a set is its smallest id."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while x != root:
            self.parent[x], x = root, self.parent.get(x, x)
        return root

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def _of_few(edges: DataFrame) -> DataFrame:
    """id and to (the component) of the ends of few edges, in one task."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        union, ids = Union(), set()
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                union.join(a, b)
                ids |= {a, b}
        ordered = sorted(ids)
        yield pa.RecordBatch.from_arrays([pa.array(ordered, pa.int64()), pa.array([union.find(i) for i in ordered], pa.int64())], ["id", "to"])

    return edges.select("a", "b").repartition(1).mapInArrow(arrow_task(solve), "id bigint, to bigint")


def components(edges: DataFrame, few: int = 50_000) -> DataFrame:
    """id and component (the smallest id that edges a-b reach, itself included) for each id that has an edge to another.

    Each level sends every node to the smallest of itself and its neighbours (a sum that is made before rows are shuffled, so
    a node with very many edges is no burden) and keeps the edges between the nodes that are left. Once at most `few` edges
    are left (they are counted first), one task finishes them. The levels' pointers are then composed. Edges with a null and
    loops are left out. No edges: no rows.
    """
    left = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter((F.col("a") != F.col("b")) & F.col("a").isNotNull() & F.col("b").isNotNull()).distinct(), "edges")
    levels = []
    while (n := left.count()) > 0:
        if n <= few:
            levels.append(saved(_of_few(left), "pointers"))
            break
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointers = saved(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("to")), "pointers")
        levels.append(pointers)
        a = pointers.select(F.col("id").alias("a"), F.col("to").alias("to_a"))
        b = pointers.select(F.col("id").alias("b"), F.col("to").alias("to_b"))
        moved = left.join(a, "a").join(b, "b").filter("to_a != to_b")
        left = saved(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
    if not levels:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = levels[0].select("id", F.col("to").alias("component"))
    for level in levels[1:]:
        out = out.join(level.select(F.col("id").alias("component"), "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return out
