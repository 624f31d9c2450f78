"""Connected components of an undirected edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

#: Edges that a task contracts at a time before the first shuffle; bounds its memory.
CONTRACT = 1_000_000


def _contract(edges: DataFrame) -> DataFrame:
    """Fewer edges with the same components: within a task, every node is joined to the least of its piece."""

    def forest(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        parent = list(range(len(nodes)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        top = np.array([root(x) for x in range(len(nodes))], np.int64)
        own = np.flatnonzero(top != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[top[own]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= CONTRACT:
                yield forest(*(np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1)))
                held, size = [], 0
        if size:
            yield forest(*(np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1)))

    return edges.mapInArrow(run, "a long, b long")


def connected(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of an edge; root is the least node of its component.

    Each round is two joins on a node against the least neighbour of it, which is aggregated before it is shuffled, and
    written: then both sides of the join are plain shuffles, and a node with very many edges can be split. Rounds end when
    a round leaves stars only; their number grows with the logarithm of a component's diameter.
    """
    now = stash(_contract(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where(F.col(a) != F.col(b))), "edges")
    for _ in range(most_rounds):
        # Large star: every neighbour above a node is joined to the least of the node and its neighbours.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stash(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("n"), F.least("a", "low").alias("low")), "least")
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        # Small star: a node and its neighbours below it are joined to the least of these.
        down = stash(large.where("a > b").distinct(), "down")
        low = stash(down.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "n"), "least")
        small = down.join(low, F.col("a") == F.col("n")).select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        after = stash(small.where("a > b").distinct(), "edges")
        # A forest of stars is a fixed point: every node has one edge, and no root has an edge down.
        stars = after.groupBy("a").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"]
        below = after.join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty()
        now = after
        if (stars or 1) == 1 and below:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
