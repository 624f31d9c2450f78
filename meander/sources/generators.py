"""Synthetic graphs, each edge a function of its place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph

#: Multiplier, increment and modulus of the generator behind the k-out graphs (the C library's rand_r).
FACTOR, INCREMENT, MODULUS = 1103515245, 12345, 1 << 32


def jump_ahead(steps: int) -> list[tuple[int, int]]:
    """(A, C) for 0 .. steps: m steps of the generator are s -> A_m * s + C_m."""
    out = [(1, 0)]
    for _ in range(steps):
        a, c = out[-1]
        out.append((FACTOR * a % MODULUS, (FACTOR * c + INCREMENT) % MODULUS))
    return out


def lattice(spark: SparkSession, rows: int, cols: int) -> Graph:
    """Edges to the right and down on a grid; vertex r * cols + c."""
    u = F.col("id")
    right = F.when(u % cols + 1 < cols, u + 1)
    down = F.when(u + cols < rows * cols, u + cols)
    edges = spark.range(rows * cols).select(u.alias("src"), F.explode(F.array(right, down)).alias("dst")).where("dst IS NOT NULL")
    return Graph.from_edges(edges, rows * cols)


def kout(spark: SparkSession, n: int, k: int) -> Graph:
    """k edges out of every vertex to pseudo-random vertices, repeats and self-loops allowed; edge (i, j) in closed form.

    A draw takes three steps of the generator seeded by the vertex and 11 + 10 + 10 bits of them.
    """
    if n > 1 << 31:
        raise ValueError("vertex ids above 2**31 overflow the generator")
    steps = jump_ahead(3 * k)

    def state(j, t):
        a, c = steps[3 * j + t + 1]
        return (F.lit(a) * F.col("id") + F.lit(c)).bitwiseAND(MODULUS - 1)

    def draw(j):
        x = F.shiftright(state(j, 0), 16).bitwiseAND(2047)
        for t in (1, 2):
            x = F.shiftleft(x, 10).bitwiseXOR(F.shiftright(state(j, t), 16).bitwiseAND(1023))
        return x % n

    edges = spark.range(n).select(F.col("id").alias("src"), F.explode(F.array(*[draw(j) for j in range(k)])).alias("dst"))
    return Graph.from_edges(edges, n)


def cycles(spark: SparkSession, number: int, length: int) -> Graph:
    """`number` cycles of `length` vertices each, not joined."""
    u = F.col("id")
    edges = spark.range(number * length).select(u.alias("src"), F.when((u + 1) % length == 0, u - length + 1).otherwise(u + 1).alias("dst"))
    return Graph.from_edges(edges, number * length)


#: Name, kind and parameters of the standard data sets.
STANDARD = (
    ("graph_1k", "kout", (1000, 5)), ("graph_10k", "kout", (10_000, 10)), ("graph_100k", "kout", (100_000, 10)), ("graph_1M", "kout", (1_000_000, 5)), ("lattice_10k", "lattice", (100, 100)),
)


def made(spark: SparkSession, kind: str, parameters: tuple[int, ...]) -> Graph:
    return {"kout": kout, "lattice": lattice}[kind](spark, *parameters)


def standard(spark: SparkSession, name: str) -> Graph:
    return made(spark, *next((k, p) for n, k, p in STANDARD if n == name))


def build(spark: SparkSession, folder: str, names: list[str] | None = None, kinds=STANDARD) -> dict[str, str]:
    """Write graphs, the standard ones unless others are given, as Parquet edges and vertices; (name, path)."""
    out = {}
    for name, kind, parameters in kinds:
        if names is None or name in names:
            graph, path = made(spark, kind, parameters), f"{folder}/{name}"
            graph.edges.write.mode("overwrite").parquet(f"{path}/edges")
            graph.vertices.write.mode("overwrite").parquet(f"{path}/vertices")
            out[name] = path
    return out


def load(spark: SparkSession, path: str) -> Graph:
    """A graph as build() writes it."""
    return Graph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"))
