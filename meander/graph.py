"""Directed graphs as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import dealt


@dataclass(frozen=True)
class Graph:
    """vertices: `v`, every id from 0 to the largest; edges: `src`, `dst`, a bag with self-loops and repeated edges."""

    vertices: DataFrame
    edges: DataFrame

    def __post_init__(self):
        object.__setattr__(self, "vertices", dealt(self.vertices))
        object.__setattr__(self, "edges", dealt(self.edges))

    @classmethod
    def from_edges(cls, edges: DataFrame, n: int | None = None) -> Graph:
        """A graph of an edge table. n: the number of vertices; else the largest id and one, and none without edges."""
        edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
        if n is None:
            top = max_vertex(edges).first()["max_v"]
            n = 0 if top is None else top + 1
        return cls(edges.sparkSession.range(n).select(F.col("id").alias("v")), edges)

    @classmethod
    def literal(cls, spark: SparkSession, n: int, edges: list[tuple[int, int]]) -> Graph:
        return cls.from_edges(spark.createDataFrame(edges, "src long, dst long"), n)

    def transpose(self) -> Graph:
        """Every edge turned round; nothing is copied."""
        return Graph(self.vertices, self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))

    def subgraph(self, kept: DataFrame) -> Graph:
        """The vertices in `kept` (v) and the edges between them."""
        ends = dealt(kept.select("v"))
        edges = self.edges.join(ends.withColumnRenamed("v", "src"), "src", "left_semi").join(ends.withColumnRenamed("v", "dst"), "dst", "left_semi")
        return Graph(ends, edges.select("src", "dst"))

    def simple(self) -> Graph:
        """Without self-loops and repeated edges, which change no strongly connected component."""
        return Graph(self.vertices, self.edges.where("src <> dst").distinct())


def max_vertex(edges: DataFrame) -> DataFrame:
    """max_v and n_edges in one row; max_v is null without edges."""
    return edges.agg(F.max(F.greatest("src", "dst")).alias("max_v"), F.count("*").alias("n_edges"))


def degrees(graph: Graph) -> DataFrame:
    """(v, out_degree, in_degree) with multiplicity, zero where there is none: one aggregation over both ends."""
    ends = graph.edges.select(F.explode(F.array(F.struct(F.col("src").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    counted = ends.groupBy("v").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return graph.vertices.join(counted, "v", "left").select("v", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def adjacency(graph: Graph) -> DataFrame:
    """(src, neighbors) in order, for vertices with an edge out."""
    return graph.edges.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("neighbors"))


#: Vertices of one block of the prefix sum: each block is summed by itself, and only block totals meet in one place.
BLOCK = 1 << 16


def csr_offsets(graph: Graph) -> DataFrame:
    """(v, off): the exclusive prefix sum of out-degrees, n + 1 rows; the last is the number of edges."""
    counted = degrees(graph).select("v", "out_degree", F.floor(F.col("v") / BLOCK).alias("block"))
    inside = Window.partitionBy("block").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = counted.withColumn("upto", F.sum("out_degree").over(inside))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    totals = counted.groupBy("block").agg(F.sum("out_degree").alias("total")).select("block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("first"))
    offsets = running.join(totals, "block").select("v", (F.col("first") + F.col("upto") - F.col("out_degree")).alias("off"))
    last = graph.vertices.agg(F.count("*").alias("v")).join(graph.edges.agg(F.count("*").alias("off")), how="cross")  # one row each
    return offsets.unionByName(last)


def graph_stats(graph: Graph) -> DataFrame:
    """n_vertices, n_edges, self_loops, repeated_edges, max_degree and its vertex (the smallest of them) in one row."""
    own = graph.edges.groupBy("src", "dst").agg(F.count("*").alias("times"))
    edges = own.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("n_edges"), F.coalesce(F.sum(F.when(F.col("src") == F.col("dst"), F.col("times"))), F.lit(0)).alias("self_loops"), F.coalesce(F.sum(F.col("times") - 1), F.lit(0)).alias("repeated_edges"))
    top = degrees(graph).agg(F.count("*").alias("n_vertices"), F.max(F.struct((F.col("out_degree") + F.col("in_degree")).alias("d"), (-F.col("v")).alias("v"))).alias("m"))
    return edges.join(top, how="cross").select("n_vertices", "n_edges", "self_loops", "repeated_edges", F.col("m.d").alias("max_degree"), (-F.col("m.v")).alias("top_vertex"))


def pivot(graph: Graph, within: DataFrame | None = None) -> DataFrame:
    """(v, degree): the vertex of the largest degree in the whole graph, of those in `within`; of equal ones the smallest."""
    counted = degrees(graph)
    if within is not None:
        counted = counted.join(within.select("v"), "v", "left_semi")
    best = counted.agg(F.max(F.struct((F.col("out_degree") + F.col("in_degree")).alias("degree"), (-F.col("v")).alias("v"))).alias("m"))
    return best.where("m IS NOT NULL").select((-F.col("m.v")).alias("v"), F.col("m.degree").alias("degree"))
