"""Labellings compared, counted and contracted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import BLOCK, Graph
from .order import positions
from .trim import layers


def normalise(labels: DataFrame, v: str = "v", label: str = "scc") -> DataFrame:
    """(v, label): classes numbered from 0 in the order in which their first vertex comes. Unlabelled vertices are left out.

    Only classes are ranked, one row each, by their smallest vertex: within ranges of BLOCK ids, and ranges by their sizes.
    """
    some = labels.where(F.col(label).isNotNull())
    first = some.groupBy(label).agg(F.min(v).alias("rep")).withColumn("block", F.floor(F.col("rep") / BLOCK))
    inside = first.withColumn("in_block", F.row_number().over(Window.partitionBy("block").orderBy("rep")))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    shift = first.groupBy("block").agg(F.count("*").alias("size")).select("block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shift"))
    ranked = inside.join(shift, "block").select(label, (F.col("shift") + F.col("in_block") - 1).alias("rank"))
    return some.join(ranked, label).select(v, F.col("rank").alias("label"))


def least_member(labels: DataFrame, v: str = "v", label: str = "scc") -> DataFrame:
    """(v, rep): every vertex with the smallest of its class, which names a class alike in all labellings."""
    some = labels.where(F.col(label).isNotNull())
    return some.join(some.groupBy(label).agg(F.min(v).alias("rep")), label).select(v, "rep")


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: only_a, only_b (vertices in one labelling), different (in both, in another class), equal."""
    joined = least_member(a).withColumnRenamed("rep", "ra").join(least_member(b).withColumnRenamed("rep", "rb"), "v", "full_outer")
    one = joined.agg(F.count_if(F.col("rb").isNull()).alias("only_a"), F.count_if(F.col("ra").isNull()).alias("only_b"), F.count_if(F.col("ra") != F.col("rb")).alias("different"))
    return one.withColumn("equal", (F.col("only_a") + F.col("only_b") + F.col("different")) == 0)


def sizes(labels: DataFrame) -> DataFrame:
    """(scc, size) of the labelled vertices."""
    return labels.where(F.col("scc").isNotNull()).groupBy("scc").agg(F.count("*").alias("size"))


def summary(labels: DataFrame) -> DataFrame:
    """One row: num_sccs, max_scc_size (0 without vertices), singletons."""
    return sizes(labels).agg(F.count("*").alias("num_sccs"), F.coalesce(F.max("size"), F.lit(0)).alias("max_scc_size"), F.count_if(F.col("size") == 1).alias("singletons"))


def count_classes(labels: DataFrame, approximate: bool = False, rsd: float = 0.01) -> DataFrame:
    """num_sccs in one row, exact or by a sketch; null labels do not count."""
    return labels.agg((F.approx_count_distinct("scc", rsd) if approximate else F.countDistinct("scc")).alias("num_sccs"))


def histogram(labels: DataFrame) -> DataFrame:
    """(size, components)."""
    return sizes(labels).groupBy("size").agg(F.count("*").alias("components"))


def condensation(graph: Graph, labels: DataFrame) -> DataFrame:
    """(src, dst, edges): edges between components, with their number in the graph."""
    source, target = (labels.select(F.col("v").alias(end), F.col("scc").alias(f"scc_{end}")) for end in ("src", "dst"))
    joined = graph.edges.join(source, "src").join(target, "dst").where("scc_src <> scc_dst")
    return joined.groupBy(F.col("scc_src").alias("src"), F.col("scc_dst").alias("dst")).agg(F.count("*").alias("edges"))


def topological(graph: Graph, labels: DataFrame) -> DataFrame:
    """(v, label): components (v, scc) numbered from 0 so that along every edge between two of them the number falls.

    This is the order in which depth-first search completes components, made one: by the longest path of components that
    starts at one, then by its smallest vertex. Paths are found by peeling the condensation from its ends, layer by layer.
    """
    edges = condensation(graph, labels).select("src", "dst")
    found = layers(Graph(labels.select(F.col("scc").alias("v")).distinct(), edges))
    order = positions(found, ["layer", "v"], "label").select(F.col("v").alias("scc"), "label")
    return labels.join(order, "scc").select("v", "label")
