"""Pairs of vertices and centres, by way of components: what one vertex of a component reaches, all of it reach.

Searches run over the graph of components, which has no cycles and, in most graphs, far fewer edges, with one centre for all
centres of a component. Vertices and centres of components are put in place of them at the very end, in what is given back:
nothing but that has a row a pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..storage import dealt, stash
from .reach import multi_reach
from .scc import FEW, scc

#: Vertices that one row of a component's members or centres may hold, about.
CHUNK = 1_000
#: Edges, both ways counted, of a graph of components that is one block: a pass over it with 1,024 centres is one superstep.
WHOLE = 4_000_000
#: Tasks at least, and at most, among which the members of a large component are dealt.
TASKS, SALTS = 64, 256


def _searched(graph: Graph, centres: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """Labels (v, scc), pairs (scc, centre) of components, centres (centre, label), and whether centres are few.

    centre is the component of a centre, that is itself called label.
    """
    labels = dealt(stash(scc(graph), "labels"))
    own = stash(labels.join(centres.select("v").distinct(), "v", "left_semi").select(F.col("scc").alias("centre"), F.col("v").alias("label")), "centres")
    ends = [labels.select(F.col("v").alias(end), F.col("scc").alias(f"{end}_scc")) for end in ("src", "dst")]
    between = graph.edges.join(ends[0], "src").join(ends[1], "dst").where("src_scc <> dst_scc").select(F.col("src_scc").alias("src"), F.col("dst_scc").alias("dst")).distinct()
    acyclic = Graph(labels.where("v = scc").select("v"), stash(between, "edges"))
    found = multi_reach(acyclic, own.select(F.col("centre").alias("v")).distinct(), whole=WHOLE)
    return labels, found.select(F.col("v").alias("scc"), F.col("label").alias("centre")), own, own.count() <= FEW


def _expanded(labels: DataFrame, pairs: DataFrame, own: DataFrame, few: bool) -> DataFrame:
    """(v, label) for each member v and each centre of pairs (scc, centre). Members of a component come in chunks, dealt to tasks."""
    sizes = stash(labels.groupBy("scc").agg(F.ceil(F.count("*") / CHUNK).alias("chunks")).where("chunks > 1"), "sizes")  # a row for CHUNK vertices at most
    sizes = F.broadcast(sizes) if sizes.count() <= FEW else dealt(sizes)
    salt = F.pmod("chunk", F.lit(SALTS)).alias("salt")
    members = labels.join(sizes, "scc", "left").withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("v"), F.col("chunks")), F.lit(0)))
    members = members.groupBy("scc", "chunk").agg(F.collect_list("v").alias("members")).select("scc", salt, "members")
    salts = F.sequence(F.lit(0).cast("long"), F.least(F.coalesce("chunks", F.lit(1)), F.lit(SALTS)) - 1)
    wanted = pairs.join(sizes, "scc", "left").select("scc", "centre", F.explode(salts).alias("salt"))
    # Few bytes become very many rows, so the number of tasks is not left to the bytes.
    tasks = max(TASKS, 4 * labels.sparkSession.sparkContext.defaultParallelism)
    met = dealt(wanted.repartition(tasks, "scc", "salt")).join(members.repartition(tasks, "scc", "salt"), ["scc", "salt"])
    lists = own.groupBy("centre", F.pmod("label", F.lit(16)).alias("part")).agg(F.collect_list("label").alias("labels")).drop("part")
    rows = met.join(F.broadcast(lists) if few else dealt(lists), "centre").select("members", "labels")
    return rows.select(F.explode("members").alias("v"), "labels").select("v", F.explode("labels").alias("label"))


def reached(graph: Graph, centres: DataFrame) -> DataFrame:
    """(v, label): all pairs of a vertex and a centre (v) that reaches it, itself included."""
    return _expanded(*_searched(graph, centres))


def mutual(graph: Graph, centres: DataFrame) -> DataFrame:
    """(v, label): all pairs of a vertex and a centre (v) that reach each other, which are in one component."""
    labels = dealt(stash(scc(graph), "labels"))
    own = stash(labels.join(centres.select("v").distinct(), "v", "left_semi").select(F.col("scc").alias("centre"), F.col("v").alias("label")), "centres")
    pairs = own.select(F.col("centre").alias("scc"), "centre").distinct()
    return _expanded(labels, pairs, own, own.count() <= FEW)


def totals(graph: Graph, centres: DataFrame) -> DataFrame:
    """(label, reached, total): how many vertices each centre (v) reaches, itself included, and the sum of their ids."""
    labels, pairs, own, _ = _searched(graph, centres)
    sizes = labels.groupBy("scc").agg(F.count("*").alias("n"), F.sum("v").alias("ids"))
    sums = pairs.join(sizes, "scc").groupBy("centre").agg(F.sum("n").alias("reached"), F.sum("ids").alias("total"))
    return dealt(own).join(sums, "centre").select("label", "reached", "total")
