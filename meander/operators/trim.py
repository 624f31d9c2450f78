"""Iterated peeling of vertices without an edge in or without an edge out, by counts that what goes is taken off."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..storage import stash
from .blocks import NONE, Blocks, View, peel_step, waves_step
from .reach import fixpoint

#: The wave of a vertex that no wave peels.
NEVER = 1 << 40


def _gone(view: View, data: np.ndarray) -> dict:
    wave = data[len(view.nodes) : 2 * len(view.nodes) : 2]
    some = np.flatnonzero(wave)
    return {"v": view.nodes[2 * some] >> 1, "wave": wave[some]}


def _wave_of(view: View, data: np.ndarray) -> dict:
    some = np.flatnonzero(data[: len(view.nodes) // 2] < NONE)
    return {"v": view.nodes[2 * some] >> 1, "wave": data[some]}


def _peeled(graph: Graph, sides: tuple[int, ...]) -> DataFrame | None:
    """(v, wave) of what goes; None where a block would be too large. A vertex costs its edges once, when it goes."""
    blocks = Blocks.of(graph)
    if blocks is None:
        return None
    return blocks.finish(blocks.run(peel_step(sides), None), _gone, "v long, wave long", "peeled")


def _without(graph: Graph, gone: DataFrame) -> Graph:
    kept = stash(graph.vertices.join(gone, "v", "left_anti"), "kept")
    return Graph(kept, stash(graph.subgraph(kept).edges, "edges"))


def peel(graph: Graph) -> tuple[Graph, DataFrame]:
    """What is left after all peeling, and (v) of what has gone. A self-loop is an edge in and out of its vertex.

    Peeling goes on inside a block until nothing in it can go, so long chains take as many supersteps as they cross blocks.
    """
    gone = _peeled(graph, (0, 1))
    if gone is None:
        return _trim_joined(graph)
    return (graph, gone.select("v")) if gone.isEmpty() else (_without(graph, gone), gone.select("v"))


def peeled_in(blocks: Blocks) -> DataFrame:
    """(v) of what peeling takes, over blocks that are there and stay.

    A path between two vertices that are left goes through none that has gone: it would lie between two cycles. So the same
    blocks serve searches among what is left.
    """
    return blocks.rows_of(blocks.run(peel_step(), None), _gone, "v long, wave long", "peeled").select("v")


def trim(graph: Graph, most_waves: int | None = None) -> tuple[Graph, DataFrame]:
    """What is left, and (v, wave) of what was peeled, from wave 1: in a wave go all that lack an edge in or out.

    Blocks go through waves by themselves and again where news from others makes waves earlier (waves_step), so there are as
    many supersteps as such news crosses borders, however many waves there are.
    """
    blocks = Blocks.of(graph)
    if blocks is None:
        return _trim_joined(graph, most_waves)
    gone = blocks.finish(blocks.run(waves_step(most_waves), None), _wave_of, "v long, wave long", "peeled")
    return _without(graph, gone), gone


def layers(graph: Graph) -> DataFrame:
    """(v, layer): the number of vertices on the longest path that starts at v, 1 for a vertex without edges out.

    For acyclic graphs: vertices that reach a cycle have no row.
    """
    gone = _peeled(graph, (1,))
    if gone is None:
        return _layers_joined(graph)
    return gone.withColumnRenamed("wave", "layer")


def _layers_joined(graph: Graph) -> DataFrame:
    """layers() by joins, for graphs with a vertex of very many edges."""
    sides = stash(graph.edges.select(F.col("dst").alias("u"), F.col("src").alias("v"), F.lit(1).alias("way")).unionByName(graph.vertices.select(F.col("v").alias("u"), "v", F.lit(0).alias("way"))), "sides")

    def step(state: DataFrame) -> DataFrame:
        last = F.coalesce(F.max(F.when(F.col("way") == 1, F.col("layer"))), F.lit(0))
        return state.withColumnRenamed("v", "u").join(sides, "u").groupBy("v").agg(F.least(F.lit(NEVER), last + 1).alias("layer"))

    found = fixpoint(graph.vertices.select("v", F.lit(NEVER).cast("long").alias("layer")), step, "layer", "layers")
    return found.where(F.col("layer") < NEVER)


def _trim_joined(graph: Graph, most_waves: int | None = None) -> tuple[Graph, DataFrame]:
    """trim() by joins of the whole state, for graphs with a vertex of very many edges.

    A vertex goes one wave after the last of its neighbours in has gone, or the last of those out, whichever is first; with
    none on a side it goes in the first.
    """
    ends = graph.edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(0).alias("way")).unionByName(graph.edges.select(F.col("dst").alias("u"), F.col("src").alias("v"), F.lit(1).alias("way")))
    sides = stash(ends.unionByName(graph.vertices.select(F.col("v").alias("u"), "v", F.lit(2).alias("way"))), "sides")

    def step(state: DataFrame) -> DataFrame:
        joined = state.withColumnRenamed("v", "u").join(sides, "u")
        last = [F.coalesce(F.max(F.when(F.col("way") == way, F.col("wave"))), F.lit(0)) for way in (0, 1)]
        return joined.groupBy("v").agg(F.least(F.lit(NEVER), F.least(*last) + 1).alias("wave"))

    waves = fixpoint(graph.vertices.select("v", F.lit(NEVER).cast("long").alias("wave")), step, "wave", "waves", most_waves)
    kept = waves.where(F.col("wave") == NEVER).select("v")
    rest = graph.subgraph(kept)
    return Graph(rest.vertices, stash(rest.edges, "edges")), waves.where(F.col("wave") < NEVER)
