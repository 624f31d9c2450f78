"""Graphs as blocks of adjacency, and fixpoints that run inside a block before anything is exchanged.

A block is one row: the vertices of a range of ids, the offsets and targets of their edges, and the targets that lie in other
blocks (ghosts). Blocks are written once, bucketed by their number. A superstep joins them with the state of the step
before, which is bucketed alike, so neither moves; only messages are shuffled, and they are what changed at the
borders of blocks: a vertex that has not changed, or lies inside, sends nothing. Within a block a step goes on, as whole-array
operations on the vertices that have changed, until nothing in it changes any more, however many hops that takes.

Each vertex v is two nodes, 2 v for paths along the edges and 2 v + 1 for paths against them, side by side in one block, so
one layout serves searches both ways and peeling.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..storage import dealt, forget, new_folder, stash

#: Nodes of a block at most. Below that, a graph makes two blocks a core as long as these have LEAST_EDGES each: with fewer, a
#: superstep costs more than the edges in it.
WIDEST, LEAST_EDGES = 1 << 17, 1 << 17
#: Edges that a block may have; a graph with a vertex of more takes the plain joins instead (see reach.py).
BLOCK_EDGES = 20_000_000
#: Buckets at most: with more blocks than this, a task has several.
BUCKETS = 50_000
#: No value, above all others.
NONE = 1 << 62

BLOCK = "block long, nodes binary, offsets binary, targets binary, ghosts binary"
STATE = "block long, target long, ids binary, data binary, more boolean"


def _array(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def _at(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of values that are known to be there, in a sorted array."""
    return np.searchsorted(values, wanted)


def built(block: int, src: np.ndarray, dst: np.ndarray, bits: int) -> tuple:
    """A row of BLOCK. Rows with a dst below 0 stand for vertices."""
    nodes = np.unique(src)
    own = dst >= 0
    src, dst = src[own], dst[own]
    order = np.argsort(src, kind="stable")
    src, dst = src[order], dst[order]
    offsets = np.zeros(len(nodes) + 1, np.int64)
    np.cumsum(np.bincount(_at(nodes, src), minlength=len(nodes)), out=offsets[1:])
    away = dst >> bits != block
    ghosts = np.unique(dst[away])
    targets = np.where(away, len(nodes) + _at(ghosts, dst), _at(nodes, dst)).astype(np.int32)
    return nodes, offsets, targets, ghosts


@dataclass(frozen=True)
class View:
    """A block in a task."""

    nodes: np.ndarray
    offsets: np.ndarray
    targets: np.ndarray
    ghosts: np.ndarray

    def after(self, frontier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Targets of all edges out of places `frontier`, and how many each has."""
        number = self.offsets[frontier + 1] - self.offsets[frontier]
        first = self.offsets[frontier] - np.cumsum(number) + number
        return self.targets[np.repeat(first, number) + np.arange(int(number.sum()))], number


#: What a block does in a superstep. From its view, its data (None at first), messages as (ids, data) and the number of the
#: superstep come its data, the places of ghosts to send to, arrays with what each is sent, and whether it has more to do.
Step = Callable[[View, np.ndarray | None, list[tuple[np.ndarray, np.ndarray]], int], tuple[np.ndarray, np.ndarray, list[np.ndarray], bool]]


class Blocks:
    """The blocks of a graph, written. `close` deletes them and the last state."""

    def __init__(self, spark: SparkSession, bits: int, buckets: int):
        self.spark, self.bits, self.buckets = spark, bits, buckets
        self.tables: list[tuple[str, str]] = []
        #: Supersteps and messages (values sent to other blocks) of the last run().
        self.steps = self.sent = 0

    @classmethod
    def of(cls, graph: Graph, whole: int = 0) -> Blocks | None:
        """None where a block would have more than BLOCK_EDGES edges. whole: with no more edges than this, both ways counted,
        and as many vertices at most, the graph is one block."""
        spark = graph.edges.sparkSession
        edges = graph.edges.select(F.explode(F.array(F.struct((2 * F.col("src")).alias("s"), (2 * F.col("dst")).alias("d")), F.struct((2 * F.col("dst") + 1).alias("s"), (2 * F.col("src") + 1).alias("d")))).alias("e")).select("e.*")
        # A row for each WIDEST nodes, so the widest block is counted here and narrower ones have no more.
        ranges = edges.groupBy(F.shiftright("s", WIDEST.bit_length() - 1).alias("range")).agg(F.count("*").alias("m"), F.max(F.greatest("s", "d")).alias("top")).collect()
        most, m, n = max((r["m"] for r in ranges), default=0), sum(r["m"] for r in ranges), max((r["top"] for r in ranges), default=0) + 1
        if most > BLOCK_EDGES:
            return None
        wanted = max(1, min(2 * spark.sparkContext.defaultParallelism, m // LEAST_EDGES))
        width = max(2, n) if max(m, n) <= whole else min(WIDEST, max(2, -(-n // wanted)))
        bits = width.bit_length() - (width & (width - 1) == 0)
        ends = graph.vertices.select(F.explode(F.array(2 * F.col("v"), 2 * F.col("v") + 1)).alias("s"), F.lit(-1).cast("long").alias("d"))
        rows = edges.unionByName(ends).withColumn("block", F.shiftright("s", bits))
        buckets = max(1, min(-(-n >> bits), BUCKETS))
        self = cls(spark, bits, buckets)

        def build(table: pa.Table) -> pa.Table:
            block = table.column("block")[0].as_py()
            row = built(block, table.column("s").to_numpy(), table.column("d").to_numpy(), bits)
            return pa.table({"block": pa.array([block], pa.int64()), **{k: pa.array([x.tobytes()], pa.binary()) for k, x in zip(("nodes", "offsets", "targets", "ghosts"), row, strict=True)}})

        self.blocks, _ = self._write(rows.repartition(buckets, "block").groupBy("block").applyInArrow(build, BLOCK), "blocks")
        return self

    def _write(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        """A table bucketed by block, and its path: tasks that hold whole buckets write and read them without a shuffle."""
        path, table = new_folder(self.spark, name), f"meander_{name}_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "block").format("parquet").option("path", path).saveAsTable(table)
        self.tables.append((table, path))
        return self.spark.table(table), path

    def close(self) -> None:
        for table, path in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            forget(self.spark, path)
        self.tables = []

    def messages(self, start: DataFrame, several: bool = False) -> DataFrame:
        """Rows (node, value) as messages to the nodes' blocks. several: value is an array, of one length."""

        def pack(table: pa.Table) -> pa.Table:
            target, ids = (table.column(c).to_numpy() for c in ("target", "node"))
            data = table.column("value").combine_chunks().flatten().to_numpy().reshape(len(ids), -1).T if several else table.column("value").to_numpy()
            return pa.table({"target": pa.array(target[:1]), "ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([data.tobytes()], pa.binary())})

        rows = start.select(F.shiftright("node", self.bits).alias("target"), F.col("node").cast("long").alias("node"), F.col("value").cast("array<long>" if several else "long").alias("value"))
        return rows.groupBy("target").applyInArrow(pack, "target long, ids binary, data binary")

    def run(self, step: Step, start: DataFrame | None, most_steps: int | None = None, tail: float = 0.0) -> DataFrame:
        """The state after supersteps until no block has anything to send, or after `most_steps`.

        start: messages() of the first superstep; None where blocks begin by themselves. tail: ends as well when less than this
        share is sent of what was sent in one superstep at most, and what is sent then is lost.
        """
        bits = self.bits

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = {n: batch.column(i)[k].as_py() for i, n in enumerate(batch.schema.names)}
                    yield from one(row)

        def rows_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["block", "target", "ids", "data", "more"])

        def one(row: dict) -> Iterator[pa.RecordBatch]:
            if row["data"] is not None and not row["messages"] and not row["more"]:
                yield rows_of([(row["block"], None, None, row["data"], False)])
                return
            view = View(_array(row["nodes"]), _array(row["offsets"]), np.frombuffer(row["targets"], np.int32), _array(row["ghosts"]))
            got = [(_array(m["ids"]), _array(m["data"])) for m in row["messages"] or ()]
            data, places, sent, more = step(view, None if row["data"] is None else _array(row["data"]), got, row["now"])
            yield rows_of([(row["block"], None, None, data.tobytes(), more)])
            if len(places):
                ids = view.ghosts[places]
                to = ids >> bits  # ghosts are sorted, so those of one block are next to each other
                cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True])
                yield rows_of([(row["block"], int(to[a]), ids[a:b].tobytes(), np.concatenate([x[a:b] for x in sent]).tobytes(), False) for a, b in zip(cuts, cuts[1:], strict=False)])

        state = path = None
        self.steps = self.sent = peak = 0
        while most_steps is None or self.steps < most_steps:
            joined = self.blocks
            if state is None:
                joined = joined.select("*", F.lit(None).cast("binary").alias("data"), F.lit(False).alias("more"))
                messages = start
            else:
                joined = joined.hint("merge").join(state.where("target IS NULL").select("block", "data", "more"), "block")
                messages = state.where("target IS NOT NULL").select("target", "ids", "data")
            if messages is None:
                joined = joined.withColumn("messages", F.lit(None).cast("array<struct<ids: binary, data: binary>>"))
            else:
                # Dealt as the blocks are, so that they are shuffled once.
                grouped = messages.withColumnRenamed("target", "block").repartition(self.buckets, "block").groupBy("block").agg(F.collect_list(F.struct("ids", "data")).alias("messages"))
                joined = joined.hint("merge").join(grouped, "block", "left")
            seen = Observation()
            found = F.coalesce(F.sum(F.octet_length("ids") / 8), F.lit(0)), F.coalesce(F.max("more"), F.lit(False))
            out = joined.withColumn("now", F.lit(self.steps + 1)).mapInArrow(task, STATE).observe(seen, found[0].alias("sent"), found[1].alias("more"))
            state, new_path = self._write(out, "state")
            if path is not None:
                forget(self.spark, path)  # its name goes with the others, at close()
            path = new_path
            self.steps += 1
            self.sent += int(seen.get["sent"])
            peak = max(peak, seen.get["sent"])
            if tail and seen.get["sent"] < tail * peak:
                break
            if not seen.get["sent"] and not seen.get["more"]:
                break
        return state.where("target IS NULL").select("block", "data")

    def rows_of(self, state: DataFrame, rows: Callable[[View, np.ndarray], dict], schema: str, name: str) -> DataFrame:
        """What `rows` makes of each block and its data, written. Both tables are bucketed by block: nothing is shuffled."""

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    nodes, offsets, targets, ghosts, data = (batch.column(i)[k].as_py() for i in range(5))
                    made = rows(View(_array(nodes), _array(offsets), np.frombuffer(targets, np.int32), _array(ghosts)), _array(data))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in made.values()], list(made))

        return dealt(stash(self.blocks.join(state.hint("merge"), "block").select("nodes", "offsets", "targets", "ghosts", "data").mapInArrow(task, schema), name))

    def finish(self, state: DataFrame, rows: Callable[[View, np.ndarray], dict], schema: str, name: str) -> DataFrame:
        """rows_of(), after which the blocks are deleted."""
        out = self.rows_of(state, rows, schema, name)
        self.close()
        return out


# ---- what blocks do


def spread(view: View, values: np.ndarray, frontier: np.ndarray, cost: int, most: int) -> None:
    """Lower the values of all that `frontier` reaches to the least of value and costs, up to `most`, ghosts included."""
    n = len(view.nodes)
    while len(frontier):
        targets, number = view.after(frontier)
        offered = np.repeat(values[frontier], number) + cost
        better = (offered < values[targets]) & (offered <= most)
        targets, offered = targets[better], offered[better]
        if not len(targets):
            return
        np.minimum.at(values, targets, offered)
        frontier = np.unique(targets)
        frontier = frontier[: np.searchsorted(frontier, n)]


def least_step(cost: int, own: bool = False, most: int = NONE) -> Step:
    """Each node takes the least of what reaches it, if no more than `most`. own: nodes begin with the number of their vertex.

    The data are the values of the nodes and the values last sent to ghosts.
    """

    def step(view: View, data: np.ndarray | None, messages: list[tuple[np.ndarray, np.ndarray]], now: int):
        n = len(view.nodes)
        if data is None:
            values = np.full(n + len(view.ghosts), NONE)
            if own:
                values[:n] = view.nodes >> 1
        else:
            values = data.copy()
        before = values.copy()
        for ids, offered in messages:
            there = _at(view.nodes, ids)
            good = (there < n) & (view.nodes[np.minimum(there, n - 1)] == ids)  # a start may be no vertex
            np.minimum.at(values, there[good], offered[good])
        frontier = np.arange(n) if own and data is None else np.flatnonzero(values[:n] < before[:n])
        spread(view, values, frontier, cost, most)
        places = np.flatnonzero(values[n:] < before[n:])
        return values, places, [values[n:][places]], False

    return step


def peel_step(sides: tuple[int, ...] = (0, 1)) -> Step:
    """Vertices go that have no edge left on one of `sides` (0: in, 1: out); what goes is taken off its neighbours' counts, once.

    The data are three numbers a node: the edges that it has left on its side, the wave of its vertex (0 while it is there),
    and the latest wave of those that have gone on its side. A node's edges out are its partner's edges in: 2 v counts the
    edges into v, 2 v + 1 those out of it. Peeling goes on inside a block, and with one side the wave is the number of vertices
    on the longest path that ends with the vertex.
    """
    counted = sides[0] if len(sides) == 1 else None

    def step(view: View, data: np.ndarray | None, messages: list[tuple[np.ndarray, np.ndarray]], now: int):
        n = len(view.nodes)
        if data is None:
            left, wave, latest = np.diff(view.offsets)[np.arange(n) ^ 1], np.zeros(n, np.int64), np.zeros(n, np.int64)
        else:
            left, wave, latest = np.split(data.copy(), 3)
        for ids, numbers in messages:
            at, (gone, from_wave) = _at(view.nodes, ids), np.split(numbers, 2)
            np.subtract.at(left, at, gone)
            np.maximum.at(latest, at, from_wave)
        taken, carried = np.zeros(len(view.ghosts), np.int64), np.zeros(len(view.ghosts), np.int64)

        def ready(places: np.ndarray) -> np.ndarray:
            """The first nodes of vertices at `places` that are to go."""
            if counted is not None:
                places = places[(places & 1) == counted]
            return np.unique(places[(left[places] == 0) & (wave[places] == 0)] & ~1)

        going = ready(np.arange(n))
        while len(going):
            moving = np.concatenate([going, going + 1]) if counted is None else going + counted
            wave[going] = wave[going + 1] = latest[going + (counted or 0)] + 1
            targets, number = view.after(moving)
            near, from_wave = targets < n, np.repeat(wave[moving], number)
            np.subtract.at(left, targets[near], 1)
            np.maximum.at(latest, targets[near], from_wave[near])
            np.add.at(taken, targets[~near] - n, 1)
            np.maximum.at(carried, targets[~near] - n, from_wave[~near])
            going = ready(targets[near].astype(np.int64))
        places = np.flatnonzero(taken)
        return np.concatenate([left, wave, latest]), places, [taken[places], carried[places]], False

    return step


def waves_step(most: int | None = None) -> Step:
    """The wave in which each vertex goes, of peeling that takes all vertices without an edge in or out at once; up to `most`.

    A block goes through all waves by itself, in order, with the waves of ghosts as far as they are known: a ghost of which
    nothing is known stays. So waves are never too early; when a ghost turns out to go, or to go earlier, the block goes
    through its waves again, and what has become earlier is sent on. It ends with the true waves, after as many supersteps
    as such news crosses borders, not as many as there are waves. The data are the waves of vertices and of ghosts, NONE for
    what stays; messages are the node that a ghost stands for and its wave, one for each edge across a border.
    """

    def step(view: View, data: np.ndarray | None, messages: list[tuple[np.ndarray, np.ndarray]], now: int):
        n = len(view.nodes)
        values = np.full(n // 2 + len(view.ghosts), NONE) if data is None else data.copy()
        before, wave, away = values.copy(), values[: n // 2], values[n // 2 :]
        for _, numbers in messages:
            ids, from_wave = np.split(numbers, 2)
            np.minimum.at(away, _at(view.ghosts, ids), from_wave)
        nothing = np.zeros(0, np.int64)
        if data is not None and (away == before[n // 2 :]).all():
            return values, nothing, [nothing, nothing], False
        wave[:] = NONE
        number = np.diff(view.offsets)
        left = number[np.arange(n) ^ 1]
        source = np.repeat(np.arange(n), number)
        border = np.flatnonzero(view.targets >= n)
        # Edges to ghosts that go, in the order of their waves: each takes one off the count of the node's partner.
        known = border[away[view.targets[border] - n] < NONE]
        known = known[np.argsort(away[view.targets[known] - n], kind="stable")]
        times, partners, at, time = away[view.targets[known] - n], source[known] ^ 1, 0, 1
        going = np.flatnonzero((left[::2] == 0) | (left[1::2] == 0))
        while (len(going) or at < len(times)) and (most is None or time <= most):
            wave[going] = time
            near, _ = view.after(np.concatenate([2 * going, 2 * going + 1]))
            end = at + int(np.searchsorted(times[at:], time, "right"))
            touched = np.concatenate([near[near < n], partners[at:end]])
            np.subtract.at(left, touched, 1)
            touched, at = np.unique(touched >> 1), end
            going = touched[(wave[touched] == NONE) & ((left[2 * touched] == 0) | (left[2 * touched + 1] == 0))]
            time = time + 1 if len(going) or at == len(times) else max(time + 1, int(times[at]))
        border = border[wave[source[border] >> 1] < before[source[border] >> 1]]
        border = border[np.argsort(view.targets[border], kind="stable")]
        return values, view.targets[border] - n, [view.nodes[source[border]] ^ 1, wave[source[border] >> 1]], False

    return step


def bits_step(words: int) -> Step:
    """Each node takes the bits of all that reach it, `words` numbers a node; messages carry whole rows of words."""

    def step(view: View, data: np.ndarray | None, messages: list[tuple[np.ndarray, np.ndarray]], now: int):
        n, size = len(view.nodes), len(view.nodes) + len(view.ghosts)
        bits = np.zeros((size, words), np.int64) if data is None else data.reshape(size, words).copy()
        before = bits.copy()
        for ids, offered in messages:
            there = _at(view.nodes, ids)
            good = (there < n) & (view.nodes[np.minimum(there, n - 1)] == ids)
            np.bitwise_or.at(bits, there[good], offered.reshape(words, -1).T[good])
        frontier = np.flatnonzero((bits[:n] != before[:n]).any(axis=1))
        while len(frontier):
            targets, number = view.after(frontier)
            offered = np.repeat(bits[frontier], number, axis=0)
            more = (offered & ~bits[targets]).any(axis=1)
            targets = targets[more]
            np.bitwise_or.at(bits, targets, offered[more])
            frontier = np.unique(targets)
            frontier = frontier[: np.searchsorted(frontier, n)]
        places = np.flatnonzero((bits[n:] != before[n:]).any(axis=1))
        return bits.ravel(), places, list(bits[n:][places].T), False

    return step
