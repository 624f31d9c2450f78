"""Strongly connected components of a graph that fits one task."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def tarjan(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Component numbers of vertices 0 .. n - 1, in the order in which components end: sinks of the condensation first.

    Numbers are kept in arrays of 4 and 8 bytes: in lists each would be an object of 32 bytes and its address.
    """
    targets = array("i", dst[np.argsort(src, kind="stable")].astype(np.int32).tobytes())
    first = array("q", _starts(n, src).tobytes())
    index, low, found = array("i", [-1]) * n, array("i", [0]) * n, array("i", [-1]) * n
    waiting = array("i")
    clock = components = 0
    for start in range(n):
        if index[start] >= 0:
            continue
        path, at = array("i", [start]), array("q", [first[start]])
        index[start] = low[start] = clock
        clock += 1
        waiting.append(start)
        while path:
            v, i = path[-1], at[-1]
            if i < first[v + 1]:
                at[-1] = i + 1
                w = targets[i]
                if index[w] < 0:
                    index[w] = low[w] = clock
                    clock += 1
                    waiting.append(w)
                    path.append(w)
                    at.append(first[w])
                elif found[w] < 0 and index[w] < low[v]:
                    low[v] = index[w]
                continue
            path.pop()
            at.pop()
            if path and low[v] < low[path[-1]]:
                low[path[-1]] = low[v]
            if low[v] == index[v]:
                while True:
                    w = waiting.pop()
                    found[w] = components
                    if w == v:
                        break
                components += 1
    return np.frombuffer(found, np.int32).astype(np.int64)


#: Edges below which depth-first search takes what is left, and waves of peeling before that.
SMALL, WAVES = 20_000, 16


def _starts(n: int, ends: np.ndarray) -> np.ndarray:
    first = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(ends, minlength=n), out=first[1:])
    return first


def _marked(n: int, ends: np.ndarray) -> np.ndarray:
    mask = np.zeros(n, bool)
    mask[ends] = True
    return mask


def _targets(ends: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The other ends of edges in order of one end; both are below 2**31, as one task's arrays are."""
    keys = ends.astype(np.int64)
    keys <<= 32
    keys |= others
    keys.sort()
    keys &= 0xFFFFFFFF
    return keys.astype(np.int32)


def _reached(first: np.ndarray, targets: np.ndarray, start: int) -> np.ndarray:
    """Mask of the vertices that `start` reaches, a level at a time."""
    seen = np.zeros(len(first) - 1, bool)
    seen[start] = True
    frontier = np.array([start])
    while len(frontier):
        count = first[frontier + 1] - first[frontier]
        total = int(count.sum())
        place = np.repeat(first[frontier] - np.cumsum(count) + count, count)
        place += np.arange(total)
        near = targets[place]
        del place
        near = near[~seen[near]]
        seen[near] = True
        frontier = np.unique(near) if len(near) < len(seen) // 8 else np.flatnonzero(_marked(len(seen), near))
    return seen


def _peeled(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges that a few waves of peeling leave."""
    for _ in range(WAVES):
        stays = _marked(n, src) & _marked(n, dst)
        kept = stays[src] & stays[dst]
        if kept.all():
            break
        src, dst = src[kept], dst[kept]
    return src, dst


def labels_of(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The smallest vertex of each vertex's component, for vertices 0 .. n - 1.

    Peeling and searches both ways from the vertex of the largest degree are whole-array steps and take off the bulk of
    most graphs; what they leave goes to depth-first search. Long chains end there as well, in linear time. Vertices are kept
    in 4 bytes.
    """
    label = np.arange(n)
    src, dst = src.astype(np.int32, copy=False), dst.astype(np.int32, copy=False)
    edges = src != dst
    if not edges.all():
        src, dst = src[edges], dst[edges]
    src, dst = _peeled(n, src, dst)
    if len(src) > SMALL:
        degree = np.bincount(src, minlength=n)
        degree += np.bincount(dst, minlength=n)
        pivot = int(degree.argmax())
        del degree
        down = _reached(_starts(n, src), _targets(src, dst), pivot)
        up = _reached(_starts(n, dst), _targets(dst, src), pivot)
        both = down & up
        label[both] = np.flatnonzero(both)[0]
        # A component lies in one of the four parts that the two searches make; the pivot's own is done.
        part = 2 * down.astype(np.uint8) + up
        kept = (part[src] == part[dst]) & ~both[src]
        src, dst = _peeled(n, src[kept], dst[kept])
    if len(src):
        ids, place = _numbering([src, dst])
        number = tarjan(len(ids), place(src), place(dst))
        least = np.full(int(number.max()) + 1, n)
        np.minimum.at(least, number, ids)
        label[ids] = least[number]
    return label


#: Ids that are looked up at a time.
LOOKED_UP = 1 << 20


def _numbering(columns: list[np.ndarray]) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """Distinct ids of all columns in order, and what gives the places of ids in them, in 4 bytes each.

    Dense ids are marked, a bit each, and a place is the number of marks before it; others are sorted and searched.
    """
    size = sum(map(len, columns))
    top = max((int(c.max(initial=-1)) for c in columns), default=-1)
    if min((int(c.min(initial=0)) for c in columns), default=0) >= 0 and top < 8 * size + 1024:
        mark = np.zeros(top + 1, bool)
        for c in columns:
            mark[c] = True
        ids, marks = np.flatnonzero(mark), np.packbits(mark, bitorder="little")
        before = np.cumsum(np.bitwise_count(marks), dtype=np.int32)
        before -= np.bitwise_count(marks)
        lower = np.array([(1 << bit) - 1 for bit in range(8)], np.uint8)

        def find(wanted: np.ndarray) -> np.ndarray:
            byte = wanted >> 3
            return before[byte] + np.bitwise_count(marks[byte] & lower[wanted & 7])

    else:
        ids = np.unique(np.concatenate([np.unique(c) for c in columns]))

        def find(wanted: np.ndarray) -> np.ndarray:
            return np.searchsorted(ids, wanted)

    def place(wanted: np.ndarray) -> np.ndarray:
        out = np.empty(len(wanted), np.int32)
        for i in range(0, len(wanted), LOOKED_UP):
            out[i : i + LOOKED_UP] = find(wanted[i : i + LOOKED_UP])
        return out

    return ids, place


def least_members(v: np.ndarray, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices with the smallest vertex of their component. Ends of edges need not be among `v`."""
    ids, place = _numbering([v, src, dst])
    return ids, ids[labels_of(len(ids), place(src), place(dst))]


#: Edges in one packed row.
PACKED = 1_000_000


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of many edges as two byte strings, so that few rows are moved to the one task."""
    held, size = [], 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([np.concatenate([b.column(i).to_numpy() for b in held]).tobytes()], pa.binary()) for i in (0, 1)], ["src", "dst"])

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= PACKED:
            yield row()
            held, size = [], 0
    if size:
        yield row()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of the edges in all packed rows. A row's own bytes go as soon as its edges are apart from its vertices."""
    alone, src, dst = [], [], []
    for batch in batches:
        for k in range(batch.num_rows):
            a, b = (np.frombuffer(batch.column(i)[k].as_buffer(), np.int64) for i in (0, 1))
            edges = a != b
            for held, x in ((alone, a[~edges]), (src, a[edges]), (dst, b[edges])):
                held.append(x)
            del a, b
        del batch
    if alone:
        ids, place = _numbering(alone + src + dst)
        alone.clear()
        a, b = (np.concatenate([place(held.pop(0)) for _ in range(len(held))]) for held in (src, dst))
        least = ids[labels_of(len(ids), a, b)]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(least)], ["v", "scc"])


def components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(v, scc) of the ends of a bounded edge table and of `vertices` (v), in one task. The caller has counted the edges."""

    both = edges.select("src", "dst")
    if vertices is not None:  # a vertex is there as an edge to itself
        both = both.unionByName(vertices.select(vertices["v"].alias("src"), vertices["v"].alias("dst")))
    return both.mapInArrow(_pack, "src binary, dst binary").repartition(1).mapInArrow(_unpacked, "v long, scc long")


#: Edges of parts that a task solves at a time: whole parts, so the largest part comes on top.
AT_ONCE = 500_000


def components_of_parts(edges: DataFrame, part: list[str]) -> DataFrame:
    """(v, scc) of the ends of edges (src, dst, *part) between whose parts no component reaches; parts have bounded sizes.

    Parts are dealt to tasks by their key and come one after another, so a task holds AT_ONCE edges and a part, whatever the
    number of parts. Parts have no edges between them, so several are solved as one graph.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def solved(src: np.ndarray, dst: np.ndarray) -> pa.RecordBatch:
            ids, least = least_members(src[:0], src, dst)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(least)], ["v", "scc"])

        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(i).to_numpy() for i in range(batch.num_columns)])
                size += batch.num_rows
            if size < AT_ONCE:
                continue
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            same = np.logical_and.reduce([c == c[-1] for c in columns[2:]])
            whole = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0  # where the last part begins
            if whole:
                yield solved(columns[0][:whole], columns[1][:whole])
            held = [[c[whole:] for c in columns]]
            size = len(same) - whole
        if size:
            yield solved(*(np.concatenate(c) for c in list(zip(*held, strict=True))[:2]))

    return edges.select("src", "dst", *part).repartition(*part).sortWithinPartitions(*part).mapInArrow(run, "v long, scc long")
