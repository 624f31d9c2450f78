"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits; two link at `threshold` (4) or fewer differing bits. The bits are dealt to three blocks of 22,
21 and 21; of two linked fingerprints one block differs in at most one bit (4 over 3 blocks). On each block the anchors
are the codewords of the binary Golay code of length 23 (the missing bits are zero), a perfect code of covering radius 3:
every value has one anchor within 3 bits, and every value at most one bit away is within 4 bits of that anchor. So a
fingerprint is replicated to every anchor within 3 + 1 bits on each block (16 on the average, by a table of 2,048
syndromes), two linked ones meet at an anchor, and fingerprints are compared there only.

Equal fingerprints are one from the start. An anchor with more than GROUP fingerprints is split once more, exactly: of two
linked fingerprints one of five sub-blocks of 12 or 13 bits is equal, so its members are dealt by each sub-block's value.
What is left in a group are 8-byte numbers; a group is searched breadth-first with the visited ones taken out, so that a
crowd of near copies costs about its size and gives one edge a member, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, stash, texts_of, unsigned_hex
from .components import connected

SEED, SHINGLE, THRESHOLD = 42, 4, 4
#: (first bit, bits) of the blocks, and of the sub-blocks of a large anchor.
BLOCKS = ((0, 22), (22, 21), (43, 21))
PARTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
RADIUS = 3
#: Fingerprints at one anchor beyond which it is split by sub-blocks.
GROUP = 50_000
#: Runs of an equal part up to which pairs are compared by shifting, and beyond which they are dealt by further parts,
#: so many times at most.
RUN, LONG, DEALT = 48, 4096, 2
BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
BYTE_COLUMN = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64, n)
    seen = np.bincount((hashes.view(np.uint8).reshape(n, 8) + BYTE_COLUMN).ravel(), minlength=2048).reshape(8, 256)
    return int.from_bytes(np.packbits(2 * (seen @ BITS_OF_BYTE) > n, axis=1, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp): the fingerprint as a signed BIGINT of the same bits."""
    kind = docs.schema[key].dataType.simpleString()

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter(map(fingerprint, texts_of(batch, "__simhash_text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["k", "fp"])

    return docs.select(F.col(key).alias("k"), F.col(text).alias("__simhash_text")).mapInArrow(run, f"k {kind}, fp long")


def golay_anchors() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome of a 23-bit word: what to add to it for each codeword within RADIUS + 1 bits, and how many there are.

    The generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 makes the code cyclic; a word's syndrome is its
    remainder, and the same for all words of a coset.
    """
    ball = [0]
    for weight in range(RADIUS + 1):
        ball += [w for w in _of_weight(weight + 1)]
    words = np.array(ball, np.int64)
    rest = syndrome(words)
    order = np.argsort(rest, kind="stable")
    count = np.bincount(rest, minlength=2048)
    table = np.zeros((2048, count.max()), np.int64)
    place = np.arange(len(words)) - (np.cumsum(count) - count)[rest[order]]
    table[rest[order], place] = words[order]
    return table, count


def _of_weight(weight: int, length: int = 23) -> Iterator[int]:
    from itertools import combinations

    return (sum(1 << i for i in c) for c in combinations(range(length), weight))


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial."""
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (0b101011100011 << (bit - 11)), rest)
    return rest


def replicate(fps: DataFrame) -> DataFrame:
    """(anchor, fp): every fingerprint at every anchor within RADIUS + 1 bits on a block."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, count = golay_anchors()
        for batch in batches:
            for at in range(0, batch.num_rows, 200_000):
                fp = batch.column(0).slice(at, 200_000).to_numpy(zero_copy_only=False).astype(np.int64)
                bits = fp.view(np.uint64)
                for b, (first, size) in enumerate(BLOCKS):
                    word = (bits >> np.uint64(first) & np.uint64((1 << size) - 1)).astype(np.int64)
                    rest = syndrome(word)
                    n = count[rest]
                    row = np.repeat(np.arange(len(fp)), n)
                    place = np.arange(len(row)) - (np.cumsum(n) - n)[row]
                    anchor = word[row] ^ table[rest[row], place]
                    yield pa.RecordBatch.from_arrays([pa.array(anchor | b << 23), pa.array(fp[row])], ["anchor", "fp"])

    return fps.mapInArrow(run, "anchor long, fp long")


def linked(fps: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) that join the distinct fingerprints exactly as their links do; at most len(fps) - 1 of them.

    Of two linked fingerprints one of threshold + 1 parts of their bits is equal. Short runs of an equal part are compared
    pair by pair, longer ones breadth-first, and very long ones are dealt once more by parts of their other bits.
    """
    parent = np.arange(len(fps))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)

    def breadth_first(left: np.ndarray) -> None:
        while len(left):  # a component at a time: whatever is reached leaves the list
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                x = queue.pop()
                near = np.bitwise_count(fps[left] ^ fps[x]) <= threshold
                if near.any():
                    found = left[near]
                    join(np.full(len(found), x), found)
                    queue.extend(found.tolist())
                    left = left[~near]

    def visit(members: np.ndarray, bits: list[int], depth: int) -> None:
        for part in np.array_split(np.array(bits), threshold + 1):
            mask = np.uint64(sum(1 << int(b) for b in part))
            key = fps[members] & mask
            up = np.argsort(key, kind="stable")
            order, key = members[up], key[up]
            starts = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1]
            length = np.diff(np.r_[starts, len(order)])
            for s, n in zip(starts[length > RUN].tolist(), length[length > RUN].tolist(), strict=True):
                if n > LONG and depth < DEALT:
                    visit(order[s : s + n], [b for b in bits if b not in part], depth + 1)
                else:
                    breadth_first(order[s : s + n])
            short, by = np.repeat(length <= RUN, length), fps[order]
            for shift in range(1, int(length[length <= RUN].max(initial=1))):
                same = np.flatnonzero((key[shift:] == key[:-shift]) & short[shift:])
                if not len(same):
                    break
                near = same[np.bitwise_count(by[same] ^ by[same + shift]) <= threshold]
                join(order[near], order[near + shift])

    visit(np.arange(len(fps)), list(range(64)), 0)
    own = np.flatnonzero(parent != np.arange(len(fps)))
    return own, np.array([root(x) for x in own.tolist()], np.int64)


def compare(placed: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b) edges among the fingerprints of each group, which lie together and in order of `keys`."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys: tuple[np.ndarray, ...] | None = None
        held: list[np.ndarray] = []

        def edges(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            fps = np.unique(group).view(np.uint64)
            if len(fps) < 2:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            a, b = linked(fps)
            return fps[a].view(np.int64), fps[b].view(np.int64)

        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(keys))]
            fp = batch.column(len(keys)).to_numpy(zero_copy_only=False)
            change = np.zeros(len(fp) - 1, bool)
            for column in key:
                change |= column[1:] != column[:-1]
            cut = [0, *(np.flatnonzero(change) + 1).tolist(), len(fp)]
            out_a, out_b = [], []
            for s, e in zip(cut, cut[1:], strict=False):
                now = tuple(column[s] for column in key)
                if held and now != held_keys:
                    a, b = edges(np.concatenate(held))
                    out_a.append(a)
                    out_b.append(b)
                    held = []
                held_keys = now
                held.append(fp[s:e])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])
        if held:
            a, b = edges(np.concatenate(held))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return placed.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def links(fps: DataFrame, group: int = GROUP) -> DataFrame:
    """Edges between distinct fingerprints with the same components as all links.

    fps: distinct fingerprints, written once. The numbers of fingerprints by anchor come first; there are at most
    3 * 4096 anchors, so the list of those to split is small by construction.
    """
    placed = replicate(fps)
    sizes = placed.groupBy("anchor").count().where(F.col("count") > group).select("anchor")
    large = [r["anchor"] for r in sizes.collect()]
    if not large:
        return compare(placed, ["anchor"])
    hot = F.col("anchor").isin(large)
    parts = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.shiftrightunsigned("fp", first).bitwiseAND((1 << size) - 1).alias("value")) for i, (first, size) in enumerate(PARTS)]))
    split = placed.where(hot).select("anchor", "fp", parts.alias("p")).select("anchor", "p.part", "p.value", "fp")
    return compare(placed.where(~hot), ["anchor"]).unionByName(compare(split, ["anchor", "part", "value"]))


#: Stands for a null doc_id inside; below every id that a document has.
NO_ID = -(2**63)


def components(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fingerprint, component_id) of every document; an empty table gives no rows.

    component_id is the smallest id in the document's component. A null id counts as smaller than all others and is
    given back as null; repeated rows give repeated rows.
    """
    found = stash(fingerprints(docs, text, key), "fingerprints")
    nodes = stash(found.groupBy("fp").agg(F.min(F.coalesce(F.col("k"), F.lit(NO_ID))).alias("least")), "nodes")
    roots = stash(connected(links(nodes.select("fp")), "a", "b"), "roots")  # (node, root) of linked fingerprints only
    label = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    label = stash(label, "labels")
    # Tables that hot keys are joined with are written first: Spark splits a skewed side of two plain shuffles only.
    least = stash(label.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = stash(label.join(least, "root").select("fp", "component_id"), "named")
    return found.join(named, "fp").select(F.col("k").alias(key), unsigned_hex("fp").alias("fingerprint"), F.when(F.col("component_id") != NO_ID, F.col("component_id")).alias("component_id"))


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each component of components(), of the smallest id, null being the smallest. Columns stay as they are."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter(map(fingerprint, texts_of(batch, text)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], [*batch.schema.names, "__fp"])

    marked = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__fp", T.LongType())]))
    rows = stash(marked.withColumn("__id", F.monotonically_increasing_id()), "marked")
    nodes = stash(rows.select(F.col("__fp").alias("fp")).distinct(), "nodes")
    return one_of_each(rows, "__fp", stash(connected(links(nodes), "a", "b"), "roots"), key, text).select(*docs.columns)


def chosen_ids(rows: DataFrame, node: str, roots: DataFrame, key: str, text: str) -> DataFrame:
    """(__id), written: of each component of written rows the one of the smallest id and, of these, of the least hash of its text.

    roots: (node, root) of nodes that link to another. Rows are told apart by __id, which was written with them. Each node
    gives one row before anything is joined, so that a crowd of copies is no large group.
    """
    row = F.struct(F.col(key).isNotNull(), F.col(key), F.xxhash64(text), F.col("__id").alias("id"))
    best = stash(rows.groupBy(F.col(node).alias("n")).agg(F.min(row).alias("row")), "best")
    chosen = best.join(roots, best["n"] == roots["node"], "left").groupBy(F.coalesce("root", "n").alias("root")).agg(F.min("row").alias("row"))
    return stash(chosen.select(F.col("row.id").alias("__id")), "chosen")


def one_of_each(rows: DataFrame, node: str, roots: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of chosen_ids()."""
    return rows.join(chosen_ids(rows, node, roots, key, text), "__id", "left_semi")
