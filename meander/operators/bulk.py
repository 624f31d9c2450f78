"""The largest component of a large dense graph, by searches that keep a bit a vertex and move no edges.

A search both ways from one vertex is a few passes over the edges where there is a large component and edges are many. What has
been reached is a bit a vertex, 64 of them a row, and sent to all tasks; a pass gives the bits that it adds, aggregated
before they are shuffled. So disk and memory grow with an eighth of a byte a vertex and way, and edges are only read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..storage import dealt, stash, stash_observed

#: Ids at most, so that the bits that a pass sends to all tasks take 256 MB at most; ids at most for each vertex.
MOST_IDS, SPARSE = 1 << 29, 4
#: Passes after which the search is given up where it has not found half of the vertices, and passes at most: a graph that
#: takes more has long paths, and each pass reads all edges.
PASSES, LONGEST = 24, 100
#: Words of 64 bits in a row that is sent, by its power of two.
ROW = 10
#: Of so many vertices, evenly spread, that of the most edges on its poorer side is where the search begins.
CANDIDATES = 10_000

BITS = ["down", "up", "new_down", "new_up"]


def _start(graph: Graph, top: int) -> int | None:
    every = max(1, (top + 1) // CANDIDATES)
    ends = [graph.edges.where(F.col(end) % every == 0).select(F.col(end).alias("v"), F.lit(int(end == "src")).alias("o"), F.lit(int(end == "dst")).alias("i")) for end in ("src", "dst")]
    best = ends[0].unionByName(ends[1]).groupBy("v").agg(F.least(F.sum("o"), F.sum("i")).alias("least")).orderBy(F.desc("least"), "v").first()
    return best["v"] if best else None


def _rows(words: DataFrame, columns: dict[str, Column], end: str) -> DataFrame:
    """Bits of (word, *columns), 2**ROW words a row, to be looked up by `end` of edges."""
    held = words.select(F.shiftright("word", ROW).alias(f"at_{end}"), F.struct("word", *[c.alias(k) for k, c in columns.items()]).alias("held"))
    rows = held.groupBy(f"at_{end}").agg(F.sort_array(F.collect_list("held")).alias("held"))
    return F.broadcast(rows.select(f"at_{end}", *[F.col("held")[k].alias(f"{k}_{end}") for k in columns]))


def _at(end: str) -> Column:
    return F.shiftright(end, ROW + 6).alias(f"at_{end}")


def _has(bits: str, end: str) -> Column:
    """Whether the bit of vertex `end` is set."""
    return F.expr(f"shiftright({bits}_{end}[CAST(shiftright({end}, 6) & {(1 << ROW) - 1} AS INT)], CAST({end} & 63 AS INT)) & 1 = 1")


def _bit(v: str) -> Column:
    return F.expr(f"shiftleft(CAST(1 AS BIGINT), CAST({v} & 63 AS INT))")


def _pass(edges: DataFrame, words: DataFrame) -> DataFrame:
    """(word, to_down, to_up): bits of what edges from, or into, vertices new on a way reach that was not reached before."""
    of = lambda end, *bits: _rows(words, {k: F.col(k) for k in bits}, end)
    looked = edges.select("src", "dst", _at("src"), _at("dst")).join(of("src", "new_down", "up"), "at_src").join(of("dst", "down", "new_up"), "at_dst")
    down, up = _has("new_down", "src") & ~_has("down", "dst"), _has("new_up", "dst") & ~_has("up", "src")
    one = lambda on, v, way: F.when(on, F.struct(F.shiftright(v, 6).alias("word"), _bit(v).alias("bits"), F.lit(way).alias("way")))
    touched = looked.where(down | up).select(F.explode(F.array(one(down, "dst", 0), one(up, "src", 1))).alias("t")).where("t IS NOT NULL").select("t.*")
    of_way = lambda way: F.coalesce(F.bit_or(F.when(F.col("way") == way, F.col("bits"))), F.lit(0))
    return touched.groupBy("word").agg(of_way(0).alias("to_down"), of_way(1).alias("to_up"))


def _joined(words: DataFrame, touched: DataFrame) -> DataFrame:
    """Words after a pass: what it adds is new."""
    to = {way: F.coalesce(f"to_{way}", F.lit(0)).bitwiseAND(F.bitwise_not(way)) for way in ("down", "up")}
    both = dealt(words).join(touched, "word", "left")
    return both.select("word", *[F.col(way).bitwiseOR(x).alias(way) for way, x in to.items()], *[x.alias(f"new_{way}") for way, x in to.items()])


def _most(words: DataFrame, n: int) -> bool:
    """Whether more than half of n vertices are reached both ways."""
    return 2 * words.agg(F.sum(F.bit_count(F.col("down").bitwiseAND(F.col("up")))).alias("n")).first()["n"] > n


def without_bulk(graph: Graph, n: int) -> Graph | None:
    """The graph without one component of more than half of its n vertices, found whole; None where the search does not find such a one."""
    top = graph.vertices.agg(F.max("v").alias("v")).first()["v"]
    if top is None or top >= min(MOST_IDS, SPARSE * n):
        return None
    start = _start(graph, top)
    if start is None:
        return None
    own = F.when(F.col("id") == start >> 6, F.lit(1).cast("long") * _bit(f"{start}L")).otherwise(F.lit(0).cast("long"))
    spark = graph.edges.sparkSession
    words = stash(spark.range(((top >> 6 + ROW) + 1) << ROW).select(F.col("id").alias("word"), *[own.alias(k) for k in BITS]), "bits")
    new = {"new": F.max(F.col("new_down").bitwiseOR(F.col("new_up")) != 0)}
    for number in range(1, LONGEST + 1):
        words, seen, _ = stash_observed(_joined(words, _pass(graph.edges, words)), "bits", new)
        if not seen["new"]:
            break
        if number == LONGEST or number == PASSES and not _most(words, n):
            return None
    if not _most(words, n):
        return None
    both = words.select("word", F.col("down").bitwiseAND(F.col("up")).alias("both"))
    of = lambda end: _rows(both, {"both": F.col("both")}, end)
    left = graph.vertices.select("v", _at("v")).join(of("v"), "at_v").where(~_has("both", "v")).select("v")
    edges = graph.edges.select("src", "dst", _at("src"), _at("dst")).join(of("src"), "at_src").where(~_has("both", "src")).join(of("dst"), "at_dst").where(~_has("both", "dst")).select("src", "dst")
    return Graph(stash(left, "left"), stash(edges, "between"))
