"""The engine's operators as queries over the test tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import graph as g
from .functions import scalars
from .graph import Graph
from .operators import pairs, partition
from .operators.reach import bfs
from .operators.scc import batches, big_scc, permuted, scc
from .operators.trim import peel, trim
from .plans import metrics
from .sources import generators, text
from .storage import dealt, new_folder, stash

# ---- graphs derived from the tables


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def user_transitions(spark: SparkSession, sf_dir: str, over: float) -> DataFrame:
    """From each event's user to the next one's of its type, where the value is over a bound."""
    following = F.lead("user_id").over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
    events = _read(spark, sf_dir, "events").select("user_id", "value", following.alias("next"))
    return events.where((F.col("value") > over) & F.col("next").isNotNull()).select(F.col("user_id").alias("src"), F.col("next").alias("dst")).distinct()


def customer_communities(spark: SparkSession, sf_dir: str, over: float) -> DataFrame:
    """From each order's customer to the next one's of the same nation and segment, where the price is over a bound."""
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    customers = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
    following = F.lead("o_custkey").over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("o_orderdate", "o_orderkey"))
    steps = orders.join(dealt(customers), "o_custkey").select(F.col("o_custkey").alias("src"), following.alias("dst"), "o_totalprice")
    return steps.where((F.col("o_totalprice") > over) & F.col("dst").isNotNull()).select("src", "dst").distinct()


def nation_trade(spark: SparkSession, sf_dir: str, least: int) -> DataFrame:
    """From the supplier's nation to the customer's, where enough line items are."""
    supplier = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("src"))
    customer = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("dst"))
    orders = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(customer, "o_custkey")
    items = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    counted = items.join(orders, "l_orderkey").join(supplier, "l_suppkey").groupBy("src", "dst").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least).select("src", "dst")


SQL = {
    "A": """SELECT DISTINCT user_id AS src, nxt AS dst FROM (
      SELECT user_id, value, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS nxt FROM events)
    WHERE nxt IS NOT NULL AND value > 150""",
    "C": """SELECT DISTINCT o_custkey AS src, nxt AS dst FROM (
      SELECT o_custkey, o_totalprice AS p, lead(o_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY o_orderdate, o_orderkey) AS nxt
      FROM orders JOIN customer ON o_custkey = c_custkey)
    WHERE nxt IS NOT NULL AND p > 400000""",
    "D": """SELECT CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
    GROUP BY 1, 2 HAVING count(*) >= 120""",
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> Graph:
    edges = {"A": lambda: user_transitions(spark, sf_dir, 150), "C": lambda: customer_communities(spark, sf_dir, 400_000), "D": lambda: nation_trade(spark, sf_dir, 120)}[name]()
    return Graph.from_edges(stash(edges, "edges"))


def with_graph(name: str, rest: str) -> str:
    """SQL with e (src, dst) and v (v) of a derived graph."""
    return f"WITH RECURSIVE e AS MATERIALIZED ({SQL[name]}), v AS (SELECT unnest(range(coalesce((SELECT max(greatest(src, dst)) + 1 FROM e), 0))) AS v) {rest}"


DEGREES = """deg AS (SELECT v.v, coalesce(o, 0) AS out_degree, coalesce(i, 0) AS in_degree FROM v
  LEFT JOIN (SELECT src, count(*) AS o FROM e GROUP BY 1) a ON a.src = v.v LEFT JOIN (SELECT dst, count(*) AS i FROM e GROUP BY 1) b ON b.dst = v.v)"""
CLOSURE = "r(s, d) AS (SELECT v, v FROM v UNION SELECT r.s, e.dst FROM r JOIN e ON r.d = e.src)"
SCC = f"{CLOSURE}, scc AS (SELECT a.s AS v, min(a.d) AS scc FROM r a JOIN r b ON a.s = b.d AND a.d = b.s GROUP BY 1)"
PIVOT = f"{DEGREES}, top AS (SELECT v, out_degree + in_degree AS degree FROM deg ORDER BY degree DESC, v LIMIT 1)"
CORE = """p(s, d) AS (SELECT src, dst FROM e UNION SELECT p.s, e.dst FROM p JOIN e ON p.d = e.src), cyc AS (SELECT s AS v FROM p WHERE s = d),
  down AS (SELECT v FROM cyc UNION SELECT d FROM p JOIN cyc ON p.s = cyc.v), up AS (SELECT v FROM cyc UNION SELECT s FROM p JOIN cyc ON p.d = cyc.v),
  core AS (SELECT v FROM down INTERSECT SELECT v FROM up)"""

#: Rows of events stand in for rows of runs: a type is an algorithm, users make four graphs, and ids give threads.
RUNS = """runs AS (SELECT CASE event_type WHEN 'view' THEN 'Tarjan' WHEN 'click' THEN 'VGC-' || (event_id % 3) ELSE event_type END AS algorithm,
  'g' || (user_id % 4) AS graph, CAST([1, 2, 4, 8, 16][event_id % 5 + 1] AS INTEGER) AS threads, event_id AS ordinal, value AS time_ms, CAST(1000 + user_id AS BIGINT) AS edges, CAST(event_id % 7 AS INTEGER) AS tau,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE value / 4 END AS trimming, CASE WHEN event_type = 'view' THEN 0.0 ELSE value / 2 END AS big_scc FROM events)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    threads = F.get(F.array(*[F.lit(x) for x in (1, 2, 4, 8, 16)]), (F.col("event_id") % 5).cast("int"))
    kind = F.when(F.col("event_type") == "view", "Tarjan").when(F.col("event_type") == "click", F.concat(F.lit("VGC-"), (F.col("event_id") % 3).cast("string"))).otherwise(F.col("event_type"))
    return _read(spark, sf_dir, "events").select(
        kind.alias("algorithm"), F.concat(F.lit("g"), (F.col("user_id") % 4).cast("string")).alias("graph"), threads.alias("threads"), F.col("event_id").alias("ordinal"), F.col("value").alias("time_ms"),
        (1000 + F.col("user_id")).cast("long").alias("edges"), (F.col("event_id") % 7).cast("int").alias("tau"),
        F.when(F.col("event_id") % 3 != 0, F.col("value") / 4).alias("trimming"), F.when(F.col("event_type") == "view", 0.0).otherwise(F.col("value") / 2).alias("big_scc"),
    )


SCALED = f"""WITH {RUNS}, base AS (SELECT algorithm, graph, arg_max(time_ms, ordinal) AS base_ms FROM runs WHERE threads = 1 GROUP BY 1, 2),
scaled AS (SELECT runs.*, coalesce(CASE WHEN time_ms <> 0 THEN base_ms / time_ms END, 0.0) AS speedup, coalesce(CASE WHEN time_ms <> 0 THEN base_ms / time_ms END, 0.0) / threads AS efficiency FROM runs LEFT JOIN base USING (algorithm, graph))"""
#: Sums of doubles come in any order: digits that all orders share.
DIGITS = 6


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


# ---- the graph itself
for _name in SQL:
    query(SQL[_name], f"edges_{_name.lower()}")(lambda s, d, n=_name: derived(s, d, n).edges)
    query(with_graph(_name, "SELECT dst AS src, src AS dst FROM e"), f"transpose_{_name.lower()}")(lambda s, d, n=_name: derived(s, d, n).transpose().edges)
    query(with_graph(_name, f", {DEGREES} SELECT * FROM deg"), f"degrees_{_name.lower()}")(lambda s, d, n=_name: g.degrees(derived(s, d, n)))
    query(with_graph(_name, "SELECT src, to_json(list_sort(list(dst))) AS neighbors FROM e GROUP BY src"), f"adjacency_{_name.lower()}")(lambda s, d, n=_name: g.adjacency(derived(s, d, n)).select("src", F.to_json("neighbors").alias("neighbors")))
    query(with_graph(_name, f", {DEGREES} SELECT v, CAST(sum(out_degree) OVER (ORDER BY v) - out_degree AS BIGINT) AS off FROM deg UNION ALL SELECT (SELECT count(*) FROM v), (SELECT count(*) FROM e)"), f"csr_offsets_{_name.lower()}")(lambda s, d, n=_name: g.csr_offsets(derived(s, d, n)))
    query(
        with_graph(_name, f", {PIVOT} SELECT (SELECT count(*) FROM v) AS n_vertices, (SELECT count(*) FROM e) AS n_edges, (SELECT count(*) FROM e WHERE src = dst) AS self_loops, CAST(0 AS BIGINT) AS repeated_edges, (SELECT degree FROM top) AS max_degree, (SELECT v FROM top) AS top_vertex"),
        f"graph_stats_{_name.lower()}",
    )(lambda s, d, n=_name: g.graph_stats(derived(s, d, n)))
    query(with_graph(_name, f", {PIVOT} SELECT * FROM top"), f"pivot_{_name.lower()}")(lambda s, d, n=_name: g.pivot(derived(s, d, n)))
    query(with_graph(_name, "SELECT (SELECT max(greatest(src, dst)) FROM e) AS max_v, (SELECT count(*) FROM e) AS n_edges"), f"max_vertex_{_name.lower()}")(lambda s, d, n=_name: g.max_vertex(derived(s, d, n).edges))

# ---- reachability
LEVELS = """r(v, d) USING KEY (v) AS (SELECT min(src), 0 FROM e UNION
  SELECT e.dst, min(r.d) + 1 FROM r JOIN e ON r.v = e.src LEFT JOIN recurring.r x ON x.v = e.dst WHERE x.v IS NULL GROUP BY e.dst)"""


def _first(graph: Graph) -> DataFrame:
    return graph.edges.agg(F.min("src").alias("v"))


for _name in ("A", "C"):
    query(with_graph(_name, f", {LEVELS} SELECT v, CAST(d AS BIGINT) AS depth FROM r"), f"bfs_{_name.lower()}")(lambda s, d, n=_name: bfs(x := derived(s, d, n), _first(x)))


@query(with_graph("A", ", m AS (SELECT * FROM e WHERE src % 3 <> 0 AND dst % 3 <> 0), r(v) AS (SELECT min(src) FROM m HAVING count(*) > 0 UNION SELECT m.dst FROM r JOIN m ON r.v = m.src) SELECT v FROM r"))
def reach_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = derived(spark, sf_dir, "A")
    allowed = graph.vertices.where("v % 3 <> 0")
    start = graph.edges.where("src % 3 <> 0 AND dst % 3 <> 0").agg(F.min("src").alias("v")).where("v IS NOT NULL")
    return bfs(graph, start, allowed).select("v")


def _centres(graph: Graph) -> DataFrame:
    return graph.vertices.where("v % 100 = 7")


@query(with_graph("C", ", r(v, label) AS (SELECT v, v FROM v WHERE v % 100 = 7 UNION SELECT e.dst, r.label FROM r JOIN e ON r.v = e.src) SELECT * FROM r"))
def multi_reach_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = derived(spark, sf_dir, "C")
    return pairs.reached(graph, _centres(graph))


@query(with_graph("C", f", {CLOSURE} SELECT a.d AS v, a.s AS label FROM r a JOIN r b ON a.s = b.d AND a.d = b.s WHERE a.s % 100 = 7"))
def both_ways_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = derived(spark, sf_dir, "C")
    return pairs.mutual(graph, _centres(graph))


# ---- peeling
#: Vertices that are there after so many waves; what is there after MOST_WAVES, more than any of these graphs has, stays.
MOST_WAVES = 80
WAVES = f"""w(wave, v) AS (SELECT 0, v FROM v UNION ALL SELECT DISTINCT a.wave + 1, a.v FROM w a JOIN e i ON i.dst = a.v JOIN w b ON b.v = i.src AND b.wave = a.wave
  JOIN e o ON o.src = a.v JOIN w c ON c.v = o.dst AND c.wave = a.wave WHERE a.wave < {MOST_WAVES})"""
for _name in ("C", "D"):
    query(with_graph(_name, f", {CORE} SELECT v FROM core"), f"trim_core_{_name.lower()}")(lambda s, d, n=_name: peel(derived(s, d, n))[0].vertices)
    query(with_graph(_name, f", {CORE} SELECT v FROM v WHERE v NOT IN (SELECT v FROM core)"), f"trimmed_{_name.lower()}")(lambda s, d, n=_name: peel(derived(s, d, n))[1].select("v"))
    query(with_graph(_name, f", {WAVES} SELECT v, CAST(max(wave) + 1 AS BIGINT) AS wave FROM w WHERE v NOT IN (SELECT v FROM w WHERE wave = {MOST_WAVES}) GROUP BY v"), f"trim_waves_{_name.lower()}")(lambda s, d, n=_name: trim(derived(s, d, n))[1])


#: Sizes of made graphs come from the tables: rows of suppliers, orders and line items.
SUPPLIERS, ORDERS, ITEMS = (f"(SELECT count(*) FROM {t})" for t in ("supplier", "orders", "lineitem"))


def _rows(spark: SparkSession, sf_dir: str, table: str) -> int:
    return _read(spark, sf_dir, table).count()


@query(f"SELECT v, CAST(least(v // 12 + v % 12, {SUPPLIERS} + 10 - v // 12 - v % 12) + 1 AS BIGINT) AS wave FROM (SELECT unnest(range(12 * {SUPPLIERS})) AS v)")
def trim_waves_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trim(generators.lattice(spark, _rows(spark, sf_dir, "supplier"), 12))[1]


# ---- components
for _method in ("tarjan", "hybrid", "colouring", "bgss", "multi", "vgc"):
    for _name in "ACD":
        query(with_graph(_name, f", {SCC} SELECT * FROM scc"), f"scc_{_method}_{_name.lower()}")(lambda s, d, n=_name, m=_method: scc(derived(s, d, n), m))

# The methods that go to one task for small graphs, without that.
for _method, _option in {"hybrid": {"local_edges": 0}, "vgc": {"tau": 1}}.items():
    query(with_graph("C", f", {SCC} SELECT * FROM scc"), f"scc_{_method}_c_distributed")(lambda s, d, m=_method, o=_option: scc(derived(s, d, "C"), m, **o))

for _name in ("A", "C"):
    query(with_graph(_name, f", {SCC}, {PIVOT} SELECT * FROM scc WHERE scc = (SELECT scc FROM scc JOIN top USING (v))"), f"giant_scc_{_name.lower()}")(lambda s, d, n=_name: big_scc(derived(s, d, n)))
    query(with_graph(_name, f", {SCC}, z AS (SELECT scc, count(*) AS size FROM scc GROUP BY 1) SELECT count(*) AS num_sccs, max(size) AS max_scc_size, count(*) FILTER (size = 1) AS singletons FROM z"), f"scc_summary_{_name.lower()}")(lambda s, d, n=_name: partition.summary(scc(derived(s, d, n))))
    query(with_graph(_name, f", {SCC} SELECT scc, count(*) AS size FROM scc GROUP BY 1"), f"scc_sizes_{_name.lower()}")(lambda s, d, n=_name: partition.sizes(scc(derived(s, d, n))))
    query(with_graph(_name, f", {SCC}, z AS (SELECT scc, count(*) AS size FROM scc GROUP BY 1) SELECT size, count(*) AS components FROM z GROUP BY 1"), f"scc_histogram_{_name.lower()}")(lambda s, d, n=_name: partition.histogram(scc(derived(s, d, n))))
    query(with_graph(_name, f", {SCC} SELECT v, CAST(dense_rank() OVER (ORDER BY scc) - 1 AS BIGINT) AS label FROM scc"), f"scc_normalised_{_name.lower()}")(lambda s, d, n=_name: partition.normalise(scc(derived(s, d, n))))
    query(with_graph(_name, f", {SCC} SELECT a.scc AS src, b.scc AS dst, count(*) AS edges FROM e JOIN scc a ON a.v = e.src JOIN scc b ON b.v = e.dst WHERE a.scc <> b.scc GROUP BY 1, 2"), f"condensation_{_name.lower()}")(lambda s, d, n=_name: partition.condensation(x := derived(s, d, n), scc(x)))
    query(with_graph(_name, f", {SCC} SELECT count(DISTINCT scc) AS num_sccs FROM scc"), f"scc_count_{_name.lower()}")(lambda s, d, n=_name: partition.count_classes(scc(derived(s, d, n))))


#: Labels of components but for every eleventh vertex, which has none, against tens of ids.
COMPARED = """x AS (SELECT v, CASE WHEN v % 11 <> 3 THEN scc END AS scc FROM scc), a AS (SELECT v, min(v) OVER (PARTITION BY scc) AS ra FROM x WHERE scc IS NOT NULL),
  b AS (SELECT v, min(v) OVER (PARTITION BY v // 10) AS rb FROM v WHERE v % 7 <> 2), j AS (SELECT ra, rb FROM a FULL JOIN b USING (v)),
  k AS (SELECT count(*) FILTER (rb IS NULL) AS only_a, count(*) FILTER (ra IS NULL) AS only_b, count(*) FILTER (ra <> rb) AS different FROM j)"""


@query(with_graph("C", f", {SCC}, {COMPARED} SELECT *, only_a + only_b + different = 0 AS equal FROM k"))
def partitions_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two labellings that differ, each without some vertices."""
    graph = derived(spark, sf_dir, "C")
    some = scc(graph).select("v", F.when(F.col("v") % 11 != 3, F.col("scc")).alias("scc"))
    tens = graph.vertices.where("v % 7 <> 2").select("v", F.floor(F.col("v") / 10).alias("scc"))
    return partition.compare(some, tens)


@query(with_graph("C", f", {SCC}, {COMPARED} SELECT v, CAST(dense_rank() OVER (ORDER BY ra) - 1 AS BIGINT) AS label FROM a"))
def normalised_without_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices without a label are left out."""
    return partition.normalise(scc(derived(spark, sf_dir, "C")).select("v", F.when(F.col("v") % 11 != 3, F.col("scc")).alias("scc")))


@query(with_graph("A", f", {SCC}, z AS (SELECT count(DISTINCT scc) AS n, count(*) AS all_v FROM scc) SELECT CAST(0 AS BIGINT) AS only_a, CAST(0 AS BIGINT) AS only_b, CAST(0 AS BIGINT) AS different, true AS equal, n AS num_sccs, all_v AS vertices FROM z"))
def partitions_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two methods give one partition, under labels of their own; beside, how many classes and vertices there are."""
    graph = derived(spark, sf_dir, "A")
    a, b = stash(scc(graph, "colouring"), "labels"), partition.normalise(scc(graph, "tarjan")).withColumnRenamed("label", "scc")
    sizes = b.agg(F.countDistinct("scc").alias("num_sccs"), F.count("*").alias("vertices"))  # one row each
    return partition.compare(a, b).join(sizes, how="cross")


@query(f"SELECT v, v - v % 5 AS scc FROM (SELECT unnest(range(5 * {SUPPLIERS})) AS v)")
def scc_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scc(generators.cycles(spark, _rows(spark, sf_dir, "supplier"), 5), "colouring")


@query(f"SELECT v, v AS scc FROM (SELECT unnest(range(100 * {SUPPLIERS})) AS v)")
def scc_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scc(generators.lattice(spark, _rows(spark, sf_dir, "supplier"), 100), local_edges=0)


for _name in ("A", "C"):
    query(
        with_graph(_name, f""", {SCC}, ce AS (SELECT DISTINCT a.scc AS s, b.scc AS d FROM e JOIN scc a ON a.v = e.src JOIN scc b ON b.v = e.dst WHERE a.scc <> b.scc),
  l(c, layer) AS (SELECT DISTINCT scc, 1 FROM scc UNION SELECT ce.s, l.layer + 1 FROM l JOIN ce ON ce.d = l.c), k AS (SELECT c, row_number() OVER (ORDER BY max(layer), c) - 1 AS label FROM l GROUP BY c)
  SELECT v, label FROM scc JOIN k ON k.c = scc.scc"""),
        f"scc_topological_{_name.lower()}",
    )(lambda s, d, n=_name: partition.topological(x := derived(s, d, n), scc(x)))


@query(with_graph("A", ", r(v, label) AS (SELECT v, v FROM v UNION SELECT e.dst, r.label FROM r JOIN e ON r.v = e.src) SELECT label, count(*) AS reached, CAST(sum(v) AS BIGINT) AS total FROM r GROUP BY 1"))
def multi_reach_all_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every vertex reaches: how many vertices, and the sum of their ids."""
    graph = derived(spark, sf_dir, "A")
    return pairs.totals(graph, graph.vertices)


# ---- generators
@query(f"SELECT u AS src, u + 1 AS dst FROM (SELECT unnest(range(20 * {SUPPLIERS})) AS u) WHERE u % 20 < 19 UNION ALL SELECT u, u + 20 FROM (SELECT unnest(range(20 * {SUPPLIERS})) AS u) WHERE u + 20 < 20 * {SUPPLIERS}")
def lattice_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.lattice(spark, _rows(spark, sf_dir, "supplier"), 20).edges


def _kout_sql(n: str, k: int) -> str:
    """The edges by walking the generator step by step from each vertex's seed."""
    bits = lambda t, mask: f"((max(seed) FILTER (t = 3 * j + {t}) >> 16) & {mask})"
    return f"""steps(i, t, seed) AS (SELECT i, CAST(0 AS BIGINT), i FROM (SELECT unnest(range({n})) AS i)
  UNION ALL SELECT i, t + 1, (seed * 1103515245 + 12345) & 4294967295 FROM steps WHERE t < {3 * k}),
e AS MATERIALIZED (SELECT i AS src, xor(xor({bits(1, 2047)} << 10, {bits(2, 1023)}) << 10, {bits(3, 1023)}) % {n} AS dst
  FROM steps, (SELECT unnest(range({k})) AS j) WHERE t > 3 * j AND t <= 3 * j + 3 GROUP BY i, j)"""


def _kout_summary_sql(n: str, k: int) -> str:
    """Sizes of components: that of the vertex of most edges in by two searches, the others by the closure of what is left."""
    return f"""WITH RECURSIVE {_kout_sql(n, k)}, top AS (SELECT dst AS v FROM e GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
f(v) AS (SELECT v FROM top UNION SELECT e.dst FROM f JOIN e ON f.v = e.src), b(v) AS (SELECT v FROM top UNION SELECT e.src FROM b JOIN e ON b.v = e.dst),
m AS MATERIALIZED (SELECT v FROM f INTERSECT SELECT v FROM b), l AS MATERIALIZED (SELECT unnest(range({n})) AS v EXCEPT SELECT v FROM m),
r(s, d) AS (SELECT v, v FROM l UNION SELECT r.s, e.dst FROM r JOIN e ON r.d = e.src SEMI JOIN l ON l.v = e.dst),
z AS (SELECT min(a.d) AS scc FROM r a JOIN r b ON a.s = b.d AND a.d = b.s GROUP BY a.s), y AS (SELECT count(*) AS size FROM z GROUP BY scc UNION ALL SELECT count(*) FROM m)
SELECT count(*) AS num_sccs, max(size) AS max_scc_size, count(*) FILTER (size = 1) AS singletons FROM y"""


def _kout(spark: SparkSession, sf_dir: str, table: str, times: int, k: int) -> Graph:
    """A k-out graph with a vertex for each row of a table, or several."""
    return generators.kout(spark, times * _rows(spark, sf_dir, table), k)


query(f"WITH RECURSIVE {_kout_sql(f'(10 * {SUPPLIERS})', 5)} SELECT src, dst FROM e", "kout_edges")(lambda s, d: _kout(s, d, "supplier", 10, 5).edges)
query(_kout_summary_sql(f"(10 * {SUPPLIERS})", 5), "scc_kout_1k")(lambda s, d: partition.summary(scc(_kout(s, d, "supplier", 10, 5), "colouring")))
query(_kout_summary_sql(ORDERS, 10), "scc_kout_10k")(lambda s, d: partition.summary(scc(_kout(s, d, "orders", 1, 10))))
query(_kout_summary_sql(ORDERS, 10), "scc_kout_10k_distributed")(lambda s, d: partition.summary(scc(_kout(s, d, "orders", 1, 10), local_edges=0)))
query(_kout_summary_sql(ITEMS, 10), "scc_kout_100k")(lambda s, d: partition.summary(scc(_kout(s, d, "lineitem", 1, 10))))


@query(f"SELECT 'kout' AS name, 10 * {SUPPLIERS} AS n_vertices, 50 * {SUPPLIERS} AS n_edges UNION ALL SELECT 'lattice', 100 * {SUPPLIERS}, 99 * {SUPPLIERS} + 100 * ({SUPPLIERS} - 1)")
def build_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs of which the sizes come from a table, written and read again."""
    rows = _rows(spark, sf_dir, "supplier")
    paths = generators.build(spark, new_folder(spark, "graphs"), kinds=(("kout", "kout", (10 * rows, 5)), ("lattice", "lattice", (rows, 100))))
    of = lambda name, x: x.vertices.agg(F.count("*").alias("n_vertices")).join(x.edges.agg(F.count("*").alias("n_edges")), how="cross").select(F.lit(name).alias("name"), "n_vertices", "n_edges")
    return reduce(DataFrame.unionByName, [of(name, generators.load(spark, path)) for name, path in sorted(paths.items())])


@query("WITH RECURSIVE n AS (SELECT count(*) AS n FROM customer), b(low, step) AS (SELECT 0, 1 UNION ALL SELECT low + step, CAST(floor(step * 1.1) AS BIGINT) + 1 FROM b, n WHERE low + step < n) SELECT CAST(low AS BIGINT) AS low, CAST(least(low + step, n) AS BIGINT) AS high FROM b, n")
def batch_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of as many centres as there are customers."""
    return spark.createDataFrame(list(batches(_rows(spark, sf_dir, "customer"))), "low long, high long")


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS vertices, CAST(0 AS BIGINT) AS low, count(*) - 1 AS high FROM orders")
def permuted_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = permuted(_read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("v")))
    return order.agg(F.count("*").alias("n"), F.countDistinct("v").alias("vertices"), F.min("pos").alias("low"), F.max("pos").alias("high"))


# ---- files
@query(with_graph("A", "SELECT src, dst FROM e"))
def edge_list_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "edges-text")
    text.write_edges(derived(spark, sf_dir, "A"), path)
    return text.read_edges(spark, path).edges


@query(with_graph("A", "SELECT (SELECT count(*) FROM v) + 5 AS n, (SELECT count(*) FROM e) AS m, true AS ordered, (SELECT count(*) FROM e WHERE src >= 10 AND src < 40) AS in_range"))
def edge_list_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge list with five vertices without edges at its end: what its manifest keeps, whether files follow each other, and a range of sources."""
    graph, path = derived(spark, sf_dir, "A"), new_folder(spark, "edges-text")
    text.write_edges(Graph(spark.range(graph.vertices.count() + 5).withColumnRenamed("id", "v"), graph.edges), path)
    before = F.max("last").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))  # one row a file
    files = text.read_manifest(spark, path).select((F.coalesce(before, F.lit(-1)) <= F.col("first")).alias("follows")).agg(F.coalesce(F.min("follows"), F.lit(True)).alias("ordered"))
    size = text.read_edges(spark, path).vertices.agg(F.count("*").alias("n"))
    some = text.read_sources(spark, path, 10, 40).agg(F.count("*").alias("in_range"))
    return size.join(files, how="cross").join(some, how="cross").withColumn("m", F.lit(text.read_size(spark, path)["m"]))  # one row each


@query("SELECT user_id AS src, event_id AS dst FROM events WHERE event_id % 4 <> 0")
def edge_list_permissive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth line is a comment, a word or half a pair."""
    bad = F.get(F.array(F.lit("# comment"), F.lit("1 x"), F.lit("2"), F.lit("-1 2")), (F.col("event_id") / 4 % 4).cast("int"))
    line = F.when(F.col("event_id") % 4 == 0, bad).otherwise(F.concat_ws(" \t", "user_id", "event_id"))
    return text.parse_edges(_read(spark, sf_dir, "events").select(line.alias("value")), "permissive")


@query(f"WITH {RUNS} SELECT graph, tau, CAST(round(time_ms, {DIGITS}) AS DOUBLE) AS time_ms FROM runs WHERE contains(algorithm, 'VGC')")
def tau_analysis_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "tau")
    text.write_csv(metrics.tau_analysis(runs(spark, sf_dir)), path)
    return _rounded(text.read_csv(spark, path, text.TAU_ANALYSIS), "time_ms")


@query("""SELECT 'tau' AS option, CAST(64 * (s_nationkey + 1) AS BIGINT) AS value FROM supplier GROUP BY s_nationkey UNION ALL SELECT 'threads', CAST(s_nationkey % 8 + 1 AS BIGINT) FROM supplier GROUP BY 2
  UNION ALL SELECT 'graphs', count(*) FROM supplier UNION ALL SELECT 'iterations', count(DISTINCT s_nationkey) FROM supplier UNION ALL SELECT 'default_tau', 1024""")
def configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON configuration of suppliers and one of parameters, of which keys that are none are ignored and missing ones have their defaults."""
    rows = _read(spark, sf_dir, "supplier").agg(
        F.collect_set(64 * (F.col("s_nationkey") + 1)).alias("tau_values"), F.collect_set(F.col("s_nationkey") % 8 + 1).alias("thread_counts"),
        F.collect_list(F.concat(F.lit("d/"), "s_suppkey")).alias("graphs"), F.lit("none").alias("comment"), F.countDistinct("s_nationkey").alias("iterations"),
    )
    path = new_folder(spark, "config")
    rows.coalesce(1).write.json(path)
    config, parameters = text.read_config(spark, path), text.read_config(spark, path, text.Parameters)
    found = [*(("tau", t) for t in config.tau_values), *(("threads", t) for t in config.thread_counts), ("graphs", len(config.graphs)), ("iterations", parameters.iterations), ("default_tau", parameters.default_tau)]
    return spark.createDataFrame(found, "option string, value long")


@query("SELECT 'k' || (s_nationkey % 3) AS kind, 'd/' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '/' ELSE '' END AS path, CAST(s_suppkey AS VARCHAR) AS name FROM supplier")
def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON catalog of lists of paths, by kind, each with the name of its graph."""
    at = F.concat(F.lit("d/"), "s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, "/").otherwise(""))
    kinds = [F.collect_list(F.when(F.col("s_nationkey") % 3 == k, at)).alias(f"k{k}") for k in range(3)]
    path = new_folder(spark, "catalog")
    _read(spark, sf_dir, "supplier").agg(*kinds).coalesce(1).write.json(path)
    return text.read_catalog(spark, path)


# ---- metrics and reports
#: What a runner gives for a run, from the rows that stand in for runs.
RESULTS = """results AS (SELECT algorithm, graph, CAST(100 + ordinal % 50 AS INTEGER) AS nodes, edges, threads, tau, time_ms, CAST(ordinal % 9 AS INTEGER) AS num_sccs, CAST(ordinal % 13 AS INTEGER) AS max_scc_size,
  CASE WHEN time_ms <> 0 THEN edges / 1000.0 / time_ms END AS throughput, CAST(ordinal % 5 AS INTEGER) AS trim_count, CASE WHEN ordinal % 3 = 0 THEN 'YES' ELSE 'NO' END AS correct FROM runs)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda n: (F.col("ordinal") % n).cast("int")
    rows = runs(spark, sf_dir).withColumns({"nodes": 100 + at(50), "num_sccs": at(9), "max_scc_size": at(13), "trim_count": at(5), "correct": F.when(F.col("ordinal") % 2 == 0, F.col("ordinal") % 3 == 0).otherwise(F.when(F.col("ordinal") % 3 == 0, True))})
    return metrics.with_throughput(rows)


@query(f"WITH {RUNS}, {RESULTS} SELECT algorithm, graph, nodes, edges, threads, tau, round(time_ms, {DIGITS}) AS time_ms, num_sccs, max_scc_size, round(throughput, {DIGITS}) AS throughput, trim_count, correct FROM results")
def results_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat results written as CSV and read again, a null `correct` as NO."""
    path = new_folder(spark, "results")
    text.write_csv(metrics.results_table(results(spark, sf_dir)), path)
    return _rounded(text.read_csv(spark, path, text.RESULTS), "time_ms", "throughput")


@query(f"WITH {RUNS} SELECT algorithm, graph, round(trimming, {DIGITS}) AS trimming, round(big_scc, {DIGITS}) AS big_scc, round(coalesce(trimming, 0) + big_scc, {DIGITS}) AS total FROM runs")
def breakdown_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested phases as columns, written as CSV and read again; phases that were not timed come back as null."""
    phases = F.struct("trimming", *[F.lit(None).cast("double").alias(p) for p in metrics.PHASES[1:-3]], "big_scc", F.lit(None).cast("double").alias("others"), (F.coalesce("trimming", F.lit(0.0)) + F.col("big_scc")).alias("total"))
    path = new_folder(spark, "breakdown")
    text.write_csv(metrics.breakdown(runs(spark, sf_dir).withColumn("breakdown", phases)).drop("threads", "ordinal"), path)
    return _rounded(text.read_csv(spark, path, text.BREAKDOWN), "trimming", "big_scc", "total").select("algorithm", "graph", "trimming", "big_scc", "total")


@query(f"{SCALED} SELECT algorithm, graph, threads, round(time_ms, {DIGITS}) AS time_ms, round(speedup, {DIGITS}) AS speedup, round(efficiency, {DIGITS}) AS efficiency FROM scaled")
def scalability_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "scalability")
    text.write_csv(metrics.scalability(runs(spark, sf_dir)).select(*text.SCALABILITY.names), path)
    return _rounded(text.read_csv(spark, path, text.SCALABILITY), "time_ms", "speedup", "efficiency")


@query(f"WITH {RUNS} SELECT graph, CASE algorithm WHEN 'VGC-0' THEN 'std::vector' WHEN 'VGC-1' THEN 'HashBag' END AS structure, round(time_ms, {DIGITS}) AS time_ms FROM runs WHERE algorithm IN ('VGC-0', 'VGC-1')")
def structures_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "structures")
    text.write_csv(metrics.structures(runs(spark, sf_dir), {"VGC-0": "std::vector", "VGC-1": "HashBag"}), path)
    return _rounded(text.read_csv(spark, path, text.STRUCTURES), "time_ms")


@query(f"""WITH {RUNS}, {RESULTS} SELECT unnest(['### Algorithm: ' || algorithm, '### Graph: ' || graph, '### Vertices: ' || nodes, '### Edges: ' || edges, '### Threads: ' || threads,
  '### SCCs: ' || num_sccs, '### Largest SCC: ' || max_scc_size, '### Time: ' || printf('%.3f', CAST(time_ms AS DECIMAL(18, 3))) || ' ms']) AS line FROM results""")
def console_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the report on the console, but for the throughput, whose last digit two languages round differently."""
    return metrics.console(results(spark, sf_dir)).where(~F.col("line").startswith("### Throughput"))


@query(f"WITH {RUNS}, l AS (SELECT algorithm, graph, 'trimming' AS phase, trimming AS ms FROM runs UNION ALL SELECT algorithm, graph, 'big_scc', big_scc FROM runs) SELECT algorithm, graph, phase, round(coalesce(sum(ms), 0.0), 3) AS ms FROM l GROUP BY ALL")
def phase_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.phase_sums(runs(spark, sf_dir), ("trimming", "big_scc")).withColumn("ms", F.round("ms", 3))


@query(f"WITH {RUNS} SELECT algorithm, to_json(list_sort(list(DISTINCT threads))) AS values FROM runs GROUP BY 1")
def distinct_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.distinct_values(runs(spark, sf_dir), "algorithm", "threads").select("algorithm", F.to_json("values").alias("values"))


@query("SELECT event_id, lower('Run_' || event_type || '_' || user_id) AS label, ((user_id - 50) % 7 + 7) % 7 AS part FROM events")
def text_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower-case labels of columns, and remainders that are never negative."""
    return _read(spark, sf_dir, "events").select("event_id", scalars.label_of("Run", "event_type", "user_id").alias("label"), scalars.bounded(F.col("user_id") - 50, 7).alias("part"))


@query("SELECT count(DISTINCT (user_id, event_type)) AS pairs, count(DISTINCT (user_id, event_type)) AS hashes FROM events")
def hashed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs, and 64-bit hashes of them, are as many."""
    events = _read(spark, sf_dir, "events")
    return events.agg(F.countDistinct(scalars.pair(F.col("user_id"), F.col("event_type"))).alias("pairs"), F.countDistinct(scalars.mixed(F.col("user_id"), F.col("event_type"))).alias("hashes"))


@query(f"SELECT 'lattice' AS graph, algorithm, threads, runs, CAST(1 AS BIGINT) AS missing, 20 * {SUPPLIERS} AS num_sccs FROM (VALUES ('Tarjan', 2, 1), ('VGC', 2, 2), ('Tarjan', 3, 1), ('VGC', 3, 2)) t(algorithm, threads, runs)")
def configured_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration run: two numbers of threads, two values of tau, and a path that is not there, which is skipped and counted."""
    paths = generators.build(spark, new_folder(spark, "graphs"), kinds=(("lattice", "lattice", (_rows(spark, sf_dir, "supplier"), 20)),))
    config = text.BenchmarkConfig(tau_values=[64, 20_000], thread_counts=[2, 3], graphs=[paths["lattice"], f"{paths['lattice']}-none"])
    table, missing = metrics.run_configured(spark, config, text.Parameters(iterations=1), generators.load, ("Tarjan", "VGC"))
    return table.groupBy("graph", "algorithm", "threads").agg(F.count("*").cast("int").alias("runs"), F.min("num_sccs").alias("num_sccs")).withColumn("missing", F.lit(len(missing)).cast("long"))


@query(f"{SCALED} SELECT algorithm, graph, threads, ordinal, round(speedup, {DIGITS}) AS speedup, round(efficiency, {DIGITS}) AS efficiency FROM scaled")
def scalability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.scalability(runs(spark, sf_dir)), "speedup", "efficiency").select("algorithm", "graph", "threads", "ordinal", "speedup", "efficiency")


@query(f"WITH {RUNS} SELECT algorithm, graph, ordinal, round(CASE WHEN time_ms <> 0 THEN edges / 1000.0 / time_ms END, {DIGITS}) AS throughput FROM runs")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.with_throughput(runs(spark, sf_dir)), "throughput").select("algorithm", "graph", "ordinal", "throughput")


@query(f"{SCALED} SELECT algorithm, graph, threads, round(avg(speedup), {DIGITS}) AS speedup, CAST(threads AS DOUBLE) AS ideal FROM scaled WHERE algorithm <> 'Tarjan' GROUP BY ALL")
def speedup_by_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.speedup_by_threads(metrics.scalability(runs(spark, sf_dir))), "speedup")


@query(f"{SCALED} SELECT algorithm, graph, threads, round(avg(efficiency), {DIGITS}) AS efficiency FROM scaled WHERE algorithm <> 'Tarjan' GROUP BY ALL")
def efficiency_by_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.efficiency_by_threads(metrics.scalability(runs(spark, sf_dir))), "efficiency")


@query(f"WITH {RUNS} SELECT algorithm, graph, threads, round(avg(time_ms), {DIGITS}) AS time_ms FROM runs WHERE algorithm <> 'Tarjan' GROUP BY ALL")
def runtime_by_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.runtime_by_threads(runs(spark, sf_dir)), "time_ms")


@query(f"WITH {RUNS} SELECT algorithm, graph, round(avg(time_ms), {DIGITS}) AS time_ms FROM runs WHERE algorithm = 'Tarjan' OR threads = (SELECT max(threads) FROM runs) GROUP BY ALL")
def sequential_against_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.at_most_threads(runs(spark, sf_dir)), "time_ms")


@query(f"WITH {RUNS}, m AS (SELECT avg(time_ms) AS t FROM runs WHERE algorithm = 'Tarjan' OR threads = (SELECT max(threads) FROM runs) GROUP BY algorithm, graph) SELECT max(t) > 100 * min(t) AS log_scale FROM m")
def log_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.needs_log_scale(runs(spark, sf_dir))


@query(f"WITH {RUNS} SELECT algorithm, graph, round(avg(CASE WHEN time_ms <> 0 THEN edges / 1000.0 / time_ms END), {DIGITS}) AS throughput FROM runs WHERE threads = (SELECT max(threads) FROM runs) GROUP BY ALL")
def throughput_at_most_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.throughput_at_most_threads(runs(spark, sf_dir)), "throughput")


LAST = f"WITH {RUNS}, last AS (SELECT algorithm, graph, arg_max(trimming, ordinal) FILTER (trimming IS NOT NULL) AS trimming, arg_max(big_scc, ordinal) FILTER (big_scc IS NOT NULL) AS big_scc FROM runs GROUP BY 1, 2)"


@query(f"{LAST} SELECT algorithm, graph, round(trimming, {DIGITS}) AS trimming, round(big_scc, {DIGITS}) AS big_scc FROM last")
def last_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.last_breakdown(runs(spark, sf_dir), ("trimming", "big_scc")), "trimming", "big_scc")


@query(f"""{LAST}, long AS (SELECT algorithm, graph, 'trimming' AS phase, trimming AS ms FROM last UNION ALL SELECT algorithm, graph, 'big_scc', big_scc FROM last)
SELECT algorithm, graph, phase, round(ms, {DIGITS}) AS ms FROM long WHERE (algorithm, phase) IN (SELECT (algorithm, phase) FROM long WHERE ms <> 0)""")
def phases_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.phases_shown(metrics.last_breakdown(runs(spark, sf_dir), ("trimming", "big_scc")), ("trimming", "big_scc")), "ms")


@query(f"WITH {RUNS} SELECT graph, CASE algorithm WHEN 'VGC-0' THEN 'std::vector' WHEN 'VGC-1' THEN 'HashBag' END AS structure, round(time_ms, {DIGITS}) AS time_ms FROM runs WHERE algorithm IN ('VGC-0', 'VGC-1')")
def frontier_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.structures(runs(spark, sf_dir), {"VGC-0": "std::vector", "VGC-1": "HashBag"}), "time_ms")


@query(with_graph("D", f", {SCC} SELECT algorithm, (SELECT count(DISTINCT scc) FROM scc) AS num_sccs, coalesce((SELECT max(n) FROM (SELECT count(*) AS n FROM scc GROUP BY scc)), 0) AS max_scc_size, 'YES' AS correct FROM (VALUES ('Tarjan'), ('Colouring'), ('VGC')) t(algorithm)"))
def benchmark_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark driver on a graph, without its times."""
    return metrics.results_table(metrics.measure(derived(spark, sf_dir, "D"), "trade", ("Tarjan", "Colouring", "VGC"))).select("algorithm", "num_sccs", "max_scc_size", "correct")
