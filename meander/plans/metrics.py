"""Result tables of runs: throughput, speedup, efficiency, phase breakdowns."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import efficiency, speedup, throughput, yes_no
from ..graph import Graph
from ..operators import partition
from ..operators.scc import PHASES, Clock, scc
from ..sources.text import BenchmarkConfig, Parameters, exists, graph_name
from ..storage import stash


def scalability(results: DataFrame) -> DataFrame:
    """results with base_ms, speedup and efficiency: against the last row (by `ordinal`) with one thread of its algorithm and graph."""
    base = results.where("threads = 1").groupBy("algorithm", "graph").agg(F.max_by("time_ms", "ordinal").alias("base_ms"))
    joined = results.join(base, ["algorithm", "graph"], "left")
    with_speedup = joined.withColumn("speedup", speedup(F.col("base_ms"), F.col("time_ms")))
    return with_speedup.withColumn("efficiency", efficiency(F.col("speedup"), F.col("threads")))


def with_throughput(results: DataFrame) -> DataFrame:
    return results.withColumn("throughput", throughput(F.col("edges"), F.col("time_ms")))


def breakdown(results: DataFrame) -> DataFrame:
    """The nested phases as columns; threads and ordinal are kept."""
    return results.select("algorithm", "graph", "threads", "ordinal", "breakdown.*")


def last_breakdown(table: DataFrame, phases: tuple[str, ...] = PHASES[:-1]) -> DataFrame:
    """The last value that is not null of every phase by algorithm and graph."""
    last = [F.max_by(p, F.when(F.col(p).isNotNull(), F.col("ordinal"))).alias(p) for p in phases]
    return table.groupBy("algorithm", "graph").agg(*last)


def phases_shown(last: DataFrame, phases: tuple[str, ...] = PHASES[:-1]) -> DataFrame:
    """(algorithm, graph, phase, ms) without the phases that are zero on all graphs of an algorithm."""
    long = last.unpivot(["algorithm", "graph"], list(phases), "phase", "ms")
    used = long.groupBy("algorithm", "phase").agg(F.bool_or(F.col("ms") != 0).alias("used")).where("used").select("algorithm", "phase")
    return long.join(used, ["algorithm", "phase"], "left_semi")


def nonzero_columns(table: DataFrame, columns: list[str]) -> DataFrame:
    """The table without those of `columns` that are zero or null in every row."""
    used = table.agg(*[F.bool_or(F.col(c) != 0).alias(c) for c in columns]).first()
    return table.select([c for c in table.columns if c not in columns or used[c]])


def tau_analysis(results: DataFrame) -> DataFrame:
    return results.where(F.contains("algorithm", F.lit("VGC"))).select("graph", "tau", "time_ms")


#: Names of runs and of the frontier structure they stand for.
STRUCTURES = {"BGSS-Vector": "std::vector", "BGSS-HashBag": "HashBag"}


def structures(results: DataFrame, names: dict[str, str] = STRUCTURES) -> DataFrame:
    structure = reduce(lambda c, kv: c.when(F.col("algorithm") == kv[0], kv[1]), names.items(), F.when(F.lit(False), F.lit(None).cast("string")))
    return results.where(F.col("algorithm").isin(*names)).select("graph", structure.alias("structure"), "time_ms")


def speedup_by_threads(scaled: DataFrame) -> DataFrame:
    """Mean speedup by threads without the sequential method, beside the ideal."""
    by = scaled.where("algorithm <> 'Tarjan'").groupBy("algorithm", "graph", "threads").agg(F.avg("speedup").alias("speedup"))
    return by.withColumn("ideal", F.col("threads").cast("double"))


def efficiency_by_threads(scaled: DataFrame) -> DataFrame:
    return scaled.where("algorithm <> 'Tarjan'").groupBy("algorithm", "graph", "threads").agg(F.avg("efficiency").alias("efficiency"))


def runtime_by_threads(results: DataFrame) -> DataFrame:
    return results.where("algorithm <> 'Tarjan'").groupBy("algorithm", "graph", "threads").agg(F.avg("time_ms").alias("time_ms"))


def _most_threads(results: DataFrame) -> DataFrame:
    return results.agg(F.max("threads").alias("most_threads"))  # one row


def at_most_threads(results: DataFrame, sequential: bool = True) -> DataFrame:
    """Mean time by algorithm and graph at the largest number of threads, with the sequential method at its own."""
    joined = results.join(F.broadcast(_most_threads(results)))
    keep = F.col("threads") == F.col("most_threads")
    return joined.where(keep | (F.col("algorithm") == "Tarjan") if sequential else keep).groupBy("algorithm", "graph").agg(F.avg("time_ms").alias("time_ms"))


def throughput_at_most_threads(results: DataFrame) -> DataFrame:
    joined = with_throughput(results).join(F.broadcast(_most_threads(results))).where("threads = most_threads")
    return joined.groupBy("algorithm", "graph").agg(F.avg("throughput").alias("throughput"))


def needs_log_scale(results: DataFrame) -> DataFrame:
    from ..functions.scalars import log_scale

    return at_most_threads(results).agg(log_scale(F.col("time_ms")).alias("log_scale"))


NAMES = {"Tarjan": "tarjan", "BGSS-BigSCC": "bgss", "BGSS-MultiSearch": "multi", "VGC": "vgc", "Colouring": "colouring", "Hybrid": "hybrid"}


def measure(graph: Graph, name: str, algorithms: tuple[str, ...] = ("Tarjan", "Hybrid"), iterations: int = 1, tau: int = 1024, against: str = "Tarjan", threads: int | None = None) -> DataFrame:
    """Runs of algorithms on a graph as result rows, with the median time of `iterations`; `correct` compares whole partitions.

    threads: the number of shuffle partitions of the runs, as so many tasks of a shuffle run at once at most; the session's
    own number else. A time ends when the labelling has been written.
    """
    spark = graph.vertices.sparkSession
    own = spark.conf.get(PARTITIONS)
    if threads is not None:
        spark.conf.set(PARTITIONS, str(threads))
    try:
        return _measured(graph, name, algorithms, iterations, tau, against, int(spark.conf.get(PARTITIONS)))
    finally:
        spark.conf.set(PARTITIONS, own)


PARTITIONS = "spark.sql.shuffle.partitions"


def _measured(graph: Graph, name: str, algorithms: tuple[str, ...], iterations: int, tau: int, against: str, threads: int) -> DataFrame:
    spark = graph.vertices.sparkSession
    nodes, edges = graph.vertices.count(), graph.edges.count()
    rows, labels = [], {}
    for ordinal, algorithm in enumerate(algorithms):
        times = []
        for _ in range(iterations):
            clock, began = Clock(), time.perf_counter()
            options = {"tau": tau} if NAMES[algorithm] == "vgc" else {}
            labels[algorithm] = stash(scc(graph, NAMES[algorithm], clock, **options), "labels")
            clock.ms["total"] = 1000 * (time.perf_counter() - began)
            times.append((clock.ms["total"], clock))
        ms, clock = sorted(times, key=lambda t: t[0])[len(times) // 2]
        one = partition.summary(labels[algorithm]).first()
        same = partition.compare(labels[algorithm], labels[against]).first()["equal"] if against in labels else None
        rows.append((ordinal, algorithm, name, nodes, edges, threads, tau, ms, one["num_sccs"], one["max_scc_size"], clock.trimmed, same, tuple(clock.ms[p] for p in PHASES)))
    kind = "ordinal int, algorithm string, graph string, nodes long, edges long, threads int, tau int, time_ms double, num_sccs long, max_scc_size long, trim_count long, correct boolean, breakdown struct<" + ", ".join(f"{p}: double" for p in PHASES) + ">"
    return with_throughput(spark.createDataFrame(rows, kind))


def run_all(spark: SparkSession, paths: list[str], load, **options) -> tuple[DataFrame | None, list[str]]:
    """measure() on every path that is there, and the paths that are not."""
    missing = [p for p in paths if not exists(spark, p)]
    tables = [measure(load(spark, p), graph_name(p), **options) for p in paths if p not in missing]
    return (reduce(DataFrame.unionByName, tables) if tables else None), missing


def run_configured(spark: SparkSession, config: BenchmarkConfig, parameters: Parameters, load, algorithms: tuple[str, ...] = ("Tarjan", "VGC")) -> tuple[DataFrame | None, list[str]]:
    """run_all() on the graphs of a configuration, for each of its numbers of threads and each tau, and the paths that are not there.

    Where the configuration has no threads or no tau, and for the number of iterations, those of the parameters are taken.
    Only VGC has a tau: other algorithms run once a number of threads.
    """
    rest = tuple(a for a in algorithms if a != "VGC")
    parts, missing = [], []
    for threads in config.thread_counts or [parameters.default_threads]:
        for k, tau in enumerate(config.tau_values or [parameters.default_tau]):
            own = algorithms if not k else tuple(a for a in algorithms if a not in rest or a == "Tarjan")
            table, missing = run_all(spark, config.graphs, load, algorithms=own, iterations=parameters.iterations, tau=tau, threads=threads)
            if table is not None:
                parts.append(table if not k else table.where(F.col("algorithm") == "VGC"))
    return (reduce(DataFrame.unionByName, parts) if parts else None), missing


def distinct_values(results: DataFrame, by: str, column: str) -> DataFrame:
    """(by, values): the distinct values of a column in order, by another. One row a group: for columns of few values."""
    return results.groupBy(by).agg(F.array_sort(F.collect_set(column)).alias("values"))


def phase_sums(table: DataFrame, phases: tuple[str, ...]) -> DataFrame:
    """(algorithm, graph, phase, ms): milliseconds of each phase over all runs; a phase that was never timed has 0."""
    long = table.unpivot(["algorithm", "graph"], list(phases), "phase", "ms")
    return long.groupBy("algorithm", "graph", "phase").agg(F.coalesce(F.sum("ms"), F.lit(0.0)).alias("ms"))


def results_table(results: DataFrame) -> DataFrame:
    """The flat result columns, `correct` as YES or NO."""
    return results.withColumn("correct", yes_no(F.col("correct"))).select("algorithm", "graph", "nodes", "edges", "threads", "tau", "time_ms", "num_sccs", "max_scc_size", "throughput", "trim_count", "correct")


def console(results: DataFrame) -> DataFrame:
    """(line): a block of key and value lines for each result, times with three decimals."""
    rows = F.array(
        F.format_string("### Algorithm: %s", "algorithm"), F.format_string("### Graph: %s", "graph"), F.format_string("### Vertices: %d", F.col("nodes").cast("long")), F.format_string("### Edges: %d", "edges"),
        F.format_string("### Threads: %d", F.col("threads").cast("long")), F.format_string("### Time: %.3f ms", "time_ms"), F.format_string("### SCCs: %d", F.col("num_sccs").cast("long")),
        F.format_string("### Largest SCC: %d", F.col("max_scc_size").cast("long")), F.format_string("### Throughput: %.3f M-edges/s", "throughput"),
    )
    return results.select(F.explode(rows).alias("line"))
