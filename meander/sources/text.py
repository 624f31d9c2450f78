"""Edge lists as text, configurations as JSON, and result tables as CSV."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import Graph


def parse_edges(lines: DataFrame, mode: str = "strict") -> DataFrame:
    """(src, dst) of lines (value): two ids with any white space between. Blank lines and those from # or % on are comments.

    strict: any other line raises an error that quotes it; permissive: it is left out. Negative ids are no ids.
    """
    if mode not in ("strict", "permissive"):
        raise ValueError(f"mode {mode!r}: strict or permissive")
    line = F.regexp_replace(F.col("value"), r"^\s+|\s+$", "")
    parts = F.split(line, r"\s+")
    a, b = (F.expr(f"try_cast(get(parts, {i}) AS BIGINT)") for i in (0, 1))
    good = (F.size("parts") == 2) & F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") >= 0) & (F.col("dst") >= 0)
    read = lines.select(line.alias("line"), parts.alias("parts")).where(~F.col("line").rlike(r"^([#%]|$)")).select("line", "parts", a.alias("src"), b.alias("dst"))
    if mode == "permissive":
        return read.where(good).select("src", "dst")
    checked = F.when(good, F.col("src")).otherwise(F.raise_error(F.concat(F.lit("not an edge: "), F.col("line"))).cast("long"))
    return read.select(checked.alias("src"), "dst")


#: Where an edge list keeps its size and what each of its files has; Spark does not read names that begin so as edges.
MANIFEST = "_graph"


def read_edges(spark: SparkSession, path: str, mode: str = "strict") -> Graph:
    """A graph of an edge list; .gz is read as it is. A path that is not there raises an error.

    Where write_edges() has left a manifest, the number of vertices is as it was written; else it is the largest id and one.
    """
    n = read_size(spark, path)["n"] if exists(spark, f"{path}/{MANIFEST}") else None
    return Graph.from_edges(parse_edges(spark.read.text(path), mode), n)


def read_size(spark: SparkSession, path: str) -> dict[str, int]:
    """n (vertices) and m (edges) of a manifest."""
    return spark.read.schema("n long, m long").json(f"{path}/{MANIFEST}/size").first().asDict()


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, last, edges) of the files of an edge list, in the order of its edges: sources and their number."""
    return spark.read.schema("file string, first long, last long, edges long").json(f"{path}/{MANIFEST}/files")


def read_sources(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """(src, dst) of the edges whose source is from low up to but not high. Files that have none by the manifest are not opened."""
    files = read_manifest(spark, path).where((F.col("last") >= low) & (F.col("first") < high)).select("file").collect()  # a name a file
    if not files:
        return spark.createDataFrame([], "src long, dst long")
    edges = parse_edges(spark.read.text([f"{path}/{r['file']}" for r in files]))
    return edges.where((F.col("src") >= low) & (F.col("src") < high))


def write_edges(graph: Graph, path: str) -> None:
    """One `src dst` line an edge, in order of source and target over all files, and a manifest, with which edge-less vertices are kept."""
    ordered = graph.edges.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst")
    ordered.select(F.concat_ws(" ", "src", "dst").alias("value")).write.mode("overwrite").text(path)
    spark = graph.edges.sparkSession
    source = F.split("value", " ")[0].cast("long")
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), source.alias("src"))
    files = lines.groupBy("file").agg(F.min("src").alias("first"), F.max("src").alias("last"), F.count("*").alias("edges"))
    files.orderBy("file").write.json(f"{path}/{MANIFEST}/files")
    n = graph.vertices.agg((F.coalesce(F.max("v"), F.lit(-1)) + 1).alias("n"))
    n.join(read_manifest(spark, path).agg(F.coalesce(F.sum("edges"), F.lit(0)).alias("m")), how="cross").write.json(f"{path}/{MANIFEST}/size")  # one row each


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path of any store that Spark reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def graph_name(path: str) -> str:
    """The last part of a path."""
    return path.rstrip("/").rpartition("/")[2]


def graph_name_column(path: str = "path"):
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


@dataclass
class Parameters:
    """Options of runs where the configuration has none: plans.metrics.run_configured takes them."""

    default_tau: int = 1024
    default_threads: int = 8
    iterations: int = 3


@dataclass
class BenchmarkConfig:
    tau_values: list[int] = field(default_factory=list)
    thread_counts: list[int] = field(default_factory=list)
    graphs: list[str] = field(default_factory=list)


def _json_row(spark: SparkSession, path: str) -> dict:
    return spark.read.option("multiLine", True).json(path).first().asDict(recursive=True)


def read_config(spark: SparkSession, path: str, kind=BenchmarkConfig):
    """A JSON document as a dataclass; keys that are not its fields are ignored, a missing file raises an error."""
    row = _json_row(spark, path)
    return kind(**{f.name: row[f.name] for f in fields(kind) if row.get(f.name) is not None})


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(kind, path, name) of every data set in a JSON catalog of lists of paths."""
    rows = [(kind, p) for kind, paths in _json_row(spark, path).items() for p in paths or []]
    return spark.createDataFrame(rows, "kind string, path string").withColumn("name", graph_name_column())


L, D, S, N = T.LongType(), T.DoubleType(), T.StringType(), T.IntegerType()
#: Columns of the result tables.
RESULTS = T.StructType([T.StructField(*x) for x in (("algorithm", S), ("graph", S), ("nodes", N), ("edges", L), ("threads", N), ("tau", N), ("time_ms", D), ("num_sccs", N), ("max_scc_size", N), ("throughput", D), ("trim_count", N), ("correct", S))])
BREAKDOWN = T.StructType([T.StructField(*x) for x in (("algorithm", S), ("graph", S), *((p, D) for p in ("trimming", "forward_reach", "backward_reach", "reachability", "labeling", "hash_bag", "big_scc", "others", "total")))])
TAU_ANALYSIS = T.StructType([T.StructField(*x) for x in (("graph", S), ("tau", N), ("time_ms", D))])
STRUCTURES = T.StructType([T.StructField(*x) for x in (("graph", S), ("structure", S), ("time_ms", D))])
SCALABILITY = T.StructType([T.StructField(*x) for x in (("algorithm", S), ("graph", S), ("threads", N), ("time_ms", D), ("speedup", D), ("efficiency", D))])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """A result table with its header, or None if there is none."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False) if exists(spark, path) else None


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").csv(path, header=True)
