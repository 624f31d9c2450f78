import gzip
import json

import pytest

from meander.graph import Graph
from meander.plans import metrics
from meander.sources import generators, text


def lines(spark, content):
    return spark.createDataFrame([(x,) for x in content.split("\n")], "value string")


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(
    ("content", "strict", "permissive"),
    [
        ("0 1\n1 0\n", [(0, 1), (1, 0)], [(0, 1), (1, 0)]),
        ("# comment\n% other\n\n0 1\n", [(0, 1)], [(0, 1)]),
        ("0 1 1\n2\n", None, []),
        ("0\t 1\r\n  2   3\r", [(0, 1), (2, 3)], [(0, 1), (2, 3)]),
        ("0 1\n2", None, [(0, 1)]),
        ("0 x\n1 2\n", None, [(1, 2)]),
        ("-1 2\n", None, []),
        ("0 99999999999999999999\n", None, []),
    ],
)
def test_edge_lines(spark, content, strict, permissive):
    assert pairs(text.parse_edges(lines(spark, content), "permissive")) == permissive
    if strict is None:
        with pytest.raises(Exception, match="not an edge"):
            text.parse_edges(lines(spark, content)).collect()
    else:
        assert pairs(text.parse_edges(lines(spark, content))) == strict


def test_files(spark, tmp_path):
    path = tmp_path / "edges.txt.gz"
    path.write_bytes(gzip.compress(b"# head\n0 3\n3 0\n"))
    graph = text.read_edges(spark, str(path))
    assert graph.vertices.count() == 4
    text.write_edges(graph, str(tmp_path / "out"))
    assert pairs(text.read_edges(spark, str(tmp_path / "out")).edges) == [(0, 3), (3, 0)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        text.read_edges(spark, str(tmp_path / "none"))
    assert not text.exists(spark, str(tmp_path / "none")) and text.graph_name("a/b/c.txt") == "c.txt"


def test_json(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"thread_counts": [1, 2], "graphs": ["x/a", "x/b"], "other": 1}))
    config = text.read_config(spark, str(tmp_path / "b.json"))
    assert config.thread_counts == [1, 2] and config.graphs == ["x/a", "x/b"] and config.tau_values == []
    (tmp_path / "p.json").write_text(json.dumps({"default_tau": 5}))
    assert text.read_config(spark, str(tmp_path / "p.json"), text.Parameters).default_tau == 5
    (tmp_path / "c.json").write_text(json.dumps({"synthetic": ["d/s1"], "real": ["d/r1"]}))
    assert {tuple(r) for r in text.read_catalog(spark, str(tmp_path / "c.json")).collect()} == {("synthetic", "d/s1", "s1"), ("real", "d/r1", "r1")}


def test_run(spark, tmp_path):
    paths = generators.build(spark, str(tmp_path), ["graph_1k"])
    table, missing = metrics.run_all(spark, [paths["graph_1k"], str(tmp_path / "none")], generators.load, algorithms=("Tarjan", "Hybrid"))
    rows = {r["algorithm"]: r for r in table.collect()}
    assert missing == [str(tmp_path / "none")]
    assert rows["Hybrid"]["correct"] and rows["Hybrid"]["num_sccs"] == 7 and rows["Hybrid"]["throughput"] > 0
    flat = metrics.results_table(table)
    text.write_csv(flat, str(tmp_path / "csv"))
    assert text.read_csv(spark, str(tmp_path / "csv"), text.RESULTS).count() == 2
    assert text.read_csv(spark, str(tmp_path / "no-csv"), text.RESULTS) is None
    text.write_csv(metrics.breakdown(table).drop("threads", "ordinal"), str(tmp_path / "phases"))
    assert text.read_csv(spark, str(tmp_path / "phases"), text.BREAKDOWN).count() == 2
    assert any(r["line"].startswith("### Time: ") for r in metrics.console(table).collect())


def test_scalability(spark):
    rows = [("B", "g", 1, 0, 8.0), ("B", "g", 1, 1, 10.0), ("B", "g", 4, 2, 5.0), ("T", "g", 4, 3, 5.0), ("B", "g", 2, 4, 0.0)]
    runs = spark.createDataFrame(rows, "algorithm string, graph string, threads int, ordinal int, time_ms double")
    found = {r["ordinal"]: (r["speedup"], r["efficiency"]) for r in metrics.scalability(runs).collect()}
    assert found == {0: (1.25, 1.25), 1: (1.0, 1.0), 2: (2.0, 0.5), 3: (0.0, 0.0), 4: (0.0, 0.0)}


def test_nonzero_columns(spark):
    table = spark.createDataFrame([("a", 0.0, 1.0), ("b", None, 0.0)], "n string, x double, y double")
    assert metrics.nonzero_columns(table, ["x", "y"]).columns == ["n", "y"]


def test_empty_graph(spark):
    graph = Graph.from_edges(spark.createDataFrame([], "src long, dst long"))
    assert graph.vertices.isEmpty()
