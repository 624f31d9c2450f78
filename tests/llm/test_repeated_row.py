"""One row repeated very often gets its slots without a long array."""

from pyspark.sql import functions as F

from meander.llm import sharding


def test_a_row_ten_million_times(spark):
    n = 10_000_000
    docs = spark.range(n).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text")).unionByName(spark.createDataFrame([(i, f"t{i}") for i in range(200)], "doc_id long, text string"))
    found = sharding.report(docs)
    one = found.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.sum("slot").alias("sum")).collect()
    assert sum(r["n"] for r in one) == n + 200
    assert all(r["low"] == 0 and r["high"] == r["n"] - 1 and r["sum"] == r["n"] * (r["n"] - 1) // 2 for r in one)
    assert found.where("doc_id = 7").select("shard").distinct().count() == 1
