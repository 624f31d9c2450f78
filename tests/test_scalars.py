from pyspark.sql import functions as F

from meander.functions import scalars


def test_scalars(spark):
    rows = spark.createDataFrame([("A", 10.0, 4.0, 2, -7), ("b", 10.0, 0.0, 4, 7), ("C", None, 5.0, 0, 3)], "n string, base double, ms double, threads int, x int")
    speedup = scalars.speedup(F.col("base"), F.col("ms"))
    found = rows.select(
        speedup.alias("s"), scalars.efficiency(speedup, F.col("threads")).alias("e"), scalars.throughput(F.lit(2000), F.col("ms")).alias("t"), scalars.bounded(F.col("x"), 5).alias("m"),
        scalars.yes_no(F.col("x") > 0).alias("y"), scalars.label_of("plot", F.col("n"), F.col("x")).alias("l"), scalars.pair(F.col("x"), F.col("threads")).alias("p"), scalars.mixed("n", "x").alias("h"),
    ).collect()
    assert [(r["s"], r["e"], r["t"], r["m"], r["y"], r["l"]) for r in found] == [(2.5, 1.25, 0.5, 3, "NO", "plot_a_-7"), (0.0, 0.0, None, 2, "YES", "plot_b_7"), (0.0, 0.0, 0.4, 3, "YES", "plot_c_3")]
    assert found[0]["p"]["v"] == -7 and found[0]["p"]["label"] == 2 and len({r["h"] for r in found}) == 3
    one = rows.agg(scalars.log_scale(F.col("base")).alias("a"), scalars.log_scale(F.when(F.col("x") > 3, 1000.0).otherwise(1.0)).alias("b")).first()
    assert (one["a"], one["b"]) == (False, True)
