"""Places of rows in a total order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stash

#: Spark's own ids have the partition above and the row in it below this many bits.
ROW_BITS = 33


def positions(rows: DataFrame, by: list[Column | str], name: str) -> DataFrame:
    """`rows` with `name`, their place from 0 in the order of `by`; rows that are equal in it come in any order.

    Rows are dealt by ranges of the order and sorted in each; what goes through the driver is the size of each range.
    """
    at = stash(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    at = at.withColumn("__range", F.shiftright("__at", ROW_BITS))
    starts, start = [], 0
    for row in at.groupBy("__range").agg(F.count("*").alias("n")).orderBy("__range").collect():  # one row a range
        starts.append((row["__range"], start))
        start += row["n"]
    first = F.broadcast(rows.sparkSession.createDataFrame(starts, "__range long, __first long"))
    place = F.col("__first") + F.col("__at").bitwiseAND((1 << ROW_BITS) - 1)
    return at.join(first, "__range").select(*rows.columns, place.alias(name))
