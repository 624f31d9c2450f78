"""Column expressions of the engine's metrics and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def throughput(edges: Column, ms: Column) -> Column:
    """Millions of edges a second; null for no time."""
    return F.try_divide(edges / F.lit(1000.0), ms)


def speedup(base_ms: Column, ms: Column) -> Column:
    """base_ms / ms; 0 without a base or a time."""
    return F.coalesce(F.try_divide(base_ms, ms), F.lit(0.0))


def efficiency(speedup_: Column, threads: Column) -> Column:
    return F.coalesce(F.try_divide(speedup_, threads.cast("double")), F.lit(0.0))


def yes_no(flag: Column) -> Column:
    return F.when(flag, "YES").otherwise("NO")


def log_scale(values: Column, ratio: float = 100.0) -> Column:
    """Aggregate: whether the largest is over `ratio` times the smallest."""
    return F.max(values) > F.lit(ratio) * F.min(values)


def mixed(*columns: Column) -> Column:
    """A 64-bit hash of columns."""
    return F.xxhash64(*columns)


def pair(v: Column, label: Column) -> Column:
    return F.struct(v.alias("v"), label.alias("label"))


def label_of(prefix: str, *columns: Column | str) -> Column:
    """Lower-case text label of columns."""
    return F.lower(F.format_string(prefix + "_%s" * len(columns), *columns))


def bounded(x: Column, n: int) -> Column:
    """x modulo n, never negative."""
    return F.pmod(x, F.lit(n))
