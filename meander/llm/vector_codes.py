"""Product codes of embeddings: each part of a vector becomes the index of a codebook entry, learned by Elkan's Lloyd rounds.

Vectors are integers, floor(scale * x), so that distances and sums are exact and every form of the work gives one result.
For each part a row keeps an upper bound of the distance to its entry and a lower bound for each entry. When entries have
moved, bounds are shifted by the way that they moved, and a distance is computed only where the triangle inequality cannot
rule it out; it rules out strictly, and what is computed is compared as integers, the lower index winning ties.

A round is one pass over the rows in Arrow batches. Rows with their bounds are written between passes, in place of the
table before, so a lost executor costs a part of a pass. Tasks add up their rows by entry, at most parts x entries rows a
task are shuffled, and codebooks, which have a fixed size, are all that reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import forget
from .common import new_folder, released, stash

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Slack of bounds in doubles, far above their rounding. Stored bounds have the upper half of a float's bits.
SLACK = 1e-12
VECTOR, CODE, ERROR = "__vector", "__code", "__error"
UPPER, LOWER = "__upper", "__lower"
#: Rows that one vectorised step works on.
STEP = 2048


def stored_down(x: np.ndarray) -> np.ndarray:
    """Bounds as uint16: the largest number of that form that is not larger. Floats are cut towards zero, and none is negative."""
    small = x.astype(np.float32)
    small = np.where(small > x, np.nextafter(small, np.float32(0)), small)
    return (small.view(np.uint32) >> 16).astype(np.uint16)


def stored_up(x: np.ndarray) -> np.ndarray:
    """The same, never smaller than x."""
    small = x.astype(np.float32)
    small = np.where(small < x, np.nextafter(small, np.float32(np.inf)), small).view(np.uint32)
    return ((small + 0xFFFF) >> 16).astype(np.uint16)


def restored(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.uint32) << 16).view(np.float32).astype(np.float64)


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows x to all entries, as integers."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for k in range(x.shape[1]):
        d = x[:, k, None] - entries[None, :, k]
        out += d * d
    return out


def moved(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """How far each entry has moved, not less; entries by part, entry, position."""
    return np.sqrt(((before - after) ** 2).sum(axis=2).astype(np.float64)) * (1 + SLACK)


@dataclass(frozen=True)
class Shift:
    """What a round needs beside the rows: entries, their ways since the bounds were set, and halves of distances between them."""

    entries: np.ndarray
    way: np.ndarray | None
    half: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray, before: np.ndarray | None) -> Shift:
        """before: the entries that the rows' bounds are for; None in the first round."""
        half = np.stack([np.sqrt(squared(e, e).astype(np.float64)) for e in entries]) * (0.5 * (1 - SLACK))
        for h in half:
            np.fill_diagonal(h, np.inf)
        return cls(entries, None if before is None else moved(before, entries), half)


def assigned(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, upper, lower) of rows of one part, all distances computed."""
    exact = squared(x, entries)
    entry = exact.argmin(axis=1)  # the first of equal ones
    lower = np.sqrt(exact.astype(np.float64)) * (1 - SLACK)
    upper = np.sqrt(exact[np.arange(len(x)), entry].astype(np.float64)) * (1 + SLACK)
    return entry, upper, lower


def reassigned(x: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray, shift: Shift, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry, upper, lower, distances computed) after entries moved.

    An entry is ruled out for a row if the upper bound of the distance to the row's own is strictly below the lower bound
    for it or half the distance between the two entries. Where any is not, the own distance is computed, which may rule out
    more, and then those that are left.
    """
    entries, way, half = shift.entries[part], shift.way[part], shift.half[part]
    entry = entry.astype(np.int64)
    upper = (upper + way[entry]) * (1 + SLACK)
    lower = np.maximum(lower * (1 - SLACK) - way[None, :], 0.0)
    open_ = np.flatnonzero(upper >= half.min(axis=1)[entry])
    if not len(open_):
        return entry, upper, lower, 0
    own = entry[open_]
    near = (upper[open_, None] >= lower[open_]) & (upper[open_, None] >= half[own])
    near[np.arange(len(open_)), own] = False
    some = near.any(axis=1)
    open_, own = open_[some], own[some]
    if not len(open_):
        return entry, upper, lower, 0
    to_own = ((x[open_] - entries[own]) ** 2).sum(axis=1)
    exact_own = np.sqrt(to_own.astype(np.float64))
    upper[open_], lower[open_, own] = exact_own * (1 + SLACK), exact_own * (1 - SLACK)
    near = (upper[open_, None] >= lower[open_]) & (upper[open_, None] >= half[own])
    near[np.arange(len(open_)), own] = False
    row, other = np.nonzero(near)
    exact = ((x[open_[row]] - entries[other]) ** 2).sum(axis=1)
    lower[open_[row], other] = np.sqrt(exact.astype(np.float64)) * (1 - SLACK)
    best = np.full(near.shape, np.iinfo(np.int64).max)
    best[row, other] = exact
    best[np.arange(len(open_)), own] = to_own
    chosen = best.argmin(axis=1)
    entry[open_] = chosen
    upper[open_] = np.sqrt(best[np.arange(len(open_)), chosen].astype(np.float64)) * (1 + SLACK)
    return entry, upper, lower, len(open_) + len(row)


def _rows(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The vectors of a batch as parts: rows, parts, positions."""
    flat = batch.column(batch.schema.get_field_index(VECTOR)).flatten().to_numpy()
    return flat.reshape(batch.num_rows, -1, width)


def _bytes(batch: pa.RecordBatch, name: str, kind, *shape: int) -> np.ndarray:
    held = batch.column(batch.schema.get_field_index(name)).to_pylist()
    return np.frombuffer(b"".join(held), kind).reshape(len(held), *shape)


def _blobs(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in x], pa.binary())


def _pass(rows: DataFrame, shift: Shift, last: bool) -> DataFrame:
    """Rows with their codes, and their bounds, or for the last pass their errors in place of bounds and vectors."""
    parts, count, width = shift.entries.shape
    sent = rows.sparkSession.sparkContext.broadcast(shift)  # parts x entries numbers, whatever the number of rows
    own = [n for n in rows.columns if n not in (VECTOR, CODE, UPPER, LOWER)]
    made = [T.StructField(CODE, T.BinaryType()), *([T.StructField(ERROR, T.LongType())] if last else [T.StructField(VECTOR, T.ArrayType(T.LongType())), T.StructField(UPPER, T.BinaryType()), T.StructField(LOWER, T.BinaryType())])]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        shift = sent.value
        x = _rows(batch, width)
        codes = np.zeros((len(x), parts), np.int64)
        upper, lower = np.zeros((len(x), parts), np.uint16), np.zeros((len(x), parts, count), np.uint16)
        if shift.way is not None:
            old = _bytes(batch, CODE, np.uint16, parts)
            old_upper, old_lower = restored(_bytes(batch, UPPER, np.uint16, parts)), _bytes(batch, LOWER, np.uint16, parts, count)
        for p in range(parts):
            if shift.way is None:
                codes[:, p], u, low = assigned(x[:, p], shift.entries[p])
            else:
                codes[:, p], u, low, _ = reassigned(x[:, p], old[:, p], old_upper[:, p], restored(old_lower[:, p]), shift, p)
            upper[:, p], lower[:, p] = stored_up(u), stored_down(low)
        columns = [batch.column(batch.schema.get_field_index(n)) for n in own] + [_blobs(codes.astype(np.uint16))]
        if last:
            error = ((x - shift.entries[np.arange(parts)[None, :], codes]) ** 2).sum(axis=(1, 2))
            return pa.RecordBatch.from_arrays([*columns, pa.array(error, pa.int64())], [*own, CODE, ERROR])
        vectors = batch.column(batch.schema.get_field_index(VECTOR))
        return pa.RecordBatch.from_arrays([*columns, vectors, _blobs(upper), _blobs(lower.reshape(len(x), -1))], [*own, CODE, VECTOR, UPPER, LOWER])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                yield step(batch.slice(at, STEP))

    return rows.mapInArrow(run, T.StructType([*[rows.schema[n] for n in own], *made]))


def _moved_entries(rows: DataFrame, entries: np.ndarray) -> np.ndarray:
    """Entries replaced by the floors of their rows' means; those without rows stay."""
    parts, count, width = entries.shape

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, number = np.zeros((parts, count, width), np.int64), np.zeros((parts, count), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, codes = _rows(batch, width), _bytes(batch, CODE, np.uint16, parts)
            for p in range(parts):
                np.add.at(total[p], codes[:, p], x[:, p])
                number[p] += np.bincount(codes[:, p], minlength=count)
        p, e = np.nonzero(number)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(number[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["part", "entry", "number", "total"])

    found = rows.select(VECTOR, CODE).mapInArrow(run, "part long, entry long, number long, total array<long>")
    added = [F.sum(F.get("total", F.lit(k)).cast("decimal(38,0)")).alias(f"t{k}") for k in range(width)]
    after = entries.copy()
    for row in found.groupBy("part", "entry").agg(F.sum("number").alias("number"), *added).collect():  # parts x entries rows
        after[row["part"], row["entry"]] = [int(row[f"t{k}"]) // row["number"] for k in range(width)]
    return after


@dataclass(frozen=True)
class Coded:
    """rows: the columns that were kept, CODE (16 bits a part, little-endian) and ERROR; entries: by part, entry, position."""

    rows: DataFrame
    entries: np.ndarray

    def sha256(self) -> str:
        """Digest of the entries as decimal integers with commas between."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def usable(vectors: DataFrame, key: str, vector: str, keep: list[str], scale: int = SCALE, parts: int = PARTS) -> DataFrame | None:
    """`keep`, `key` and VECTOR, as integers; None if there is no such row.

    Rows whose vector is null, empty, or holds null or non-finite components are left out, and rows of another length than
    that of the least key's. A length that parts do not divide is filled up with zeros. Components are held within a limit
    (2**27 for 64 of them) below which no squared distance leaves 64 bits.
    """
    x = F.col(vector).cast("array<double>")
    # A bad component makes the whole test false or null, and either leaves the row out.
    good = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))) & (F.size(x) > 0)
    rows = vectors.where(F.col(vector).isNotNull()).where(good)
    first = rows.select(F.size(vector).alias("n"), F.col(key).alias("k"), F.col(vector).alias("v")).orderBy(F.col("k").asc_nulls_last(), "v").first()
    if first is None:
        return None
    length = first["n"]
    limit = int((2**62 / length) ** 0.5) // 2
    whole = F.transform(x, lambda c: F.greatest(F.lit(-limit), F.least(F.lit(limit), F.floor(c * F.lit(float(scale))))).cast("long"))
    missing = -length % parts
    if missing:
        whole = F.concat(whole, F.array_repeat(F.lit(0).cast("long"), missing))
    return rows.where(F.size(vector) == length).select(*dict.fromkeys([*keep, key]), whole.alias(VECTOR))


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", keep: list[str] | None = None, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Coded | None:
    """Codes of all usable() vectors, None without any.

    Codebooks start as the parts of the `entries` rows of least key (null last; equal keys in order of their vectors), or of
    all rows if there are fewer. Repeated rows count as often as they come. entries: at most 65,536.
    """
    keep = [key] if keep is None else keep
    rows = usable(vectors, key, vector, keep, scale, parts)
    if rows is None:
        return None
    spark = rows.sparkSession
    seeds = rows.select(F.col(key).alias("k"), F.col(VECTOR).alias("v")).orderBy(F.col("k").asc_nulls_last(), "v").limit(entries).collect()
    now = np.array([r["v"] for r in seeds], np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2)
    before, path = None, None
    for _ in range(rounds):
        new_path = new_folder(spark, "codes")
        out = _pass(rows, Shift.of(now, before), last=False)
        out.write.parquet(new_path)
        if path:
            forget(spark, path)
        rows, path = spark.read.schema(out.schema).parquet(new_path), new_path
        before, now = now, _moved_entries(rows, now)
    coded = _pass(rows, Shift.of(now, before), last=True)
    new_path = new_folder(spark, "coded")
    coded.write.parquet(new_path)
    if path:
        forget(spark, path)
    return Coded(spark.read.schema(coded.schema).parquet(new_path), now)


def decode(codes: DataFrame, entries: np.ndarray, code: str = CODE, scale: int = SCALE, out: str = "vector") -> DataFrame:
    """`out` beside the other columns: the vector that a code stands for, middles of the integers' steps. Null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(code)
            made = [None if c is None else (entries[np.arange(len(entries)), np.frombuffer(c, np.uint16)].ravel() + 0.5) / scale for c in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.float64()))], [*batch.schema.names, out])

    return codes.mapInArrow(run, T.StructType([*codes.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable() row; further columns are of no account.

    Rows with a null vector or a null or non-finite component have no row. Repeated rows come as often as they are there;
    null ids and null labels are as others, null labels being one group. An empty table gives an empty one.
    """
    named = vectors.select(F.col("vec_id").alias("k"), F.col("label").alias("l"), F.col("embedding").alias("v"))
    coded = compress(named, "k", "v", ["k", "l"])
    if coded is None:
        none = named.limit(0).withColumnsRenamed({"k": "vec_id"})
        return none.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    # By label the sums are few or many: written, so that Spark knows their size and splits a label with very many rows.
    sums = stash(coded.rows.groupBy(F.col("l").alias("sl")).agg(F.sum(F.col(ERROR).cast("decimal(38,0)")).cast("long").alias("label_error")), "label-errors")
    digits = F.lower(F.hex(CODE))
    code = F.concat(*[F.substring(digits, 4 * p + 1, 2) for p in range(PARTS)])
    both = coded.rows.join(sums, coded.rows["l"].eqNullSafe(sums["sl"]))
    return both.select(F.col("k").alias("vec_id"), code.alias("code"), F.col(ERROR).alias("error"), "label_error", F.lit(coded.sha256()).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same in SQL: all distances in every round."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, p, e, d FROM (SELECT r, p, e, sum((x - c) * (x - c)) AS d FROM x JOIN b{i} USING (p, k) GROUP BY r, p, e)
  QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY d, e) = 1)""")
        if i < rounds:
            steps.append(f"""b{i + 1} AS MATERIALIZED (SELECT p, e, k, coalesce(n.c, b{i}.c) AS c FROM b{i} LEFT JOIN (
  SELECT p, e, k, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS c FROM x JOIN a{i} USING (r, p) GROUP BY p, e, k) n USING (p, e, k))""")
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding, len(embedding) // {parts} AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT r, (i - 1) // w AS p, (i - 1) % w AS k, CAST(floor({scale} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM (SELECT r, w, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM kept)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, k, x AS c FROM x WHERE r <= {entries}),
{", ".join(steps)},
t AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, k)) FROM b{rounds}) AS codebooks_sha256
FROM t JOIN kept USING (r)"""
