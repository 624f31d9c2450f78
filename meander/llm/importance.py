"""Importance resampling towards a target distribution, by hashed n-grams and an external sort-count.

1. Each text becomes a stream of buckets, one uint16 a feature, written in packed blocks with the offsets of their documents.
2. Blocks are sorted and run-length encoded; runs are added up by bucket. The two tables of counts, of the raw documents and
   of the target, have a fixed size and give each bucket a gain.
3. A document's weight is the mean gain of its stream, gathered by offsets with np.add.reduceat.
4. Gumbel noise of each id turns the largest scores into a draw without replacement in proportion to exp(weight).

Scores are integers within a proven range, so counts by score have a bounded size and give the cutoff; only rows at or above
it are sorted, in ranges, and a rank is the rows of the ranges before and the place in its own.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordTable, chunks, released, stash, texts_of
from .decontaminate import words_of

BUCKETS, GRAMS, LEAST_WORDS, PERCENT, SEED, MILLI = 10_000, 1, 20, 10, 2024, 1000
#: Features of a packed block, about; a longer document is a block of its own.
BLOCK = 100_000
IDS, OFFSETS, WORDS, STREAM = "ids", "offsets", "words", "stream"


def bucket_of(feature: bytes, buckets: int = BUCKETS) -> int:
    return zlib.crc32(feature) % buckets


def features(words: list[bytes], grams: int = GRAMS) -> list[bytes]:
    """All runs of 1 to `grams` consecutive words, joined by a space: shorter ones first."""
    out = list(words)
    for n in range(2, grams + 1):
        out += map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))
    return out


def streams(docs: DataFrame, key: str, text: str, buckets: int = BUCKETS, grams: int = GRAMS, block: int | None = None) -> DataFrame:
    """Packed blocks: IDS, OFFSETS (of each document's first feature, and one past the last), WORDS (their numbers), STREAM (uint16).

    A null text is a document without words. The key is kept as it is, whatever its type; it may be null or repeated.
    """
    if buckets > 1 << 16:
        raise ValueError("buckets are kept in 16 bits")
    kind = docs.schema[key].dataType
    block = BLOCK if block is None else block

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(lambda new: (np.fromiter((bucket_of(w, buckets) for w in new), np.float64, len(new)),), 1)
        ids, sizes, words, parts, held = [], [], [], [], 0
        names = None

        def packed() -> pa.RecordBatch:
            offsets = np.zeros(len(sizes) + 1, np.int64)
            np.cumsum(sizes, out=offsets[1:])
            stream = np.concatenate(parts) if parts else np.zeros(0, np.uint16)
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            return pa.RecordBatch.from_arrays([one(pa.concat_arrays(ids)), one(pa.array(offsets)), one(pa.array(words, pa.int64())), pa.array([stream.tobytes()], pa.binary())], [IDS, OFFSETS, WORDS, STREAM])

        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(key))
            for first, part in chunks(texts_of(batch, text)):
                made = [words_of(t) for t in part]
                counts = [len(w) for w in made]
                if grams > 1:
                    made = [features(w, grams) for w in made]
                found = table([f for m in made for f in m])[0].astype(np.uint16)
                ids.append(keys.slice(first, len(part)))
                sizes += [len(m) for m in made]
                words += counts
                parts.append(found)
                held += len(found)
                if held >= block or len(sizes) >= block // 8:
                    yield packed()
                    ids, sizes, words, parts, held = [], [], [], [], 0
        if sizes:
            yield packed()

    schema = T.StructType([T.StructField(IDS, T.ArrayType(kind)), T.StructField(OFFSETS, T.ArrayType(T.LongType())), T.StructField(WORDS, T.ArrayType(T.LongType())), T.StructField(STREAM, T.BinaryType())])
    return docs.select(key, text).mapInArrow(run, schema)


def counted(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket comes: every block is sorted and run-length encoded, and runs are added up by task, then by bucket."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                ordered = np.sort(np.frombuffer(raw, np.uint16), kind="stable")  # a radix sort for 16 bits
                first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
                total[ordered[first]] += np.diff(np.r_[first, len(ordered)])  # a bucket is one run of a block
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in blocks.select(STREAM).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[row["bucket"]] = row["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target to raw, each count larger by one, rounded down."""
    s, t, buckets = int(raw.sum()), int(target.sum()), len(raw)
    ratio = lambda a, b: float(b + 1) * float(s + buckets) / (float(a + 1) * float(t + buckets))
    return np.array([math.floor(MILLI * math.log(ratio(int(a), int(b)))) for a, b in zip(raw, target, strict=True)], np.int64)


def weighed(blocks: DataFrame, gain: np.ndarray, key: str, kind: T.DataType) -> DataFrame:
    """(key, n_words, n_features, weight): the mean gain of a document's stream, rounded down; 0 where there is none."""
    sent = blocks.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            for k, raw in enumerate(batch.column(3).to_pylist()):
                ids, offsets, words = (batch.column(i).slice(k, 1).flatten() for i in range(3))
                offsets = offsets.to_numpy()
                size = np.diff(offsets)
                total = np.zeros(len(size), np.int64)
                some = size > 0
                if some.any():  # documents without features have no place in reduceat
                    total[some] = np.add.reduceat(gain[np.frombuffer(raw, np.uint16)], offsets[:-1][some])
                weight = total // np.maximum(size, 1)
                yield pa.RecordBatch.from_arrays([ids, words, pa.array(size), pa.array(weight)], [key, "n_words", "n_features", "weight"])

    schema = T.StructType([T.StructField(key, kind), *[T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight")]])
    return blocks.select(IDS, OFFSETS, WORDS, STREAM).mapInArrow(run, schema)


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise, a function of the seed and the key's text; a null key is the empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-float(MILLI)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, key: str, score: str, eligible: Column, percent: int = PERCENT, rank: str = "rank") -> DataFrame:
    """`scored` (written) with the rank of those drawn: of the eligible rows `percent` in 100, rounded down, of the largest scores.

    Equal scores are taken in order of the key, null last. Rows that are equal in both take their ranks in any order.
    """
    allowed = F.coalesce(eligible, F.lit(False))
    by_score = scored.where(allowed).groupBy(score).agg(F.count("*").alias("n")).collect()  # as many as there are scores
    number = sum(r["n"] for r in by_score)
    drawn, cutoff, above = percent * number // 100, None, 0
    for row in sorted(by_score, key=lambda r: -r[score]):
        if above >= drawn:
            break
        cutoff, above = row[score], above + row["n"]
    none = F.lit(None).cast("long").alias(rank)
    if cutoff is None:
        return scored.select("*", none)
    near = allowed & (F.col(score) >= cutoff)
    # Within a range rows are numbered by Spark's own id: its upper bits are the range, its lower 33 bits the place in it.
    ordered = scored.where(near).repartitionByRange(F.col(score).desc(), F.col(key).asc_nulls_last()).sortWithinPartitions(F.col(score).desc(), F.col(key).asc_nulls_last())
    at = stash(ordered.withColumn("__at", F.monotonically_increasing_id()), "ordered").withColumn("__range", F.shiftright("__at", 33))
    sizes = at.groupBy("__range").agg(F.count("*").alias("n")).orderBy("__range").collect()  # one row a range
    starts, start = [], 0
    for row in sizes:
        starts.append((row["__range"], start))
        start += row["n"]
    first = F.broadcast(scored.sparkSession.createDataFrame(starts, "__range long, __first long"))
    place = F.col("__first") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    top = at.join(first, "__range").select(*scored.columns, F.when(place <= drawn, place).alias(rank))
    return top.unionByName(scored.where(~near).select("*", none))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_key: str = "item_id", target_text: str = "text", buckets: int = BUCKETS, grams: int = GRAMS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every row of `docs`; rank is null where a row is not drawn.

    Null and empty texts have no features and the weight 0. Rows of one key are documents of their own; with one text they
    have one score. Very long texts are weighed whole. Empty tables give empty ones; an empty target counts as no features.
    """
    blocks = stash(streams(docs, key, text, buckets, grams), "streams")
    gain = gains(counted(blocks, buckets), counted(streams(target, target_key, target_text, buckets, grams), buckets))
    weights = weighed(blocks, gain, key, docs.schema[key].dataType)
    scored = stash(weights.withColumn("score", F.col("weight") + gumbel(F.col(key), seed)), "scored")
    return ranked(scored, key, "score", F.col("n_words") >= least_words, percent)


def report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document, as resample() has them; further columns are of no account."""
    named = docs.select(F.col("doc_id").alias("k"), F.col("text").alias("t"))
    items = target.select(F.col("item_id").alias("k"), F.col("text").alias("t"))
    return resample(named, items, "k", "t", "k", "t").select(F.col("k").alias("doc_id"), "n_features", "weight", "score", "rank")


def oracle(buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> str:
    """report() in SQL, the checksum of each distinct word by its table of 256 entries (from its polynomial)."""
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"unnest(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'))"
    return f"""
WITH t AS (SELECT {table}::BIGINT[] AS k),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
f AS MATERIALIZED (SELECT r, {words} AS w FROM d), i AS MATERIALIZED (SELECT {words} AS w FROM benchmark),
h AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM f UNION SELECT w FROM i)),
b AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || h[2*i+1:2*i+2])::BIGINT)), lambda a, x: xor(a >> 8, k[(xor(a, x) & 255) + 1])), 4294967295::BIGINT) % {buckets} AS b FROM h, t),
s AS (SELECT b, count(*) AS s FROM f JOIN b USING (w) GROUP BY b), u AS (SELECT b, count(*) AS t FROM i JOIN b USING (w) GROUP BY b),
g AS MATERIALIZED (SELECT b, CAST(floor({MILLI} * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM f) + {buckets} AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST((SELECT count(*) FROM i) + {buckets} AS DOUBLE)))) AS BIGINT) AS gain FROM s LEFT JOIN u USING (b)),
m AS (SELECT r, count(*) AS n, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM f JOIN b USING (w) JOIN g USING (b) GROUP BY r),
c AS (SELECT r, doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-{MILLI}.0::DOUBLE * ln(-ln((CAST(('0x' || sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8]) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN m USING (r)),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM c WHERE n_features >= {least_words})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {percent} * (SELECT count(*) FROM o) // 100 THEN rank END AS rank FROM c LEFT JOIN o USING (r)"""
