"""Shards by jump consistent hashing, in DataFrame functions only.

A key walks through a fixed pseudo-random sequence of shard numbers that only grow; its shard is the last one below the
number of shards. One shard more takes keys only into itself, and no table of ranges is kept. The 64-bit generator is
written in two halves, as SQL integers do not wrap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: Fixed value: the multiplier of the generator of jump consistent hashing.
MULTIPLIER = 2862933555777941757
HIGH, LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
MASK = 0xFFFFFFFF
#: Groups in which slots are counted within each shard; each takes its part of a shard's rows.
SLOT_GROUPS = 4096
#: Slots of repeats of one row that are written out at a time.
SLOT_RUN = 10_000


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """The halves of (key * MULTIPLIER + 1) modulo 2**64; every product stays below 2**63."""
    a = low.bitwiseAND(0xFFFF) * F.lit(LOW) + F.lit(1).cast("long")
    b = F.shiftright(low, 16) * F.lit(LOW) + F.shiftright(a, 16)
    new_low = F.shiftleft(b.bitwiseAND(0xFFFF), 16).bitwiseOR(a.bitwiseAND(0xFFFF))
    c = F.shiftright(b, 16) + low * F.lit(HIGH)
    d = high.bitwiseAND(0xFFFF) * F.lit(LOW) + F.shiftleft((F.shiftright(high, 16) * F.lit(LOW)).bitwiseAND(0xFFFF), 16)
    return (c.bitwiseAND(MASK) + d.bitwiseAND(MASK)).bitwiseAND(MASK), new_low


def jump(key: Column, shards: int) -> Column:
    """The shard (int, 0 to shards - 1) of a BIGINT key. A null key is key 0."""
    if shards < 1:
        raise ValueError("at least one shard")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("j"), F.shiftright(key, 32).bitwiseAND(MASK).alias("h"), key.bitwiseAND(MASK).alias("l"))

    def step(s: Column, _: Column) -> Column:
        high, low = _next(s["h"], s["l"])
        # j = floor((b + 1) * 2**31 / (top 31 bits + 1)), in double precision as the method has it
        j = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double"))).cast("long")
        return F.when(s["j"] >= shards, s).otherwise(F.struct(s["j"].alias("b"), j.alias("j"), high.alias("h"), low.alias("l")))

    # Each step moves up by one at least, so `shards` steps reach the end; most keys stop after a few and pass the rest.
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"].cast("int"))


def key_of(docs: DataFrame, key: str) -> Column:
    """A BIGINT column is its own key; any other is hashed."""
    kind = docs.schema[key].dataType.simpleString()
    return F.col(key).cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key)))


def assign(docs: DataFrame, shards: int, key: str = "doc_id", column: str = "shard") -> DataFrame:
    """The rows with their shard; nothing is shuffled. Rows of one key are in one shard."""
    return docs.withColumn(column, jump(key_of(docs, key), shards))


def slots(sharded: DataFrame, by: list[str], group: Column, shard: str = "shard") -> DataFrame:
    """The rows with `slot`: 0, 1, 2, ... in each shard, and no two rows of a shard with one number.

    Rows that are equal in all of `by` are counted as one before anything is shuffled, so a row that is repeated very
    often is no large group. A shard's rows are dealt to the groups that `group` numbers, a bounded number of them; the
    groups' sizes give each its first slot.
    """
    names = [shard, *by]
    counted = sharded.groupBy(*names).agg(F.count("*").alias("__times")).withColumn("__group", group)
    # Sizes are summed and running totals taken over numbers of groups only, within each shard.
    sizes = counted.groupBy(shard, "__group").agg(F.sum("__times").alias("__size"))
    before = Window.partitionBy(shard).orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(shard, "__group", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy(shard, "__group").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("__before", F.coalesce(F.sum("__times").over(inside), F.lit(0)))
    placed = ranked.join(first, [shard, "__group"])
    start = F.col("__first") + F.col("__before")
    last = start + F.col("__times") - 1
    # A row that is repeated very often is dealt again in runs of SLOT_RUN: no array is long, and no task has it alone.
    runs = placed.select(*names, last.alias("__last"), F.explode(F.sequence(start, last, F.lit(SLOT_RUN).cast("long"))).alias("__from")).repartition(shard, "__from")
    return runs.select(*names, F.explode(F.sequence("__from", F.least("__last", F.col("__from") + (SLOT_RUN - 1)))).alias("slot"))


#: Fixed value: the multiplier of multiplicative hashing, 2**32 over the golden ratio.
GOLDEN = 2654435761


def group_of(key: Column, groups: int = SLOT_GROUPS) -> Column:
    """A number below `groups` for a BIGINT key: middle bits of a product, so that regular keys spread as well. Null is key 0."""
    low = F.coalesce(key, F.lit(0).cast("long")).bitwiseAND((1 << 31) - 1)
    return F.pmod(F.shiftright(low * F.lit(GOLDEN), 16), F.lit(groups))


def report(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row. A null text has size 1 and the crc32 of nothing."""
    raw = F.coalesce(F.col("text"), F.lit(""))
    some = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"))
    # Slots take two passes over the rows: they are written once without their texts.
    placed = slots(stash(assign(some, shards), "sharded"), ["doc_id", "size", "text_crc32"], group_of(key_of(docs, "doc_id")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", jump(key_of(docs, "doc_id"), shards + 1).alias("grown_shard"))


def oracle(shards: int = 16) -> str:
    """The same in SQL, the checksum by its table of 256 entries (from its polynomial) over the bytes of a text."""
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    return f"""
WITH RECURSIVE t AS (SELECT {table}::BIGINT[] AS k),
d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || h[2*i+1:2*i+2])::BIGINT)), lambda a, x: xor(a >> 8, k[(xor(a, x) & 255) + 1])), 4294967295::BIGINT) AS text_crc32 FROM d, t),
w(doc_id, j, k) AS (
  SELECT DISTINCT doc_id, CAST(0 AS BIGINT), CASE WHEN coalesce(doc_id, 0) < 0 THEN CAST(doc_id AS HUGEINT) + 18446744073709551616 ELSE CAST(coalesce(doc_id, 0) AS HUGEINT) END FROM documents
  UNION ALL
  SELECT doc_id, CAST(floor(CAST(j + 1 AS DOUBLE) * (2147483648.0::DOUBLE / CAST(((k * {MULTIPLIER} + 1) % 18446744073709551616) // 8589934592 + 1 AS DOUBLE))) AS BIGINT), (k * {MULTIPLIER} + 1) % 18446744073709551616
  FROM w WHERE j <= {shards}),
s AS (SELECT doc_id, CAST(max(j) FILTER (j < {shards}) AS INTEGER) AS shard, CAST(max(j) FILTER (j < {shards + 1}) AS INTEGER) AS grown_shard FROM w GROUP BY doc_id)
SELECT c.doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY (((coalesce(c.doc_id, 0) & 2147483647) * {GOLDEN}) >> 16) % {SLOT_GROUPS}, c.doc_id NULLS FIRST, size, text_crc32) - 1 AS slot
FROM c JOIN s ON c.doc_id IS NOT DISTINCT FROM s.doc_id"""
