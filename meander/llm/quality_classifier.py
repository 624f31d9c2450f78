"""Quality classifier: supervised subword embeddings.

Features are hashed to BUCKETS vectors of DIMENSION. A word is the average of the vectors of its features: itself, and its
byte n-grams of 3 to 5 with a mark at either end. A bigram of a word and the next has a vector of its own; one of a word and
itself is written as a repetition, whatever the word, so one vector learns it. A document is the average of its words and
bigrams, a softmax layer gives the class, and vectors and layer are learned together by stochastic gradient descent in
numpy, on the driver.

Training takes at most SAMPLE labelled documents, those of the smallest hash of their id (a bounded sample, by its
parameter); of each it takes the whole text, as counts by bucket made on the executors, so the driver holds at most
SAMPLE * BUCKETS numbers of 6 bytes, 590 MB, whatever the length of texts. Scoring is the average of vector times layer; as
both are linear, the product is taken once a bucket, and once a word for words met before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordTable, chunks, released, texts_of

BUCKETS, DIMENSION, GRAMS = 1 << 15, 8, (3, 4, 5)
#: STEPS (as many epochs as make up so many batches) and RATE are those of the least log loss on documents of one training
#: fold after learning from the others.
SAMPLE, STEPS, BATCH, RATE, SEED = 3000, 900, 16, 0.1, 7
THRESHOLD = 0.7
#: The multiplier of the polynomial hash (odd, so that it has an inverse modulo 2**64) and of the final mix.
BASE, MIX = 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD
INVERSE = pow(BASE, -1, 1 << 64)
#: A word's own number: so many bits of its hash as a double keeps.
WORD_BITS = np.uint64((1 << 52) - 1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(MIX)
    return h ^ (h >> np.uint64(29))


def bucket(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(BUCKETS - 1)).astype(np.int32)


#: The bucket of a word that follows itself.
REPEATED = int(bucket(mixed(np.array([BASE], np.uint64)))[0])


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of words and their n-grams, word by word, how many each word has (one at least), and the words' numbers."""
    raw = np.frombuffer(b" " + b"  ".join(words) + b" ", np.uint8).astype(np.uint64)
    marked = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(marked) - marked
    up = np.full(len(raw), BASE, np.uint64)
    up[0] = 1
    up = np.multiply.accumulate(up)
    down = np.full(len(raw), INVERSE, np.uint64)
    down[0] = 1
    down = np.multiply.accumulate(down)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw + np.uint64(1)) * up, out=total[1:])

    def hashed(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
        return mixed((total[b] - total[a]) * down[a] + np.uint64(kind))

    each = [np.maximum(marked - n + 1, 0) for n in GRAMS]
    count = 1 + sum(each)
    out = np.empty(int(count.sum()), np.int32)
    first = np.cumsum(count) - count
    own = hashed(starts, starts + marked, 0)
    out[first] = bucket(own)
    offset = first + 1
    for n, length in zip(GRAMS, each, strict=True):
        run = np.repeat(np.arange(len(words)), length)
        place = np.arange(len(run)) - (np.cumsum(length) - length)[run]
        a = starts[run] + place
        out[offset[run] + place] = bucket(hashed(a, a + n, n))
        offset = offset + length
    return out, count, own & WORD_BITS


def bigrams(numbers: np.ndarray) -> np.ndarray:
    """The bucket of each word with the next, by the words' numbers."""
    a, b = numbers[:-1], numbers[1:]
    return np.where(a == b, np.int32(REPEATED), bucket(mixed(a * np.uint64(BASE) + b)))


def histogram(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text, in order, with their share of its average."""
    total = np.zeros(BUCKETS)
    words = text.split()
    step = 200_000
    for s in range(0, len(words), step):
        # The first word of the next part goes along, for its bigram.
        found, count, numbers = features(words[s : s + step + 1])
        weight = np.repeat(1 / count, count)
        extra = int(count[-1]) if s + step < len(words) else 0
        total += np.bincount(found[: len(found) - extra], weight[: len(found) - extra], BUCKETS) + np.bincount(bigrams(numbers), minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at.astype(np.uint16), (total[at] / max(1, 2 * len(words) - 1)).astype(np.float32)


def training_rows(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, sample: int) -> DataFrame:
    """(y, buckets, shares) of the sample, one row a key, so never more than `sample`, however often rows are repeated.

    A key that has several labels counts by their average, from a half up as 1; of several texts it gives the least.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
        .orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(sample)
    )
    # At most `sample` rows of two numbers, by the limit: this side is small whatever the input.
    found = docs.select(F.col(key), F.col(text).alias("__quality_text")).join(F.broadcast(chosen), key)
    some = found.groupBy(key).agg(F.min("y").alias("y"), F.min("__quality_text").alias("__quality_text")).select("y", "__quality_text")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [histogram(raw or b"") for raw in texts_of(batch, "__quality_text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[k].tobytes() for f in found], pa.binary()) for k in (0, 1))], ["y", "buckets", "shares"])

    return some.mapInArrow(run, "y int, buckets binary, shares binary")


def learn(y: np.ndarray, buckets: list[np.ndarray], shares: list[np.ndarray], epochs: int | None = None) -> tuple[np.ndarray, float]:
    """The weight of each bucket and the bias of label 1 against label 0, by stochastic gradient descent with Adagrad steps."""
    if not len(y) or y.min() == y.max():
        sure = 0.0 if not len(y) else 3.0 if y[0] else -3.0
        return np.zeros(BUCKETS, np.float32), sure
    epochs = epochs or -(-STEPS * BATCH // len(y))
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-0.5, 0.5, (BUCKETS, DIMENSION)).astype(np.float32) / DIMENSION
    layer, bias = rng.normal(0, 0.3, (DIMENSION, 2)).astype(np.float32), np.zeros(2, np.float32)
    slow_v, slow_l, slow_b = np.full(BUCKETS, 1e-8, np.float32), np.full_like(layer, 1e-8), np.full(2, 1e-8, np.float32)
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(y))
        for s in range(0, len(order), BATCH):
            rows = order[s : s + BATCH]
            rows = [r for r in rows if len(buckets[r])]
            if not rows:
                continue
            at = np.concatenate([buckets[r] for r in rows])
            share = np.concatenate([shares[r] for r in rows])
            cut = np.cumsum([0] + [len(buckets[r]) for r in rows[:-1]])
            mean = np.add.reduceat(vectors[at] * share[:, None], cut)
            logit = mean @ layer + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = p
            error[np.arange(len(rows)), y[rows]] -= 1
            error /= len(rows)
            to_layer, to_bias, to_mean = mean.T @ error, error.sum(0), error @ layer.T
            run = np.repeat(np.arange(len(rows)), np.diff(np.r_[cut, len(at)]))
            own, inverse = np.unique(at, return_inverse=True)
            grad = np.stack([np.bincount(inverse, share * to_mean[run, d], len(own)) for d in range(DIMENSION)], 1).astype(np.float32)
            slow_v[own] += (grad**2).mean(1)
            vectors[own] -= rate * grad / np.sqrt(slow_v[own])[:, None]
            slow_l += to_layer**2
            layer -= rate * to_layer / np.sqrt(slow_l)
            slow_b += to_bias**2
            bias -= rate * to_bias / np.sqrt(slow_b)
    both = vectors @ layer
    return (both[:, 1] - both[:, 0]).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    rows = training_rows(docs, labels, text, key, label, sample).toArrow()
    y = rows.column("y").to_numpy().astype(np.int64)
    buckets, shares = ([np.frombuffer(x.as_buffer(), kind) for x in rows.column(c)] for c, kind in (("buckets", np.uint16), ("shares", np.float32)))
    order = sorted(range(len(y)), key=lambda i: (y[i], len(buckets[i]), buckets[i].tobytes()))  # tasks end in any order
    return learn(y[order] if len(y) else y, [buckets[i] for i in order], [shares[i] for i in order])


def score(docs: DataFrame, weights: np.ndarray, bias: float, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score) of every document. A text without words scores by the bias alone; null is empty."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kind = docs.schema[key].dataType

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value.astype(np.float64)

        def values(words: list[bytes]) -> tuple[np.ndarray, ...]:
            found, count, numbers = features(words)
            return np.add.reduceat(weight[found], np.cumsum(count) - count) / count, numbers

        table = WordTable(values, 2, 150_000)
        for batch in batches:
            out = np.full(batch.num_rows, float(bias))
            for first, part in chunks(texts_of(batch, "__quality_text")):
                split = [raw.split() for raw in part]
                own = [i for i, words in enumerate(split) if words]
                if own:
                    value, numbers = table([w for i in own for w in split[i]])
                    length = np.array([len(split[i]) for i in own])
                    pair = weight[bigrams(numbers.astype(np.uint64))]
                    ends = np.cumsum(length)
                    pair[ends[:-1] - 1] = 0  # from one document to the next
                    # Each document is summed by itself: equal texts have equal scores, wherever they stand.
                    out[np.array(own) + first] += np.add.reduceat(value + np.append(pair, 0.0), ends - length) / (2 * length - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-out)))], ["k", "score"])

    some = docs.select(F.col(key).alias("k"), F.col(text).alias("__quality_text"))
    return some.mapInArrow(run, T.StructType([T.StructField("k", kind), T.StructField("score", T.DoubleType())])).withColumnRenamed("k", key)


def held_out(key: str = "doc_id"):
    """The fold that training leaves out: crc32 of the id as text, modulo 4, is 2. A null id is not in it."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels of the held-out fold are not read for training.

    Null and empty texts have no features and score by the bias; a null id is in no fold; repeated rows give repeated rows,
    an empty table none; a text of any length is averaged whole; further columns are not read. Without labels, or with
    labels of one kind, every score is that of the kind.
    """
    weights, bias = fit(docs, labels.where(~held_out()))
    return score(docs, weights, bias).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
