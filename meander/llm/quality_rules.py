"""Quality rules: an n-gram perplexity with bands by language, beside plain counts of a text.

The language model is a modified Kneser-Ney model of byte n-grams of the order ORDER over the whole text: words are joined
by one space, numbers and rare identifiers are one digit, n-grams run across words, and ORDER - 1 spaces stand before the first. Every language has a model of its
own, a null language as well. Spark counts the n-grams of all documents (a task counts its own first, so what is shuffled
is at most a task's distinct n-grams), takes continuation counts, discounts and back-off weights from the counts by
aggregation, and the probabilities of each order by a join with the order below.

The model is stored in sorted arrays of 64-bit hashes of (language, order, n-gram) beside probabilities, and of (language,
order, context) beside back-off weights, looked up by binary search. Arrays are dealt to blocks of about BLOCK numbers by
the two bytes before the last one, so that all that is asked about one place of a text is in one block; one pass over the
texts takes one block and adds up the places that are its own. So the model may be of any size and has one order at every
size; the number of blocks changes no result.

A document's perplexity is that of all its bytes. What only the document itself has taught the model does not count for
it: an n-gram of which it has all occurrences is scored as one not seen, by the order below, and so is an n-gram of a lower
order that has no left neighbour but such a one. Else a text of nothing but noise would look well known. Bands are, by language, the median of the logarithm of the perplexity
over all documents plus and minus multiples of its median absolute deviation, in cells of CELL.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, released, stash, texts_of

#: Bytes of an n-gram; at most 5, as its number and its order share 64 bits.
ORDER = 4
#: Probabilities in one block of the model, and passes over the texts that one stage takes.
BLOCK, PASSES = 4_000_000, 4
#: Cells of log perplexity: CELL wide, from 0 to CELLS * CELL.
CELL, CELLS = 0.001, 20_000
#: Multiples of the median absolute deviation (times 1.4826, as of a normal distribution) below and above the median, set
#: from labelled quality rows: the README has the figures. LEAST_WIDTH is for languages in which a crowd of copies makes the
#: deviation nothing; it is far below the multiples of all others.
BELOW, ABOVE, LEAST_WIDTH = 6.0, 4.0, 0.01
#: Documents of fewer words are judged by no band: their perplexity says little.
LEAST_WORDS = 50

#: Distinct n-grams that a task holds before it gives them on; bounds memory only.
HELD = 1_000_000
#: Text bytes that one step works on, with some ten numbers of 8 bytes for each.
STEP_BYTES = 500_000

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
NOT_COUNTED = SPACES + bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
#: A run of digits is one digit to the model, and so is a run of ASCII letters, digits and joining signs with a digit in it:
#: an identifier or a secret here and there says nothing of a text. Where such runs are over a tenth of a text's bytes, it is
#: judged by them: only digits are one digit then. So less than a tenth of any text is not looked at.
DIGITS = re.compile(rb"[0-9]+")
IDENTIFIER = re.compile(rb"(?<![A-Za-z0-9+/=_.-])[A-Za-z+/=_.-]*+[0-9][A-Za-z0-9+/=_.-]*+")
MOST_IDENTIFIERS = 0.1
#: Multipliers of the hash of the arrays (odd, so that n-grams of one language never meet).
MIX = (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD)


def without_numbers(raw: bytes) -> bytes:
    some = sum(map(len, IDENTIFIER.findall(raw)))
    return (IDENTIFIER if some <= MOST_IDENTIFIERS * len(raw) else DIGITS).sub(b"0", raw) if some else raw


def n_grams(texts: list[list[bytes]], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of texts (as words) as numbers, one for each byte and one for the end, and how many each text has."""
    pad = b" " * (order - 1)
    padded = [pad + without_numbers(b" ".join(words)) + b" " for words in texts]
    raw = np.frombuffer(b"".join(padded), np.uint8).astype(np.uint64)
    every = np.zeros(len(raw) - order + 1, np.uint64)
    for k in range(order):
        every = every << np.uint64(8) | raw[k : len(raw) - order + 1 + k]
    length = np.fromiter(map(len, padded), np.int64, len(padded))
    count = length - order + 1
    starts = np.cumsum(length) - length
    return every[np.repeat(starts - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))], count


def by_language(langs: list[int], texts: list[bytes]) -> Iterator[tuple[int, list[int], list[list[bytes]]]]:
    """(language, places, words of the texts that have some) in steps of bounded size."""
    for first, part in chunks(texts, STEP_BYTES):
        groups: dict[int, list[int]] = {}
        split = [raw.split() for raw in part]
        for i, words in enumerate(split):
            if words:
                groups.setdefault(langs[first + i], []).append(i)
        for lang, own in groups.items():
            yield lang, [first + i for i in own], [split[i] for i in own]


def language(column: Column) -> Column:
    """A language as a number; null is the empty language."""
    return F.xxhash64(F.coalesce(column.cast("string"), F.lit("")))


def count_grams(docs: DataFrame, text: str, lang: str, order: int = ORDER) -> DataFrame:
    """(l, gram, n): n-grams of all documents by language."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        fresh: dict[int, list[np.ndarray]] = {}

        def settle(lang: int) -> None:
            if fresh.get(lang):
                parts = [np.unique(x, return_counts=True) for x in fresh.pop(lang)]
                parts += [held[lang]] if lang in held else []
                grams, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                held[lang] = grams, np.bincount(at, np.concatenate([p[1] for p in parts]), len(grams)).astype(np.int64)

        def given() -> Iterator[pa.RecordBatch]:
            for lang in [*fresh]:
                settle(lang)
            for lang in [*held]:
                grams, n = held.pop(lang)
                for s in range(0, len(grams), 50_000):
                    part = slice(s, s + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams[part]), lang)), pa.array(grams[part].view(np.int64)), pa.array(n[part])], ["l", "gram", "n"])

        for batch in batches:
            for lang, _, words in by_language(batch.column(1).to_pylist(), texts_of(batch, "__rules_text")):
                fresh.setdefault(lang, []).append(n_grams(words, order)[0])
                if sum(map(len, fresh[lang])) > HELD // 2:
                    settle(lang)
            if sum(len(g) for g, _ in held.values()) + sum(len(x) for f in fresh.values() for x in f) > 2 * HELD:
                yield from given()
        yield from given()

    some = docs.select(F.col(text).alias("__rules_text"), language(F.col(lang)).alias("l"))
    return some.mapInArrow(run, "l long, gram long, n long").groupBy("l", "gram").agg(F.sum("n").alias("n"))


def discounts(levels: DataFrame) -> DataFrame:
    """(k, l, d1, d2, d3): modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from the numbers of counts 1 to 4; levels: (k, l, n)."""
    of = levels.groupBy("k", "l").agg(*[F.count_if(F.col("n") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)])
    n1, n2, n3, n4 = (F.col(f"n{k}") for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    enough = (n1 > 0) & (n2 > 0)
    within = lambda x, k: F.least(F.greatest(x, F.lit(0.05)), F.lit(k - 0.05))
    return of.select(
        "k", "l", F.when(enough, within(1 - 2 * y * n2 / n1, 1)).otherwise(0.5).alias("d1"), F.when(enough, within(2 - 3 * y * n3 / n2, 2)).otherwise(0.75).alias("d2"),
        F.when(enough & (n3 > 0), within(3 - 4 * y * n4 / n3, 3)).otherwise(0.9).alias("d3"),
    )


def kneser_ney(grams: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """(l, k, gram, p, n) of all n-grams of every order k and of their contexts: interpolated probabilities and counts of
    n-grams, back-off weights and totals of contexts.

    grams: (l, gram, n) of the highest order, written. The lower orders count distinct left neighbours.
    """
    levels = [grams]
    for k in range(order - 1, 0, -1):
        levels.insert(0, stash(levels[0].groupBy("l", F.col("gram").bitwiseAND((1 << 8 * k) - 1).alias("gram")).agg(F.count("*").alias("n")), "level"))
    # Three numbers a language and order, written, so that Spark knows how small they are.
    cuts = stash(discounts(reduce(DataFrame.unionByName, [level.select(F.lit(k).alias("k"), "l", "n") for k, level in enumerate(levels, 1)])), "discounts")
    below, probabilities, contexts = None, [], []
    for k, level in enumerate(levels, 1):
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        own = level.join(cuts.where(F.col("k") == k).drop("k"), "l").select("l", "gram", "n", cut.alias("cut"), F.shiftright("gram", 8).alias("context"))
        back = stash(own.groupBy("l", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("cut_total")).select("l", "context", "total", (F.col("cut_total") / F.col("total")).alias("back")), "context")
        rows = own.join(back, ["l", "context"]).select("l", "gram", "n", ((F.col("n") - F.col("cut")) / F.col("total")).alias("own"), "back", F.col("gram").bitwiseAND((1 << 8 * (k - 1)) - 1).alias("lower"))
        if below is None:
            found = rows.select("l", "gram", "n", (F.col("own") + F.col("back") / 256).alias("p"))
        else:
            found = rows.join(below.select("l", F.col("gram").alias("lower"), F.col("p").alias("p_lower")), ["l", "lower"]).select("l", "gram", "n", (F.col("own") + F.col("back") * F.col("p_lower")).alias("p"))
        below = stash(found, "probability")
        probabilities.append(below.select("l", F.lit(k).alias("k"), "gram", "p", "n"))
        contexts.append(back.select("l", F.lit(k).alias("k"), F.col("context").alias("gram"), F.col("back").alias("p"), F.col("total").alias("n")))
    return reduce(DataFrame.unionByName, probabilities), reduce(DataFrame.unionByName, contexts)


def hashed(lang, k, gram: np.ndarray) -> np.ndarray:
    """The 64-bit hash by which arrays are sorted; lang and k are numbers or arrays."""
    lang, k = (np.asarray(x).astype(np.int64).view(np.uint64) for x in (lang, k))
    h = (gram | k << np.uint64(40)) * np.uint64(MIX[0]) ^ lang
    h = (h ^ h >> np.uint64(32)) * np.uint64(MIX[1])
    return h ^ h >> np.uint64(29)


def block_of(lang, pair: np.ndarray, blocks: int) -> np.ndarray:
    """The block of the last two bytes of a context."""
    return (hashed(lang, 0, pair) >> np.uint64(11)) % np.uint64(blocks)


class Block:
    """A part of the model: sorted hashes of n-grams with probabilities, and of contexts with back-off weights; counts of both."""

    def __init__(self, number: int, blocks: int, order: int, grams: pa.Table, contexts: pa.Table):
        self.number, self.blocks, self.order = number, blocks, order
        self.grams, self.contexts = self._sorted(grams, 8), self._sorted(contexts, 0)

    def _sorted(self, table: pa.Table, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lang, k, gram, p, n = (table.column(c).to_numpy() for c in ("l", "k", "gram", "p", "n"))
        gram = gram.view(np.uint64)
        # What orders 1 and 2 ask has no two bytes of context: these rows are in every block, 65,792 a language at most.
        own = (k <= 2) | (block_of(lang, gram >> np.uint64(shift) & np.uint64(0xFFFF), self.blocks) == self.number)
        h = hashed(lang[own], k[own], gram[own])
        up = np.argsort(h)
        return h[up], p[own][up], n[own][up]

    @staticmethod
    def _of(table: tuple[np.ndarray, np.ndarray, np.ndarray], asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value and count of hashes; 1 and 0 where there is none."""
        keys, values, counts = table
        if not len(keys):
            return np.ones(len(asked)), np.zeros(len(asked), np.int64)
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        there = keys[at] == asked
        return np.where(there, values[at], 1.0), np.where(there, counts[at], 0)

    def probability(self, lang: int, gram: np.ndarray, times: np.ndarray | None = None, k: int | None = None) -> np.ndarray:
        """Of the last byte of each n-gram after the others. Only n-grams that an order has not seen go to the one below.

        times: how often the document itself has each n-gram; those that occur nowhere else go to the order below as well.
        """
        k = self.order if k is None else k
        if not k:
            return np.full(len(gram), 1 / 256)
        own = gram & np.uint64((1 << 8 * k) - 1)
        p, n = self._of(self.grams, hashed(lang, k, own))
        alone = n <= (0 if times is None else times)
        unseen = np.flatnonzero(alone)
        if len(unseen):
            # The context's back-off weight times the lower order; the lower order alone for a context that is unseen, or
            # seen with this n-gram alone.
            back, total = self._of(self.contexts, hashed(lang, k, own[unseen] >> np.uint64(8)))
            # An order below counts left neighbours: one that has this n-gram alone is of the document alone, too.
            below = None if times is None else (n[unseen] > 0).astype(np.int64)
            p[unseen] = np.where(total > n[unseen], back, 1.0) * self.probability(lang, gram[unseen], below, k - 1)
        return p

    def surprise(self, lang: int, gram: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Minus log probability of each n-gram of this block, 0 for those of other blocks."""
        out = np.zeros(len(gram))
        own = slice(None) if self.blocks == 1 else np.flatnonzero(block_of(lang, gram >> np.uint64(8) & np.uint64(0xFFFF), self.blocks) == self.number)
        out[own] = -np.log(self.probability(lang, gram[own], times[own]))
        return out


def blocks_of(grams: DataFrame, contexts: DataFrame, order: int = ORDER, block: int = BLOCK) -> Iterator[Block]:
    """The model block by block; the driver holds one at a time. Blocks are even but for chance, as pairs of bytes are many."""
    blocks = max(1, -(-grams.count() // block))

    def part(table: DataFrame, shift: int, number: int) -> pa.Table:
        if blocks == 1:
            return table.toArrow()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lang, k, gram = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                own = (k <= 2) | (block_of(lang, gram.view(np.uint64) >> np.uint64(shift) & np.uint64(0xFFFF), blocks) == number)
                yield b.filter(pa.array(own))

        return table.mapInArrow(run, table.schema).toArrow()

    for number in range(blocks):
        yield Block(number, blocks, order, part(grams, 8, number), part(contexts, 0, number))


def train(docs: DataFrame, text: str, lang: str, order: int = ORDER, block: int = BLOCK) -> Iterator[Block]:
    """The model of all documents."""
    grams = stash(count_grams(docs, text, lang, order), "grams")
    return blocks_of(*kneser_ney(grams, order), order, block)


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """COUNTS of a text."""
    words = raw.split()
    chars = len(raw.translate(None, NOT_COUNTED))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    covered = last = 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered += i + 3 - max(i, last)
            last = i + 3
    return covered


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


LANG, SURPRISE, PLACES = "__rules_lang", "__rules_surprise", "__rules_places"
FOUND = tuple(f"__rules_{c}" for c in COUNTS)


def log_ppl() -> Column:
    """Log perplexity; null without words."""
    return F.round(F.try_divide(F.col(SURPRISE), F.col(PLACES)), 9)


def measure(docs: DataFrame, text: str = "text", lang: str = "lang", keep: list[str] | None = None, order: int = ORDER, block: int = BLOCK) -> DataFrame:
    """Columns `keep` of every document, FOUND (the counts), LANG, and SURPRISE over PLACES: minus log probabilities and their number, 0 without words."""
    keep = docs.columns if keep is None else keep
    of = text if text in keep else "__rules_text"
    out = docs.select(*[docs[c] for c in keep], *([] if of == text else [docs[text].alias(of)]), language(docs[lang]).alias(LANG))
    width = len(out.columns)
    kind = T.StructType([*out.schema.fields, *(T.StructField(c, T.LongType()) for c in FOUND), T.StructField(PLACES, T.LongType()), T.StructField(SURPRISE, T.DoubleType())])
    sc = docs.sparkSession.sparkContext
    for number, part in enumerate(train(docs, text, lang, order, block)):
        if number and number % PASSES == 0:
            out = stash(out, "measured")
        out = out.mapInArrow(_scorer(sc.broadcast(part), of, width, order), kind)
    return out if of == text else out.drop(of)


def _scorer(shared, of: str, width: int, order: int):
    """Adds one block's part; the first pass takes the counts as well."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts, langs = texts_of(batch, of), batch.column(width - 1).to_pylist()
            if batch.num_columns == width:
                counts = [base_counts(raw or b"") for raw in texts]
                columns = [pa.array(c, pa.int64()) for c in (zip(*counts, strict=True) if counts else [()] * len(COUNTS))]
                total, places = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            else:
                columns = batch.columns[width : width + len(COUNTS)]
                places, total = (batch.column(width + len(COUNTS) + i).to_numpy(zero_copy_only=False).copy() for i in (0, 1))
            for lang, own, words in by_language(langs, texts):
                grams, count = n_grams(words, order)
                # Distinct n-grams of each document, with their numbers there.
                document = np.repeat(np.arange(len(own), dtype=np.uint64), count)
                key, times = np.unique(grams | document << np.uint64(40), return_counts=True)
                each = times * model.surprise(lang, key & np.uint64((1 << 40) - 1), times)
                total[own] += np.add.reduceat(each, np.searchsorted(key, np.arange(len(own), dtype=np.uint64) << np.uint64(40)))
                places[own] = count
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *columns, pa.array(places), pa.array(total)], [*batch.schema.names[:width], *FOUND, PLACES, SURPRISE])

    return run


N_WORDS, N_REPEATED = FOUND[0], FOUND[-1]


def base_failed():
    return (F.col(N_WORDS) < LEAST_WORDS) | (100 * F.col(N_REPEATED) > 50 * F.col(N_WORDS))


def bands(measured: DataFrame) -> DataFrame:
    """(LANG, low, high): lower and upper log perplexity by language, from the numbers of documents by cell."""
    cell = F.least(F.floor(log_ppl() / CELL), F.lit(CELLS)).cast("int")
    cells = stash(measured.where((F.col(N_WORDS) >= LEAST_WORDS) & (F.col(PLACES) > 0)).groupBy(LANG, cell.alias("cell")).agg(F.count("*").alias("n")), "cells")
    middle = stash(cells.groupBy(LANG).agg(F.percentile("cell", 0.5, F.col("n")).alias("middle")), "middles")
    width = cells.join(middle, LANG).groupBy(LANG, "middle").agg(F.percentile(F.abs(F.col("cell") - F.col("middle")), 0.5, F.col("n")).alias("width"))
    at, wide = (F.col("middle") + 0.5) * CELL, F.col("width") * (1.4826 * CELL)
    return stash(width.select(LANG, (at - F.greatest(BELOW * wide, F.lit(LEAST_WIDTH))).alias("low"), (at + F.greatest(ABOVE * wide, F.lit(LEAST_WIDTH))).alias("high")), "bands")


def judged(docs: DataFrame, text: str, lang: str, keep: list[str] | None, **options) -> tuple[DataFrame, list]:
    """measure(), written once, beside the bands, and the expressions of base_failed and kept.

    There is one band a language: the table is written first, so Spark knows its size and sends it to all tasks only if it
    is below the session's limit for that.
    """
    measured = stash(measure(docs, text, lang, keep, **options), "measured")
    inside = F.coalesce(log_ppl().between(F.col("__rules_low"), F.col("__rules_high")), F.lit(True))
    with_bands = measured.join(bands(measured).withColumnsRenamed({"low": "__rules_low", "high": "__rules_high"}), LANG, "left")
    return with_bands, [base_failed(), ~base_failed() & inside]


def report(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", **options) -> DataFrame:
    """One row per document: key, the counts, base_failed, kept, log_ppl and the bounds of its band.

    A null text has no words, symbols or lines; a null language is one of its own. A document without words or with
    fewer than LEAST_WORDS fails the base rules, whatever the model says. Repeated rows give repeated rows, an empty table
    none; further columns are not read.
    """
    judgement, (failed, kept) = judged(docs, text, lang, [key], **options)
    counts = [F.col(c).alias(n) for c, n in zip(FOUND, COUNTS, strict=True)]
    return judgement.select(key, *counts, failed.alias("base_failed"), kept.alias("kept"), log_ppl().alias("log_ppl"), F.col("__rules_low").alias("low"), F.col("__rules_high").alias("high"))


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of the documents that the rules keep, unchanged: rows with their measures are written once and filtered.

    Null and empty texts have no words and go; a null language is one of its own; repeated rows stay or go together, and
    their columns, whatever their names, come through as they are. An empty table gives an empty table.
    """
    judgement, (_, kept) = judged(docs, text, lang, None)
    return judgement.where(kept).select(*[judgement[c] for c in docs.columns])
