"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton accepts every run of words of every test item, never across items. Training words stream through it; at
each word it gives the length of the longest run that ends there and occurs in an item. A window (`window` consecutive
words of an item, or a whole item that has fewer) ends wherever that length reaches it.

Items are taken in blocks of bounded size, each an automaton of its own, and all blocks are applied to every document,
so a test set of any size is matched whole: one broadcast carries up to BLOCKS_AT_ONCE blocks, and further ones follow in
a further pass over the same rows, which are written between passes and to which it adds its hits.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, stash, texts_of

#: Words as the contract has them: ASCII letters and digits and all bytes from 0x80 on; A-Z are lowered.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
WINDOW = 10
#: Bytes of item text in one automaton, and automata in one pass over the documents.
BLOCK_BYTES, BLOCKS_AT_ONCE = 2_000_000, 8


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class Automaton:
    """Generalised suffix automaton of word sequences.

    It grows in dictionaries, a block at a time, and is kept in flat arrays: transitions sorted by (state, word), the link and
    length of each state, and the windows that end at a state, sorted by state. What is sent to tasks are these arrays.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        pairs, sequences = set(), []
        for name, words in items:
            ids = [number(w, len(self.vocabulary)) for w in words]
            sequences.append((name, ids))
            pairs.update(zip(ids, ids[1:], strict=False))
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.least = min((min(len(ids), window) for _, ids in sequences if ids), default=window)
        n = self.n = len(self.vocabulary)
        self.pairs = np.array(sorted(a * n + b for a, b in pairs), np.int64)
        self.names = sorted({name for name, _ in sequences})
        of = {name: i for i, name in enumerate(self.names)}
        # Of the states that hold a window: its length and the item. A state holds runs of several lengths, and only one of
        # them can be a long window; whole short items may be several.
        windows = array("q")
        for name, ids in sequences:
            need = min(window, len(ids))
            state = run = 0
            for c in ids:
                state, run = self.step[state][c], run + 1
                if run >= need:
                    at = state
                    while self.length[self.link[at]] >= need:
                        at = self.link[at]
                    windows.extend((at, need, of[name]))
        found = np.unique(np.frombuffer(windows, np.int64).reshape(-1, 3), axis=0) if windows else np.zeros((0, 3), np.int64)
        self.at_state, self.need, self.item = (found[:, k].astype(np.int32) for k in range(3))
        self._freeze()

    def _freeze(self) -> None:
        size = sum(map(len, self.step))
        keys, targets = np.empty(size, np.int64), np.empty(size, np.int32)
        at = 0
        for state, out in enumerate(self.step):
            if out:
                for c in sorted(out):
                    keys[at], targets[at] = state * self.n + c, out[c]
                    at += 1
        self.keys, self.targets = keys, targets
        self.link, self.length = np.array(self.link, np.int32), np.array(self.length, np.int32)
        del self.step

    def next(self, state: int, c: int) -> int:
        """The state after `state` and a word, or -1."""
        key = state * self.n + c
        at = int(np.searchsorted(self.keys, key))
        return int(self.targets[at]) if at < len(self.keys) and self.keys[at] == key else -1

    def _extend(self, last: int, c: int) -> int:
        step, link, length = self.step, self.link, self.length
        if c in step[last]:
            q = step[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p != -1:
            q = step[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        step, link, length = self.step, self.link, self.length
        twin = len(step)
        step.append(dict(step[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = twin
        while p != -1 and step[p].get(c) == q:
            step[p][c] = twin
            p = link[p]
        return twin

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans [from, to) that windows cover, one for each window met, and the items of these windows."""
        n = self.n
        if not n or not words:
            return [], set()
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        known = ids >= 0
        if not known.any():
            return [], set()
        # Runs of words of which all neighbours are neighbours in some item; a window lies in one such run.
        both = known[:-1] & known[1:]
        at = np.flatnonzero(both)
        if len(at) and len(self.pairs):
            key = ids[at] * n + ids[at + 1]
            slot = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            at = at[self.pairs[slot] == key]
        else:
            at = at[:0]
        starts, ends = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(at):
            cut = np.flatnonzero(np.diff(at) > 1)
            starts, ends = at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]] + 2
        if self.least == 1:
            alone = known.copy()
            for a, b in zip(starts, ends, strict=True):
                alone[a:b] = False
            alone = np.flatnonzero(alone)
            starts, ends = np.r_[starts, alone], np.r_[ends, alone + 1]
        spans, items = [], set()
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if b - a >= self.least:
                self._walk(ids[a:b].tolist(), a, spans, items)
        return spans, items

    def _walk(self, ids: list[int], offset: int, spans: list, items: set) -> None:
        link, length = self.link, self.length
        state = run = 0
        for i, c in enumerate(ids):
            after = self.next(state, c)
            while after < 0 and state:
                state = int(link[state])
                run = int(length[state])
                after = self.next(state, c)
            if after >= 0:
                state, run = after, run + 1
            if run < self.least:
                continue
            at = state
            while at > 0:
                for k in range(*np.searchsorted(self.at_state, (at, at + 1)).tolist()):
                    if self.need[k] <= run:
                        spans.append((offset + i + 1 - int(self.need[k]), offset + i + 1))
                        items.add(self.names[self.item[k]])
                at = int(link[at])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks_of(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in blocks of bounded text size. The driver holds one partition of test items at a time."""
    part, size = [], 0
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t")).where(F.col(text).isNotNull())
    for row in rows.toLocalIterator():
        raw = row["t"].encode("utf-8", "surrogatepass")
        words = words_of(raw)
        if not words:
            continue
        if part and size + len(raw) > block_bytes:
            yield part
            part, size = [], 0
        part.append((row["i"], words))
        size += len(raw)
    if part:
        yield part


SPANS = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
ARROW_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
#: Columns that scan() adds; the prefix keeps them apart from columns of the documents.
TEXT, N_WORDS, HIT_SPANS, HIT_ITEMS, CUT = "__decon_text", "__decon_n_words", "__decon_spans", "__decon_items", "__decon_cut"


def scan(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES, most_covered: float | None = None) -> DataFrame:
    """Columns `keep` of every document, and N_WORDS, HIT_SPANS (merged, in words, [from, to)) and HIT_ITEMS (sorted ids).

    Null and empty texts have no words. A null item id counts as the empty string; items without words match nothing;
    items of one id are one item with several texts. Each document is matched whole, whatever its length.

    With most_covered, documents of which more than this share of words is hit are left out, spans are cut from the text
    of the others, and CUT says whether they were.
    """
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    own = [docs[c] for c in keep]
    of = text
    if most_covered is not None:
        if text not in keep:
            raise ValueError("texts are cut where they are kept")
    else:
        own.append(docs[text].alias(TEXT))
        of = TEXT
    out = docs.select(*own, F.lit(None).cast(SPANS).alias(HIT_SPANS), F.lit(None).cast(T.ArrayType(T.StringType())).alias(HIT_ITEMS))
    kind = T.StructType([*out.schema.fields, T.StructField(N_WORDS, T.LongType()), T.StructField(CUT, T.BooleanType())])
    blocks = blocks_of(items, item_id, item_text, block_bytes)
    group = list(islice(blocks, BLOCKS_AT_ONCE))
    while True:
        after = list(islice(blocks, BLOCKS_AT_ONCE))
        automata = spark.sparkContext.broadcast([Automaton(block, window) for block in group])
        out = out.drop(N_WORDS, CUT).mapInArrow(_scanner(automata, of, None if after else most_covered), kind)
        if not after:
            return out.drop(TEXT)
        out = stash(out, "scanned")  # so that a task holds the automata of one pass
        automata.destroy()
        group = after


#: Rows that are held and given on at a time.
ROWS = 1000


def _scanner(group, text: str, most_covered: float | None):
    """Adds the hits of one broadcast of automata to those that earlier passes have found, and cuts if it is the last."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = group.value
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                yield part(whole.slice(start, ROWS), automata)

    def part(batch: pa.RecordBatch, automata: list[Automaton]) -> pa.RecordBatch:
        names = batch.schema.names
        texts = texts_of(batch, text)
        old_spans, old_items = (batch.column(names.index(c)).to_pylist() for c in (HIT_SPANS, HIT_ITEMS))
        n_words, spans, items, stays, cut = [], [], [], [], []
        for i, (raw, some_spans, some_items) in enumerate(zip(texts, old_spans, old_items, strict=True)):
            words = words_of(raw) if raw else []
            got = [(x["a"], x["b"]) for x in some_spans or ()]
            ids = set(some_items or ())
            for automaton in automata:
                a, b = automaton.hits(words)
                got += a
                ids |= b
            got = merged(got)
            n_words.append(len(words))
            spans.append([{"a": a, "b": b} for a, b in got])
            items.append(sorted(ids))
            stays.append(most_covered is None or sum(b - a for a, b in got) <= most_covered * len(words))
            cut.append(most_covered is not None and bool(got) and stays[-1])
            if cut[-1]:
                texts[i] = without(raw, got)
        made = {HIT_SPANS: pa.array(spans, ARROW_SPANS), HIT_ITEMS: pa.array(items, pa.list_(pa.string())), N_WORDS: pa.array(n_words, pa.int64()), CUT: pa.array(cut, pa.bool_())}
        if any(cut):
            made[text] = pa.array(texts, pa.binary()).cast(batch.schema.field(text).type)
        out = pa.RecordBatch.from_arrays([made.get(n, batch.column(k)) for k, n in enumerate(names)] + [made[N_WORDS], made[CUT]], [*names, N_WORDS, CUT])
        return out if all(stays) else out.filter(pa.array(stays))

    return run


def report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = scan(docs, items, keep=["doc_id"], **options)
    n_hit = F.aggregate(HIT_SPANS, F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    return hit.select(
        "doc_id", F.col(N_WORDS).alias("n_words"), n_hit.alias("n_hit"), F.size(HIT_ITEMS).cast("long").alias("n_items"),
        F.sha2(F.array_join(HIT_ITEMS, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def oracle(window: int = WINDOW) -> str:
    """report() in SQL: all windows of documents against all windows of items, by their words."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = lambda c: f"regexp_extract_all(translate(coalesce({c}, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {words("text")} AS w FROM benchmark),
i AS (SELECT item, w, least(len(w), {window}) AS n FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS gram FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM i)),
d AS (SELECT row_number() OVER () AS r, doc_id, {words("text")} AS w FROM documents),
p AS (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS gram FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
h AS (SELECT r, p.n, s, item FROM p JOIN g ON p.gram = g.gram AND p.n = g.n),
o AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS x FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN o USING (r) LEFT JOIN t USING (r)"""


#: A document of which more than this share of words is test material goes; of the others the passages go.
MOST_COVERED = 0.5


def clean(docs: DataFrame, items: DataFrame, text: str = "text", most_covered: float = MOST_COVERED, window: int = WINDOW) -> DataFrame:
    """The documents without test passages: hit spans are cut out, and documents covered beyond the limit are dropped.

    Columns and other rows stay as they are, null and empty texts included; n_chars, where there is one, follows a text
    that was cut. The cut takes the bytes from a span's first word to its last.
    """
    out = scan(docs, items, text=text, window=window, most_covered=most_covered)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(CUT), F.char_length(F.col(text)).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    places = [m.span() for m in WORD.finditer(raw)]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, raw[at:]])
