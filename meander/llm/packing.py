"""Best-fit packing of tokenised documents into sequences.

Tokens: byte-level BPE of a public vocabulary file. Where the file's merges are in the order of their ids, a tokenizer
that merges by rank gives the same ids several times faster, and takes all texts of Latin letters and common punctuation;
any other text, on which two Unicode versions may differ, goes to the tokenizer of the file, and so does one with a special
string of the vocabulary.

Packing: bounded-space online best-fit. A packer holds at most OPEN_BINS open sequences, as stacks by free space with one
bit per non-empty stack; a piece goes to the open sequence that leaves the least room, found by shifting the bit set. When
one more must be opened, the fullest closes. Pieces come in a fixed pseudo-random order, so a lost task gives the same
sequences again; each WINDOW of them arrives from the longest to the shortest, for which best-fit leaves next to nothing.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, stash, texts_of

SEQUENCE = 2048
OPEN_BINS = WINDOW = 4096
#: Pieces that one packer takes. Sequences still open at its end are all the waste that parallel packing adds.
PIECES_A_PACKER = 100_000
END_ID = 0

#: Fixed value: how byte-level vocabularies of this kind split a text into words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of which the classes are the same in all versions: Latin and common punctuation.
PLAIN = re.compile(r"[\t\n\v\f\r\x20-\x7e¡-¬®-ɏ‐-‧‰-⁞₠-₵]*+")


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones as they are, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit numbers."""

    def __init__(self, vocabulary: str):
        self.vocabulary = vocabulary
        self.fast = self._by_ranks(vocabulary)

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.vocabulary)

    def _by_ranks(self, vocabulary: str):
        """The same vocabulary as ranks, if it splits texts as SPLIT does and each merge makes the next id: then merging by rank
        and by the list are one. Texts with one of its added strings are left to the tokenizer of the file."""
        import tiktoken

        with open(vocabulary, encoding="utf-8") as f:
            whole = json.load(f)
        model, before = whole["model"], whole.get("pre_tokenizer") or {}
        self.added = [t["content"] for t in whole.get("added_tokens") or []]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        split = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if model.get("type") != "BPE" or whole.get("normalizer") or whole.get("truncation") or whole.get("padding") or not plain or not split:
            return None
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids, byte = model["vocab"], letters()
        if any(ids.get(m) != 256 + i for i, m in enumerate(merges)) or {ids.get(c) for c in byte} != set(range(256)):
            return None
        ranks = {bytes(byte[c] for c in token): i for token, i in ids.items() if i < 256 + len(merges)}
        return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> bytes:
        fast = self.fast and PLAIN.fullmatch(text) and not any(a in text for a in self.added)
        ids = self.fast.encode_ordinary(text) if fast else self.whole(text)
        return np.array(ids, "<u4").tobytes()


def pieces(docs: DataFrame, vocabulary: str | None = None, text: str = "text", key: str = "doc_id", sequence: int = SEQUENCE) -> DataFrame:
    """key, piece, start, length, ids_crc32 and order of each document's pieces.

    A document is its ids and END_ID after them; null is empty. A longer one is cut into pieces of `sequence` ids, of
    which the first takes the remainder.
    """
    vocabulary = vocabulary or public_vocabulary()
    end = np.array([END_ID], "<u4").tobytes()
    kind = docs.schema[key].dataType.simpleString()

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary)
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for i, raw in enumerate(texts_of(batch, "__pack_text")):
                ids = (encode(raw.decode("utf-8", "replace")) if raw else b"") + end
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    to = min(n, n % sequence or sequence) if not at else at + sequence
                    rows.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(ids[4 * at : 4 * to]))
                    at, k = to, k + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["k", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).alias("k"), F.col(text).alias("__pack_text")).mapInArrow(run, f"k {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("k", key)


class Bins:
    """Open sequences, by free space."""

    def __init__(self, most: int = OPEN_BINS, sequence: int = SEQUENCE):
        self.most, self.sequence = most, sequence
        self.stacks: list[list[int]] = [[] for _ in range(sequence + 1)]
        self.bits = 0
        self.open = 0
        self.made = 0

    def put(self, size: int) -> tuple[int, int]:
        """The sequence for a piece of this size, and the place in it."""
        stacks = self.stacks
        above = self.bits >> size
        if above:
            free = size + (above & -above).bit_length() - 1
            stack = stacks[free]
            number = stack.pop()
            if not stack:
                self.bits ^= 1 << free
            self.open -= 1
        else:
            free, number = self.sequence, self.made
            self.made += 1
        left = free - size
        if left:
            if self.open >= self.most:
                least = (self.bits & -self.bits).bit_length() - 1
                if least >= left:
                    return number, self.sequence - free  # itself the fullest: it closes
                stacks[least].pop()
                if not stacks[least]:
                    self.bits ^= 1 << least
                self.open -= 1
            stacks[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.sequence - free


def pack(found: DataFrame, key: str = "doc_id", sequence: int = SEQUENCE, open_bins: int = OPEN_BINS, window: int = WINDOW, pieces_a_packer: int = PIECES_A_PACKER) -> DataFrame:
    """The pieces with sequence_id and offset. Every length from 1 to `sequence` is taken; repeated rows are pieces of their own."""
    count = found.count()
    packers = max(1, -(-count // pieces_a_packer))
    names = found.columns
    # A hash of the whole row deals pieces evenly and fixes their order, so that a lost task packs as before.
    dealt = found.withColumn("__order", F.xxhash64(*[F.col(c) for c in names])).repartition(packers, "__order").sortWithinPartitions("__order", key, "piece")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        bins = Bins(open_bins, sequence)

        def placed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            order = np.argsort(-table.column("length").to_numpy(), kind="stable")
            table = table.take(pa.array(order))
            at = [bins.put(n) for n in table.column("length").to_pylist()]
            ids = np.array([p[0] for p in at], np.int64) + base
            columns = [table.column(i).combine_chunks() for i in range(len(names))]
            return pa.RecordBatch.from_arrays([*columns, pa.array(ids), pa.array([p[1] for p in at], pa.int64())], [*names, "sequence_id", "offset"])

        held, size = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, window - size)
                held.append(part)
                size += part.num_rows
                batch = batch.slice(part.num_rows)
                if size == window:
                    yield placed(held)
                    held, size = [], 0
        if size:
            yield placed(held)

    schema = ", ".join(f"`{c}` {t}" for c, t in found.dtypes) + ", sequence_id long, offset long"
    return dealt.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, text: str = "text", key: str = "doc_id", sequence: int = SEQUENCE, **options) -> DataFrame:
    """Tokenise once, write the pieces' numbers (not their ids) to the shared folder, and pack them.

    A null or empty text is one piece of the end id alone; null keys and repeated rows are documents of their own; an empty
    table gives no rows; further columns are not read. A text of any length is tokenised whole.
    """
    return pack(stash(pieces(docs, vocabulary, text, key, sequence), "pieces"), key, sequence, **options)
