"""What the operators of this subpackage share: tables in the shared folder and texts in Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_folder, stash

__all__ = ["CHUNK_BYTES", "WordTable", "chunks", "new_folder", "read", "released", "stash", "texts_of", "unsigned_hex"]

#: Text bytes that one vectorised step works on; a longer text is a step of its own.
CHUNK_BYTES = 2_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def released(run: Callable) -> Callable:
    """For functions of mapInArrow: what a task held goes back to the system at its end, as Python workers live on."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
                ctypes.CDLL(None).malloc_trim(0)

    return whole


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    col = batch.column(batch.schema.get_field_index(column))
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def chunks(texts: list[bytes | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) in steps of about `limit` bytes; null is empty here."""
    first, size, part = 0, 0, []
    for i, text in enumerate(texts):
        if part and size + len(text or b"") > limit:
            yield first, part
            first, size, part = i, 0, []
        part.append(text or b"")
        size += len(text or b"")
    if part:
        yield first, part


class WordTable:
    """Values of words, computed once a word for many words at a time; emptied when it holds `limit` words.

    The limit bounds memory only: a word that is met again after that is computed again, to the same value.
    """

    def __init__(self, values: Callable[[list[bytes]], tuple[np.ndarray, ...]], columns: int, limit: int = 400_000):
        self.values, self.limit, self.columns = values, limit, columns
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.store = [np.zeros(1024, np.float64) for _ in range(self.columns)]

    def __call__(self, words: list[bytes]) -> list[np.ndarray]:
        """Each value column at each of the words."""
        if len(self.place) > self.limit:
            self.clear()
        place = self.place
        new = list(set(words).difference(place))
        if new:
            n = len(place)
            found = self.values(new)
            place.update(zip(new, range(n, n + len(new)), strict=True))
            for k, column in enumerate(found):
                if len(self.store[k]) < n + len(new):
                    self.store[k] = np.resize(self.store[k], 2 * (n + len(new)))
                self.store[k][n : n + len(new)] = column
        at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        return [column[at] for column in self.store]


def unsigned_hex(column: str):
    """16 lower-case hex digits of a BIGINT."""
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
