"""WARC archives and their index.

Writing: one record a capture, payloads in UTF-8 after an HTTP head, each record a gzip member of its own. An archive file
takes at most RECORDS_A_FILE records and FILE_BYTES compressed bytes and one record. Of records with equal payloads the
one of the smallest id is a response, and all others are revisits of it without a payload. Spark's text writer puts the
members on whatever store the session uses: a row is a whole file, and as the last byte of a member is the highest byte of
its record's size, zero below 16 MB, that byte is the writer's line separator (a larger record gets an empty member
behind it).

Reading: files are read whole and member by member; a member's place in its file is kept, so a record can be sought to.
Digests are checked, and the captures of a file come out sorted by URL key, timestamp and id: one run a file, in blocks of
BLOCK_ROWS index rows.

Index: runs are merged by a loser tree, as runs on disk are. Boundaries of ranges are taken from the blocks' first keys, and
blocks are cut at them. The pieces of a range come to its task in order of their first rows, so the task reads a piece when
the merge reaches its first row, and holds the pieces that are open, one a run; Spark's shuffle spills what waits. Ranges
in order are the whole capture history in order, and a URL with very many captures is cut by time like any other rows.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import heapq
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, released, stash, texts_of

RECORDS_A_FILE, FILE_BYTES, BLOCK_ROWS, RANGE_ROWS = 5_000, 32_000_000, 500, 250_000
LEAST_BYTES = 0
SEPARATOR = "\r\n\r\n"
#: The date of a capture without one: this second plus its id.
EPOCH = 1_700_000_000


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def captures(pages: DataFrame, key: str, url: str, html: str, date: str | None) -> DataFrame:
    """id, url, payload and date (seconds) of every row. Null html and url are empty; a null id stays null."""
    seconds = F.col(date).cast("long") if date else F.lit(None).cast("long")
    return pages.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"), F.coalesce(seconds, EPOCH + F.pmod(F.col(key).cast("long"), F.lit(10**9)), F.lit(EPOCH)).alias("date"))


def digests(rows: DataFrame) -> DataFrame:
    """(id, payload_bytes, sha1): small rows, by which duplicates are found without moving payloads."""
    return rows.select("id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1(F.col("payload").cast("binary")).alias("sha1"))


def decide(rows: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(revisitor, first): ids whose payload an id below has, with that id. Rows of one id and payload are one capture."""
    found = stash(digests(rows).where(F.col("payload_bytes") >= least_bytes), "digests")
    first = found.groupBy("sha1").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("sha1", "first")
    first = stash(first, "repeated")  # both sides of the join are plain shuffles then, and a very common payload can be split
    return found.join(first, "sha1").where("id > first").select(F.col("id").alias("revisitor"), "sha1", "first").distinct()


def head(kind: str, date, url, extra: list, length) -> F.Column:
    stamp = F.date_format(F.timestamp_seconds(date), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    uri = F.regexp_replace(url, r"[\r\n]", " ")
    return F.concat(F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: "), stamp, F.lit("\r\nWARC-Target-URI: "), uri, *extra, F.lit("\r\nContent-Length: "), length.cast("string"), F.lit(SEPARATOR))


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", date: str | None = None, least_bytes: int = LEAST_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Write every row as a record under `path`.

    Repeated rows are repeated records; a null id has none in its record and is no revisit; line breaks in a URL become
    blanks, as heads have one line a field; an empty table writes no records; further columns are not read.
    """
    rows = captures(pages, key, url, html, date)
    again = stash(decide(rows, least_bytes), "revisits")
    hashed = rows.withColumn("sha1", F.sha1(F.col("payload").cast("binary")))
    joined = hashed.alias("r").join(again.alias("a"), (F.col("r.id") == F.col("a.revisitor")) & (F.col("r.sha1") == F.col("a.sha1")), "left").select("r.*", "a.first")
    payload_bytes = F.octet_length("payload")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), payload_bytes.cast("string"), F.lit(SEPARATOR))
    # The digest in the head is the bare base32 of the standard; Spark has hexadecimal only, so five bytes at a time are turned by a table of 32 letters.
    digest = base32(F.col("sha1"))
    common = [F.lit("\r\nWARC-Record-ID: <urn:capture:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">\r\nWARC-Payload-Digest: sha1:"), digest, F.lit("\r\nContent-Type: application/http; msgtype=response")]
    response = F.concat(head("response", F.col("date"), F.col("url"), common, F.octet_length(http) + payload_bytes), http, F.col("payload"))
    refers = [F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:capture:"), F.col("first").cast("string"), F.lit(">")]
    revisit = F.concat(head("revisit", F.col("date"), F.col("url"), common + refers, F.octet_length(http)), http)
    record = F.when(F.col("first").isNull(), response).otherwise(revisit)
    # A file is a row of its own: its last byte is the separator.
    joined.select(record.alias("record")).mapInArrow(packer(file_bytes, RECORDS_A_FILE), "value string").write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def member(raw: bytes) -> bytes:
    """A gzip member whose last byte is zero, or with an empty member behind it that has such a byte."""
    found = _gzip(raw)
    return found if found[-1] == 0 else found + _gzip(b"")


def _gzip(raw: bytes) -> bytes:
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(raw) + press.flush()


def packer(file_bytes: int, file_records: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Records to the contents of archive files, without their last byte."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def file() -> pa.RecordBatch:  # the writer takes a string's bytes as they are
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary()).view(pa.string())], ["value"])

        for batch in batches:
            for raw in texts_of(batch, "record"):
                held.append(member(raw + SEPARATOR.encode()))
                size += len(held[-1])
                if size >= file_bytes or len(held) >= file_records:
                    yield file()
                    held, size = [], 0
        if held:
            yield file()

    return run


#: The letters of base32 (RFC 4648).
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(sha1_hex: F.Column) -> F.Column:
    """Base32 of a 160-bit hexadecimal digest, without Python: 20 bits are 5 hexadecimal digits and 4 letters."""
    parts = []
    for i in range(8):
        bits = F.conv(F.substring(sha1_hex, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(LETTERS), F.shiftright(bits, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1)) for k in range(4)]
    return F.concat(*parts)


FIELD = re.compile(rb"([\w-]+): ?([^\r\n]*)\r\n")


#: Bytes that a decompressor is given at a time: what it does not use of them it copies, so the rest of a file would be too much.
WINDOW = 1 << 15


def members(raw: bytes) -> Iterator[tuple[bytes, int]]:
    """(contents, place) of each gzip member of a file that is not empty; one at a time."""
    whole, at = memoryview(raw), 0
    while at < len(whole):
        press, found, begun = zlib.decompressobj(31), [], at
        while not press.eof:
            part = whole[at : at + WINDOW]
            if not len(part):
                raise ValueError(f"a member that does not end, at {begun}")
            found.append(press.decompress(part))
            at += len(part) - len(press.unused_data)
        if contents := b"".join(found):
            yield contents, begun


def records(raw: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes, int]]:
    """(head, block, place) of each record of what archives hold, not compressed."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        fields = {k.lower(): v for k, v in FIELD.findall(raw[at : end + 2])}
        size = int(fields[b"content-length"])
        yield fields, raw[end + 4 : end + 4 + size], at
        at = end + 4 + size + 4


def record_at(raw: bytes, place: int) -> tuple[dict[bytes, bytes], bytes]:
    """(head, block) of the record whose member starts at `place` of an archive file."""
    fields, block, _ = next(records(next(members(memoryview(raw)[place:]))[0]))
    return fields, block


def url_key(url: str) -> str:
    """The host's labels from the last, then the path: captures of a site lie together. No scheme, no `www.`, no fragment."""
    _, there, rest = url.partition("://")
    host, path = re.match(r"([^/?#]*)([^#]*)", rest if there else url).groups()
    return ",".join(reversed(host.lower().removeprefix("www.").split("."))) + ")" + (path or "/")


#: url_key, date, id, type, digest, payload bytes, id referred to, url, file, place in the file
INDEX = "url_key string, date string, id long, record_type string, payload_digest string, payload_bytes long, refers_to long, url string, file string, place long"
NAMES = [x.split()[0] for x in INDEX.split(", ")]
KINDS = [pa.int64() if x.endswith("long") else pa.string() for x in INDEX.split(", ")]
KEY = ("url_key", "date", "id")
#: A block or piece of a run: its range, and the key of its first row with the run's name and the row's place in the run.
PIECE = "url_key string, date string, id long, run string, seq long, rows binary"


def key_of(row: tuple) -> tuple:
    """The order of index rows; a null id comes first."""
    return row[0], row[1], row[2] is not None, row[2] or 0


def to_bytes(rows: list[tuple]) -> bytes:
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)], NAMES)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_bytes(raw: bytes) -> list[tuple]:
    return list(zip(*(c.to_pylist() for c in pa.ipc.open_stream(raw).read_all().columns), strict=True))


def scan(spark: SparkSession, path: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """PIECE: the captures of all archives under `path` as runs, one a file, sorted by URL key, date, id and place, in blocks.

    A response whose payload has not the digest of its head raises an error. Of a file, its index rows are held.
    """

    def number(urn: bytes | None) -> int | None:
        found = re.fullmatch(rb"<urn:capture:(-?\d+)>", urn or b"")
        return int(found[1]) if found else None

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, raw = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                rows = []
                for fields, block, place in ((f, b, at) for whole, at in members(raw) for f, b, _ in records(whole)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind, digest = fields[b"warc-type"].decode(), fields[b"warc-payload-digest"].decode().removeprefix("sha1:")
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    if kind == "response" and (len(payload) != size or base32_digest(payload) != digest):
                        raise ValueError(f"damaged record in {name} at {place}")
                    url = fields[b"warc-target-uri"].decode("utf-8", "replace")
                    rows.append((url_key(url), fields[b"warc-date"].decode(), number(fields[b"warc-record-id"]), kind, digest, size, number(fields.get(b"warc-refers-to")), url, name, place))
                rows.sort(key=lambda r: (*key_of(r), r[9]))
                yield from pieces((rows[s : s + block_rows], name, s) for s in range(0, len(rows), block_rows))

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, PIECE)


def pieces(parts) -> Iterator[pa.RecordBatch]:
    """Batches of PIECE of (rows, run, place of the first row in the run), a few rows at a time."""
    names = [x.split()[0] for x in PIECE.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    for rows, run, seq in parts:
        values = [*rows[0][:3], run, seq, to_bytes(rows)]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)


class LoserTree:
    """Merges sorted runs: one comparison a level for each row, between the row that moves up and the loser it meets.

    Runs may be filled as the merge goes on: an empty run takes further rows by `feed`. Equal rows go by run.
    """

    def __init__(self, runs: list):
        self.rest = [iter(r) for r in runs] or [iter(())]
        self.size = len(self.rest)
        self.heads = [next(r, None) for r in self.rest]
        self._build()

    def _first(self, a: int, b: int) -> bool:
        """Whether run a's row goes before run b's; an empty run is last."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (a < b and not y < x)

    def _build(self) -> None:
        best, self.loser = [0] * self.size + list(range(self.size)), [0] * self.size
        for node in range(self.size - 1, 0, -1):
            a, b = best[2 * node], best[2 * node + 1]
            best[node], self.loser[node] = (a, b) if self._first(a, b) else (b, a)
        self.winner = best[1] if self.size > 1 else 0

    def feed(self, run: int, rows: list) -> None:
        self.rest[run] = iter(rows)
        self.heads[run] = next(self.rest[run], None)
        self._build()

    def head(self):
        """The least row, or None."""
        return self.heads[self.winner]

    def pop(self):
        """The least row; the next of its run moves up."""
        run = self.winner
        row = self.heads[run]
        self.heads[run] = next(self.rest[run], None)
        node = (run + self.size) >> 1
        while node:
            if self._first(self.loser[node], run):
                self.loser[node], run = run, self.loser[node]
            node >>= 1
        self.winner = run
        return row

    def __iter__(self) -> Iterator:
        while self.head() is not None:
            yield self.pop()


#: Runs that a tree is made for at first; it grows with the number of runs that are open at once.
OPEN = 8


def merged(arriving: Iterator[tuple[tuple, Callable[[], list]]]) -> Iterator[tuple]:
    """Rows of sorted pieces in one order. arriving: (order of the first row, with its run and place
    there, and its rows when asked), in that order.

    A piece is opened when the merge reaches its first row; by then the piece before it of the same run has ended.
    """
    tree, free = LoserTree([()] * OPEN), list(range(OPEN))
    waiting = next(arriving, None)
    while True:
        top = tree.head()
        while waiting is not None and (top is None or waiting[0] <= top[0]):
            (*_, run, seq), rows = waiting
            if not free:  # a larger tree takes the open runs over
                larger = LoserTree([()] * (2 * tree.size))
                larger.heads[: tree.size], larger.rest[: tree.size] = tree.heads, tree.rest
                free, tree = list(range(tree.size, larger.size)), larger
            tree.feed(heapq.heappop(free), [((*key_of(r), run, seq + i), r) for i, r in enumerate(rows())])
            waiting, top = next(arriving, None), tree.head()
        if top is None:
            return
        seat = tree.winner
        yield tree.pop()[1]
        if tree.heads[seat] is None:
            heapq.heappush(free, seat)


def boundaries(blocks: DataFrame, ranges: int) -> list[tuple]:
    """Keys at which ranges begin, but for the first: evenly spaced among the blocks' first keys. The driver holds a key a range."""
    if ranges < 2:
        return []
    step = max(1, blocks.count() // ranges)
    ordered = blocks.select(*KEY).repartitionByRange(min(ranges, 200), *KEY).sortWithinPartitions(*KEY)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    found = ordered.withColumn("place", place).where(F.col("place") % step == step - 1).select(*KEY).distinct().collect()
    return sorted({key_of(tuple(r)) for r in found})


def merge(blocks: DataFrame, range_rows: int = RANGE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All captures in one order by URL key, date and id: `range`, and `rank` among the captures of their range. blocks: PIECE, written."""
    starts = boundaries(blocks, -(-blocks.count() * block_rows // range_rows))
    at_start = [x.split()[0] for x in PIECE.split(", ")]

    @released
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = from_bytes(row["rows"])
                low, high = (bisect.bisect_right(starts, key_of(rows[i])) for i in (0, -1))
                place = [0, *(bisect.bisect_left(rows, s, key=key_of) for s in starts[low:high]), len(rows)]
                for k, (a, b) in enumerate(zip(place, place[1:], strict=False)):
                    if a < b:
                        for piece in pieces([(rows[a:b], row["run"], row["seq"] + a)]):
                            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array([low + k], pa.int32())], [*at_start, "range"])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def arriving():
            for batch in batches:
                for row in batch.to_pylist():
                    yield row["range"], ((*key_of((row["url_key"], row["date"], row["id"])), row["run"], row["seq"]), lambda raw=row["rows"]: from_bytes(raw))

        def given(rows: list[tuple], number: int, first: int) -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([number] * len(rows), pa.int32()), pa.array(range(first, first + len(rows)), pa.int64())], [*NAMES, "range", "rank"])

        for number, of_range in groupby(arriving(), key=lambda x: x[0]):
            held, first = [], 0
            for row in merged(x[1] for x in of_range):
                held.append(row)
                if len(held) == 5_000:
                    yield given(held, number, first)
                    held, first = [], first + len(held)
            if held:
                yield given(held, number, first)

    placed = blocks.mapInArrow(cut, PIECE + ", range int").repartitionByRange(len(starts) + 1, "range")
    return placed.sortWithinPartitions("range", *KEY, "run", "seq").mapInArrow(run, INDEX + ", range int, rank long")


def build_index(spark: SparkSession, path: str, range_rows: int = RANGE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    return merge(stash(scan(spark, path, block_rows), "runs"), range_rows, block_rows)


def report(pages: DataFrame) -> DataFrame:
    """Write the pages' archives, read them back and return the merged index as page rows."""
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write(pages, path)
    index = build_index(spark, path)
    return index.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", F.col("date").alias("capture_date"))


def oracle() -> str:
    """report() in SQL, for pages whose URLs have no line breaks."""
    digit = lambda i, k: f"substr('{LETTERS}', ((CAST('0x' || substr(h, {5 * i + 1}, 5) AS INTEGER) >> {15 - 5 * k}) & 31) + 1, 1)"
    digest = " || ".join(digit(i, k) for i in range(8) for k in range(4))
    return f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, octet_length(encode(coalesce(html, ''))) AS bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE url END AS rest FROM p),
k AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS host FROM f),
u AS (SELECT *, regexp_extract(substring(rest, length(host) + 1), '^[^#]*') AS path FROM k)
SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes, {digest} AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to,
  array_to_string(list_reverse(string_split(regexp_replace(lower(host), '^www[.]', ''), '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END AS url_key,
  strftime(make_timestamp(({EPOCH} + page_id % 1000000000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS capture_date
FROM u"""
