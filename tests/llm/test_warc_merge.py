"""The external merge of the WARC index, members of archives, and their bounds."""

import gzip
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meander.llm import warc


def rows_of(keys, run):
    return [(u, d, i, "response", "D", 1, None, u, run, n) for n, (u, d, i) in enumerate(sorted(keys, key=lambda k: (k[0], k[1], k[2] is not None, k[2] or 0)))]


KEYS = st.lists(st.tuples(st.sampled_from("abé𝄞"), st.sampled_from("12"), st.one_of(st.none(), st.integers(-3, 3))), max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(KEYS, max_size=20), st.integers(1, 7))
def test_pieces_in_order_of_their_first_rows(runs, size):
    """All pieces of all runs, more of them than a tree has seats at first; a piece is opened when its turn comes."""
    named = [rows_of(keys, f"f{k:02}") for k, keys in enumerate(runs)]
    parts = [((*warc.key_of(rows[s]), f"f{k:02}", s), rows[s : s + size]) for k, rows in enumerate(named) for s in range(0, len(rows), size)]
    opened = []

    def asked(order, rows):
        return order, lambda: opened.append(order[-2]) or rows

    out = []
    for row in warc.merged(asked(*p) for p in sorted(parts, key=lambda p: p[0])):
        out.append(row)
        assert all(n * size <= sum(r[8] == run for r in out) + size for run, n in ((f"f{k:02}", opened.count(f"f{k:02}")) for k in range(len(runs))))
    assert out == sorted((r for rows in named for r in rows), key=lambda r: (*warc.key_of(r), r[8], r[9]))


@pytest.mark.parametrize("runs, range_rows, block_rows", [(40, 60, 7), (40, 100_000, 7), (3, 10, 1), (1, 5, 50)])
def test_merge_of_many_runs(spark, runs, range_rows, block_rows):
    rng = random.Random(runs + range_rows)
    some = [rows_of([(rng.choice("abcdé") * rng.randint(1, 3), str(rng.randint(0, 3)), rng.choice([None, *range(20)])) for _ in range(rng.randint(1, 60))], f"file{k}") for k in range(runs)]
    # A URL with very many captures, equal ones among them, is cut by time and id, or comes through one range in turn.
    some.append(rows_of([("c", "1", 5)] * 300, "hot"))
    parts = [(*rows[s][:3], rows[0][8], s, warc.to_bytes(rows[s : s + block_rows])) for rows in some for s in range(0, len(rows), block_rows)]
    blocks = spark.createDataFrame(parts, warc.PIECE).repartition(5)
    found = [tuple(r) for r in warc.merge(blocks, range_rows, block_rows).collect()]
    wanted = sorted((r for rows in some for r in rows), key=lambda r: (*warc.key_of(r), r[8], r[9]))
    assert [f[:10] for f in found] == wanted
    last, n = -1, 0
    for f in found:
        n = 0 if f[10] != last else n + 1
        assert f[10] >= last and f[11] == n
        last = f[10]
    assert (last > 0) == (range_rows < len(wanted))


def test_a_record_can_be_sought_to(spark, tmp_path):
    rng = random.Random(3)
    html = ["".join(rng.choice("abcdefgh <>é\r\n") for _ in range(n)) for n in [0, 10, 3000, 60_000] * 10]
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.com/{i}", x) for i, x in enumerate(html)], "page_id long, url string, html string").repartition(2)
    warc.write(pages, str(tmp_path / "w"), file_bytes=20_000)
    archives = {p.name: p.read_bytes() for p in (tmp_path / "w").glob("part-*")}
    assert len(archives) > 4 and all(len(gzip.decompress(raw)) > 0 for raw in archives.values())
    largest = max(len(warc.member(x.encode())) for x in html) + 1000
    assert all(len(raw) < 20_000 + largest for raw in archives.values())
    seen = 0
    for r in warc.build_index(spark, str(tmp_path / "w"), block_rows=3).collect():
        fields, block = warc.record_at(archives[r["file"].rpartition("/")[2]], r["place"])
        assert fields[b"warc-target-uri"].decode() == r["url"] and fields[b"warc-record-id"].decode() == f"<urn:capture:{r['id']}>"
        payload = block.partition(b"\r\n\r\n")[2]
        assert payload == (html[r["id"]].encode() if r["record_type"] == "response" else b"")
        seen += 1
    assert seen == len(html)


def test_last_byte_of_a_member():
    """The size's highest byte ends a member; where it is not zero an empty member follows."""
    for raw in (b"", b"x", b"y" * 300):
        found = warc.member(raw)
        assert found[-1] == 0 and gzip.decompress(found) == raw and len(list(warc.members(found * 3))) == (3 if raw else 0)
    large = bytes(1 << 24)
    found = warc.member(large)
    assert found[-1] == 0 and zlib.decompressobj(31).decompress(found) == large and [len(x) for x, _ in warc.members(found)] == [1 << 24]


def test_members_of_a_file_are_read_once(monkeypatch):
    """A decompressor copies what it does not use: given all of the rest each time, a file costs the square of its size."""
    rng = random.Random(5)
    texts = [rng.randbytes(n) for n in [0, 1, 500, 100_000, 70_000] * 40]
    raw, wanted = b"", []
    for text in texts:
        wanted += [(text, len(raw))] if text else []
        raw += warc.member(text)
    plain, given_bytes = zlib.decompressobj, []

    class Counted:
        def __init__(self, bits):
            self.press = plain(bits)

        def decompress(self, part):
            given_bytes.append(len(part))
            return self.press.decompress(part)

        eof, unused_data = property(lambda self: self.press.eof), property(lambda self: self.press.unused_data)

    monkeypatch.setattr(warc.zlib, "decompressobj", Counted)
    assert list(warc.members(raw)) == wanted
    assert sum(given_bytes) < 2 * len(raw) + (1 << 16) * len(texts)
    with pytest.raises(ValueError, match="does not end"):
        list(warc.members(raw[:-1]))
