"""Chat formatting, URL filters, WARC and the pipeline against brute-force versions."""

import base64
import gzip
import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from meander.llm import chat, decontaminate, quality_rules, simhash, url_filter, warc
from meander.llm.common import stash

# ---- chat

PIECES = ["<", "[", "\\", "|", "turn", "|>", "<|end|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "é", "\n", "s>", "INST]", " "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_escape_is_reversible(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text
    assert not any(x in safe for x in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def brute_chat(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        chars = sum(len(chat.TURN + chat.escape(r[2] or "") + chat.SAYS + chat.escape(r[3] or "") + chat.END) + 1 for r in own)
        out[conv] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
    return out


def test_chat(spark):
    rows = [(1, 0, "user", "hi <|end|>"), (1, 1, "assistant", "[INST] 𝄞 é"), (1, 1, "assistant", "[INST] 𝄞 é"), (1, 2, None, None), (2, None, "assistant", ""), (2, 5, "a<|b", "x" * 200_000), (None, 1, "assistant", "y")]
    rows += [(9, i, ["user", "assistant"][i % 2], f"t{i}") for i in range(3000)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    found = {r["conv_id"]: tuple(r[c] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")) for r in chat.report(docs).collect()}
    assert found == brute_chat([*rows, (-7, 0, "user", chat.HOSTILE), (-7, 1, "assistant", chat.HOSTILE)])
    assert [r["conv_id"] for r in chat.report(docs.limit(0)).collect()] == [-7]


def test_typed_parts(spark):
    parts = [{"type": "text", "text": "see <|image:0|>"}, {"type": "image", "ref": "a.png"}, {"type": "audio", "ref": "b.wav", "seconds": 2.5}, {"type": "document", "ref": "c.pdf", "pages": 3}, {"type": "text", "text": None}, {"type": "image", "ref": None, "tokens": 9}]
    rows = [(1, 0, "user", json.dumps(parts)), (1, 1, "assistant", "[not json"), (1, 2, "user", "[1, 2]")]
    found = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), typed=True).orderBy("turn").collect()
    assert found[0]["formatted"] == "<|turn|>user<|says|>see <\\|image:0|><|image:0|><|audio:1|><|document:2|><|image:3|><|end|>\n"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in found[0]["attachments"]] == [("image", "a.png", 256), ("audio", "b.wav", 63), ("document", "c.pdf", 1536), ("image", None, 9)]
    assert found[0]["expanded_tokens"] == 256 + 63 + 1536 + 9 and found[0]["loss_from"] == found[0]["loss_to"]
    assert found[1]["formatted"][found[1]["loss_from"] : found[1]["loss_to"]] == "[not json" and not found[2]["attachments"]
    with pytest.raises(ValueError):
        chat.PartVisitor().flatten([{"type": "video"}])


# ---- URLs


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = max((r for r in url_filter.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])), key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


def brute_rank(edges, seeds, rounds=200, d=url_filter.DAMPING):
    base = {h: (1 - d) for h in seeds}
    now = dict(base)
    for _ in range(rounds):
        new = dict(base)
        for a, r in now.items():
            out = [y for x, y in edges if x == a]
            for y in out:
                new[y] = new.get(y, 0) + d * r / len(out)
        now = new
    return now


def test_url_filter(spark):
    link = lambda *hosts: "".join(f'<p><a class="x" href="https://{h}/p?q">l</a> <A HREF=\'//{h.upper()}\'>m</A>' for h in hosts)
    pages = [
        (0, "http://A.example.com/de/1?x", ""), (1, "http://bad.net/x", link("farm.example.com")), (2, "https://farm.example.com/1", link("bad.net", "bad.net")), (3, "https://farm.example.com/1", link("bad.net")),
        (4, "http://good.org/fr/1", link("friend.example.com", "farm.example.com")), (5, "https://friend.example.com#x/y", '<a href="/local">'), (6, None, None), (7, "nothing", link("bad.net")), (8, "http://x.example.net/en/3", ""),
        (9, "http://net", ""), (10, "http://ÄB.com/://x", link("good.org")), (11, "http://lonely.com/", None),
    ]
    table = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, host string")
    found = {r["page_id"]: r for r in url_filter.report(table).collect()}
    assert len(found) == len(pages)
    edges = {("bad.net", "farm.example.com"), ("farm.example.com", "bad.net"), ("good.org", "friend.example.com"), ("good.org", "farm.example.com"), ("Äb.com", "good.org")}
    trust = brute_rank(edges, ["good.org", "x.example.net"])
    distrust = brute_rank({(b, a) for a, b in edges}, ["bad.net"])
    for i, url, _ in pages:
        host, path, rule, verdict = brute_rule(url)
        bad = distrust.get(host, 0) > 0.5 * (trust.get(host, 0) + distrust.get(host, 0))
        r = found[i]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or ("block" if bad else "allow")), url
    assert found[10]["verdict"] == "block" and found[5]["verdict"] == "allow"
    assert url_filter.report(table.limit(0)).count() == 0


# ---- WARC


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30)), max_size=9))
def test_loser_tree(runs):
    assert list(warc.LoserTree([sorted(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_warc(spark):
    pages = [(5, "http://b.com/x#f", "same"), (2, "http://www.b.com/x", "same"), (9, "http://a.com", ""), (4, "http://a.com/\r\nX: y", None), (7, None, "é\r\n\r\nWARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (8, "http://a.org/", "z" * 300_000), (2, "http://www.b.com/x", "same"), (None, "http://n.com", "same")]
    table = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, payload string").repartition(3)
    found = warc.report(table).collect()
    assert len(found) == len(pages)
    first = {}
    for i, _, html in pages:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    expected = []
    for i, _, html in pages:
        again = i is not None and first[html or ""] != i
        expected.append((i, len((html or "").encode()), digest(html or ""), "revisit" if again else "response", first[html or ""] if again else None))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    keys = [(r["url_key"], r["capture_date"]) for r in found]
    assert keys == sorted(keys)  # one global order
    assert warc.report(table.limit(0)).count() == 0


def test_warc_files_and_ranges(spark, tmp_path):
    pages = spark.range(500).selectExpr("id AS page_id", "concat('http://h', id % 7, '.com/', id % 3) AS url", "repeat(cast(id % 50 AS string), 9) AS html").repartition(5)
    warc.write(pages, str(tmp_path / "w"))
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("part-*"))
    assert raw.count(b"WARC/1.1\r\n") == 500 and len(list(warc.records(raw))) == 500
    index = warc.build_index(spark, str(tmp_path / "w"), range_rows=100, block_rows=20)
    assert index.rdd.getNumPartitions() > 2 if hasattr(index, "rdd") else True
    rows = index.collect()
    keys = [(r["url_key"], r["date"], r["id"]) for r in rows]
    assert len(rows) == 500 and keys == sorted(keys)
    assert sum(r["record_type"] == "response" for r in rows) == 50
    broken = next(p for p in (tmp_path / "w").glob("part-*") if b"WARC-Type: response" in gzip.decompress(p.read_bytes()))
    broken.write_bytes(gzip.compress(gzip.decompress(broken.read_bytes()).replace(b"Payload-Digest: sha1:", b"Payload-Digest: sha1:A")))
    for check in (tmp_path / "w").glob(".*.crc"):
        check.unlink()
    with pytest.raises(Exception, match="damaged"):
        warc.scan(spark, str(tmp_path / "w")).collect()


# ---- pipeline


def test_pipeline(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("aeiourstln"), rng.integers(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    passage = " ".join(f"test{i}" for i in range(14))
    base = say(300)
    texts = [say(150) for _ in range(80)] + [base, base.upper(), base + " x", say(100) + " " + passage + " " + say(100), say(80) + f' token = "{hashlib.sha1(b"q").hexdigest()}" ' + say(80), "too short", None, "", passage]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        now = stash(stage(spark, now, str(tmp_path)), name)
        seen[name] = now
        if name != "best_fit_packing":
            assert now.columns == docs.columns
    ids = {name: {r["doc_id"] for r in df.select("doc_id").collect()} for name, df in seen.items()}
    expected = {r["doc_id"] for r in quality_rules.report(docs).where("kept").collect()}
    assert ids["quality_rules"] == expected and set(range(80)) <= expected and not expected & {85, 86, 87, 88}
    assert 81 not in ids["near_duplicates"] and 80 in ids["near_duplicates"]
    assert ids["near_duplicates"] == {r["component_id"] for r in simhash.components(seen["quality_rules"]).collect()}
    assert decontaminate.report(seen["benchmark_passages"], spark.read.parquet(str(tmp_path / "benchmark.parquet"))).where("contaminated").isEmpty()
    assert ids["benchmark_passages"] == ids["near_duplicates"] == ids["secrets"] == ids["best_fit_packing"]
    masked = seen["secrets"].where("doc_id = 84").first()
    assert "<SECRET>" in masked["text"] and masked["n_chars"] == len(masked["text"])
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert again.columns == seen["best_fit_packing"].columns and again.count() == seen["best_fit_packing"].count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "benchmark_passages", "secrets", "best_fit_packing"]
