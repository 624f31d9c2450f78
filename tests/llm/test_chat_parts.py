"""Typed parts: no control string in what is formatted, and the parts come back."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from meander.llm import chat

PIECES = ["<", "[", "\\", "|", "turn", "|>", "<|end|>", "</s>", "<s>", "[INST]", "<<SYS>>", "é", "\n", "s>", "INST]", "</", "s>[IN", "ST]", "<|image:0|>", "image:1|>"]
TEXT = st.lists(st.sampled_from(PIECES), max_size=5).map("".join)
PART = st.one_of(
    TEXT.map(lambda t: {"type": "text", "text": t}),
    st.sampled_from(["image", "audio", "document"]).map(lambda k: {"type": k, "ref": "r", "tokens": 3}),
)


def merged(parts):
    out = []
    for p in parts:
        if p["type"] == "text" and out and out[-1]["type"] == "text":
            out[-1] = {"type": "text", "text": out[-1]["text"] + p["text"]}
        elif p["type"] != "text" or p["text"]:
            out.append(dict(p))
    return [p for p in out if p["type"] != "text" or p["text"]]


@settings(max_examples=500, deadline=None)
@given(st.lists(PART, max_size=6))
def test_parts_come_back(parts):
    found = chat.PartVisitor().flatten(parts)
    body = found.text()
    rest = chat.PLACEHOLDER.sub("", body)
    assert len(chat.PLACEHOLDER.findall(body)) == sum(p["type"] != "text" for p in parts)
    runs = chat.PLACEHOLDER.split(body)[:: chat.PLACEHOLDER.groups + 1]
    assert "".join(runs) == rest and not any(x in run for run in runs for x in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))
    back = [p if p["type"] == "text" else {"type": p["type"], "ref": p["ref"], "tokens": p["tokens"]} for p in chat.parts_back(body, found.attachments)]
    assert back == merged(parts)
    # In its frame, a turn is still taken apart at its own marks.
    turn = chat.TURN + chat.escape("user") + chat.SAYS + body + chat.END + "\n"
    assert chat.TURN_TEXT.fullmatch(turn).groups() == ("user", body)


def test_strings_that_meet(spark):
    parts = [["<", "|end|>"], ["<", "\\|end|>"], ["</", "s>[IN", "ST]"]]
    rows = [(i, 0, "user", json.dumps([{"type": "text", "text": t} for t in p])) for i, p in enumerate(parts)]
    for r in chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), typed=True).collect():
        body = chat.TURN_TEXT.fullmatch(r["formatted"])[2]
        assert chat.unescape(body) == "".join(parts[r["conv_id"]])
        assert not any(x in body for x in ("<|", "</s>", "[INST]"))


BAD = [
    [{"type": "text", "text": 5}], [{"type": "video", "ref": "x"}], [{"type": None}], [{"text": "x"}], "[[[", [1], {"type": "text"}, "[" * 100_000,
    [{"type": ["text"], "text": "x"}], '[{"type": "text"',
]
ODD = [
    {"type": "image", "ref": "a", "tokens": None}, {"type": "audio", "ref": "a", "seconds": None}, {"type": "document", "ref": "a", "pages": "3"}, {"type": "image", "ref": {"k": 1}, "tokens": -4},
    {"type": "audio", "ref": "a", "seconds": 1e300}, {"type": "image", "tokens": True}, {"type": "audio", "seconds": float("nan")}, {"type": "image", "ref": "a", "tokens": 7.9},
]


def test_bad_parts_are_plain_texts(spark):
    texts = [b if isinstance(b, str) else json.dumps(b) for b in BAD]
    rows = [(i, 0, "assistant", t) for i, t in enumerate(texts)] + [(100 + i, 0, "user", json.dumps([p])) for i, p in enumerate(ODD)] + [(200, 0, "assistant", None), (201, None, None, "[]")]
    found = {r["conv_id"]: r for r in chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), typed=True).collect()}
    for i, t in enumerate(texts):
        r = found[i]
        assert chat.unescape(r["formatted"][r["loss_from"] : r["loss_to"]]) == t and not r["attachments"]
    assert [found[100 + i]["expanded_tokens"] for i in range(len(ODD))] == [256, 0, 512, 256, 0, 256, 0, 7]
    assert found[103]["attachments"][0]["ref"] == '{"k": 1}' and found[200]["loss_from"] == found[200]["loss_to"] and found[201]["formatted"] == "<|turn|><|says|><|end|>\n"
