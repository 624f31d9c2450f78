"""Ids of pieces against a tokenizer of its own, special strings of the vocabulary included."""

import json
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from meander.llm import packing

VOCABULARY = packing.public_vocabulary()
TOKENIZER = Tokenizer.from_file(VOCABULARY)
ENCODE = packing.Encoder(VOCABULARY)
PIECES = ["<|endoftext|>", "<|", " x", "the ", "\n\n", "  ", "'ll", "Été", "12", "ß", "日本", "‼", "endoftext", "|>", "\t", "a" * 30, "don't"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=6)), max_size=12).map("".join).filter(lambda t: not any(0xD800 <= ord(c) < 0xE000 for c in t)))
def test_ids_are_those_of_the_file(text):
    assert np.frombuffer(ENCODE(text), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_special_strings_in_the_query(spark):
    texts = ["<|endoftext|> x", "plain words here", "a<|endoftext|>" * 900, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for r in packing.pack_documents(docs).collect():
        found.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
    for i, text in enumerate(texts):
        ids = np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert sorted(found[i]) == [(s, n, zlib.crc32(ids[s : s + n].tobytes())) for s, n, _ in sorted(found[i])] and sum(n for _, n, _ in found[i]) == len(ids)
    assert TOKENIZER.encode("<|endoftext|> x", add_special_tokens=False).ids == [50256, 2124]


@pytest.mark.parametrize("change", [{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"pre_tokenizer": {"type": "Whitespace"}}])
def test_other_files_go_to_their_own_tokenizer(tmp_path, change):
    with open(VOCABULARY, encoding="utf-8") as f:
        whole = json.load(f) | change
    path = tmp_path / "vocabulary.json"
    path.write_text(json.dumps(whole))
    encode = packing.Encoder(str(path))
    assert encode.fast is None
    text = "Hello  There's 12 x"
    assert np.frombuffer(encode(text), "<u4").tolist() == Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids
