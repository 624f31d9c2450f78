"""Bands that reject texts of which a part is noise, and leave others alone."""

import numpy as np

from meander.llm import quality_rules


def test_partly_noise_is_rejected(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("aeiourstln"), rng.integers(2, 7))) for _ in range(300)]
    good = [" ".join(rng.choice(vocabulary, 120)) for _ in range(200)]
    noise = ["".join(rng.choice(list("qxzjkvwy0189%^&"), 7)) for _ in range(6)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*good, good[0] + " " + " ".join(noise)])], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in quality_rules.report(docs).collect()}
    assert {i for i, r in found.items() if r["kept"]} == set(range(200))
    middle = np.median([r["log_ppl"] for r in found.values()])
    assert found[200]["log_ppl"] - middle < 0.25  # the least width of before kept it


def test_digits_hide_nothing_around_them():
    """Scripts without spaces and junk of hexadecimal digits keep their places; numbers, and identifiers where they are few, are one digit."""
    chinese = "这是一九四九年以后的历史" * 30 + "1949" + "年的事情" * 20
    hexadecimal = "".join(f"{i * 2654435761 % 2**32:08x}" for i in range(600))
    grams, count = quality_rules.n_grams([[chinese.encode()], [hexadecimal.encode()], [b"in", b"1949"], [b"in", b"7"]])
    assert count[0] == len(chinese.encode()) - 3 + 1 and count[1] > 2000 and len(set(grams[count[0] : count[0] + count[1]].tolist())) > 500
    assert grams[-2 * count[3] : -count[3]].tolist() == grams[-count[3] :].tolist()
    few = b"some plain words that go on for a while and on and on " * 4
    assert quality_rules.without_numbers(few + b"key-3f9a0c=x end") == few + b"0 end"
    assert quality_rules.without_numbers(b"key-3f9a0c=x end") == b"key-0f0a0c=x end"
