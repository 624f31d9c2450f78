"""License scans against all rules tried on all texts, and what each rule needs."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from meander.llm import license_scan
from meander.llm.decontaminate import words_of

RULES = license_scan.rules()


def brute(text):
    """All rules at all places of the text, then each detection against all before it in order."""
    words = [w.decode() for w in words_of((text or "").encode())]
    joined, found = " " + " ".join(words) + " ", []
    places = [i for i, c in enumerate(joined) if c == " "]
    for i, rule in enumerate(RULES):
        expression = re.compile(" (?:" + rule.pattern + ")(?= )")
        for word, at in enumerate(places):
            if m := expression.match(joined, at):
                found.append((i, word, places.index(m.end())))
    kept = []
    for d in sorted(found, key=lambda d: (-RULES[d[0]].priority, d[1] - d[2], d[1], d[0])):
        rivals = [k for k in kept if RULES[k[0]].kind != "base"]
        if RULES[d[0]].kind == "base" or not any((k[1] <= d[1] and d[2] <= k[2]) or (d[1] <= k[1] and k[2] <= d[2]) for k in rivals):
            kept.append(d)
    base = [d for d in kept if RULES[d[0]].kind == "base"]
    labels = lambda of: ",".join(sorted({RULES[d[0]].label for d in of}))
    starts = [d[1] for d in base]
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), labels(base), labels(kept), max((RULES[d[0]].confidence for d in kept), default=0.0))


TEXTS = [
    None, "", "   ", "plain words about nothing", "Released under the MIT License.", "under the MIT license under the MIT license", "Licensed under the Apache License, Version 2.0. CC BY-NC 4.0, cc-by-nc",
    "This work is licensed under the GNU General Public License, version 3 or any later version", "SPDX-License-Identifier: GPL-2.0-or-later", "License: MIT\nall rights reserved", "mit under the MIT", "Der Hund geht mit dem Ball",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)", "see https://www.gnu.org/licenses/gpl-3.0.html or http://www.apache.org/licenses/LICENSE-2.0",
    "Neither the name of the Example Project nor the names of its contributors may be used to endorse or promote products", "Copyright (c) 2020 Some One. All rights reserved.", "creative commons attribution sharealike 4.0", "ünder the mit license é",
]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, d string, n_words string, __text string, k long, t string")


def test_texts_against_all_rules(spark):
    rows = [(i % 17 or None, t, "x", "y", "z", 1, "w") for i, t in enumerate(TEXTS * 2)]
    found = license_scan.report(table(spark, rows)).collect()
    assert sorted(map(repr, (tuple(r)[1:] for r in found))) == sorted(repr(brute(r[1])) for r in rows)
    assert sorted(r["doc_id"] or -1 for r in found) == sorted(r[0] or -1 for r in rows)


def test_table_against_all_rules(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    own = {r["doc_id"]: r["text"] for r in docs.collect() if len(r["text"] or "") < 20_000}
    for r in license_scan.report(docs).collect():
        if r["doc_id"] in own:
            assert tuple(r)[1:] == brute(own[r["doc_id"]])


def test_empty_table(spark):
    assert license_scan.report(table(spark, [])).collect() == []


def test_very_long_text(spark):
    text = "filler words " * 400_000 + "under the MIT license " * 20_000 + "SPDX-License-Identifier: ISC"
    row = license_scan.report(table(spark, [(1, text, "", "", "", 1, "")])).first()
    assert (row["n_base"], row["first_word"], row["last_word"], row["labels"], row["score"]) == (20_000, 800_000, 800_000 + 4 * 19_999, "isc,mit", 1.0)


def test_there_are_hundreds_of_rules_and_each_needs_a_word():
    assert len(RULES) > 500 and all(r.needs for r in RULES)
    assert license_scan.needed("creative commons attribution share ?alike 4 0(?: international)?") == {b"creative", b"commons", b"attribution", b"4", b"0"}
    assert license_scan.needed("the names? of (?:[^ ]+ ){1,3}deriv(?:ative)?s (?:a|b) end") == {b"the", b"of", b"end"}


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.data())
def test_every_match_has_the_words_that_its_rule_needs(data):
    rule = data.draw(st.sampled_from(RULES))
    text = data.draw(st.from_regex(re.compile(rule.pattern.replace("[^ ]", "[a-z]"), re.ASCII), fullmatch=True))
    words = [w.encode() for w in text.split(" ")]
    assert rule.needs <= set(words)
    here = license_scan.scanner(license_scan.BASE)
    assert any(here.rules[i] == rule and (a, b) == (0, len(words)) for i, a, b in here.found(words))


@pytest.mark.parametrize("gap", [0, 1])
def test_priority_beats_length(gap):
    here = license_scan.scanner(license_scan.BASE)
    words = words_of(b"licensed under the license mit" if gap else b"license mit")
    assert [here.rules[i].label for i, _, _ in here.resolved(here.found(words))] == ["mit"]
