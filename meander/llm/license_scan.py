"""License scans by ordered signature rules over normalised words.

A text is brought to its lower-case words with one space between, and rules are regular expressions over that. A rule needs
certain words; only where a text has all of them is the expression tried, so most texts cost their splitting alone. Rules have
a priority by their kind: a tag stands for more than a license's own wording, that for more than a notice, a name in a
sentence for less. Of detections of which one's place lies within another's, the one of higher priority stays, then the longer,
the earlier, and the rule that comes first; base phrases stay in any case.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, texts_of
from .decontaminate import words_of

#: Kinds of rules with their priority and the confidence of what they find.
KINDS = {"tag": (5, 1.0), "text": (4, 0.98), "notice": (3, 0.95), "link": (3, 0.9), "name": (2, 0.7), "loose": (1, 0.4)}
BASE_KIND = (6, 0.95)
#: Phrases that are found at all their places, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

VERSION = lambda major, minor="0": f"(?:version |v |ver )?(?:v{major}|{major})(?: {minor})?" if minor == "0" else f"(?:version |v |ver )?(?:v{major}|{major}) {minor}"
LATER = " (?:only )?(?:of the license )?(?:or (?:at your option )?(?:any )?(?:later|newer)|and later)"

#: label: (names as they stand in sentences, identifiers as they stand in tags); all in words, as expressions.
NAMED: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "mit": (("mit license", "mit x11 license", "mit style license", "expat license"), ("mit", "expat")),
    "mit-0": (("mit no attribution(?: license)?",), ("mit 0",)),
    "apache-2": ((f"apache (?:software |public )?license {VERSION(2)}", "asl 2 0", "al2 0"), ("apache 2 0", "apache 2", "apache2", "asl2")),
    "apache-1.1": (("apache (?:software )?license (?:version )?1 1",), ("apache 1 1",)),
    "apache-1": (("apache (?:software )?license (?:version )?1 0",), ("apache 1 0",)),
    "apache": (("apache (?:software |public )?license",), ("apache",)),
    "bsd-1-clause": (("(?:1|one) clause bsd(?: license)?", "bsd (?:1|one) clause(?: license)?"), ("bsd 1 clause",)),
    "bsd-2-clause": (("(?:2|two) clause bsd(?: license)?", "bsd (?:2|two) clause(?: license)?", "(?:simplified|freebsd) (?:bsd )?license"), ("bsd 2 clause", "bsd2")),
    "bsd-3-clause": (("(?:3|three) clause bsd(?: license)?", "bsd (?:3|three) clause(?: license)?", "(?:new|modified|revised) bsd license"), ("bsd 3 clause", "bsd3")),
    "bsd-4-clause": (("(?:4|four) clause bsd(?: license)?", "bsd (?:4|four) clause(?: license)?", "original bsd license"), ("bsd 4 clause",)),
    "0bsd": (("(?:0|zero) clause bsd(?: license)?", "bsd (?:0|zero) clause(?: license)?"), ("0bsd",)),
    "bsd": (("bsd (?:style )?licen[cs]e",), ("bsd",)),
    "isc": (("isc license", "internet (?:systems|software) consortium license"), ("isc",)),
    "zlib": (("zlib(?: libpng)? license",), ("zlib",)),
    "libpng": (("libpng license", "png reference library license"), ("libpng", "libpng 2 0")),
    "boost-1": (("boost software license(?: (?:version )?1 0)?", "bsl 1 0"), ("bsl 1 0", "boost 1 0")),
    "unlicense": (("unlicense license",), ("unlicense",)),
    "wtfpl": (("do what the fuck you want to public license", "wtfpl license"), ("wtfpl",)),
    "cc0-1": (("cc0 1 0(?: universal)?", "creative commons (?:zero|cc0)(?: 1 0| v1 0)?", "cc0 (?:public domain )?(?:dedication|license|waiver)"), ("cc0 1 0", "cc0")),
    "gpl-1": ((f"(?:gnu )?general public license {VERSION(1)}",), ("gpl 1 0 only", "gpl 1 0")),
    "gpl-1-or-later": ((f"(?:gnu )?general public license {VERSION(1)}{LATER}",), ("gpl 1 0 or later",)),
    "gpl-2": ((f"(?:gnu )?general public license {VERSION(2)}", "(?:gnu )?gpl v?2(?: 0)?", "(?:gnu )?gplv2", "gpl version 2"), ("gpl 2 0 only", "gpl 2 0", "gpl 2", "gpl2", "gplv2")),
    "gpl-2-or-later": ((f"(?:gnu )?general public license {VERSION(2)}{LATER}", f"(?:gnu )?gpl (?:version 2|v2|2)(?: 0)?{LATER}", f"(?:gnu )?gplv2{LATER}"), ("gpl 2 0 or later",)),
    "gpl-3": ((f"(?:gnu )?general public license {VERSION(3)}", "(?:gnu )?gpl v?3(?: 0)?", "(?:gnu )?gplv3", "gpl version 3"), ("gpl 3 0 only", "gpl 3 0", "gpl 3", "gpl3", "gplv3")),
    "gpl-3-or-later": ((f"(?:gnu )?general public license {VERSION(3)}{LATER}", f"(?:gnu )?gpl (?:version 3|v3|3)(?: 0)?{LATER}", f"(?:gnu )?gplv3{LATER}"), ("gpl 3 0 or later",)),
    "gpl": (("gnu general public license", "general public license", "gnu gpl", "gpl license"), ("gpl",)),
    "lgpl-2": ((f"(?:gnu )?(?:lesser|library) general public license {VERSION(2)}", "(?:gnu )?lgpl v?2(?: 0)?", "(?:gnu )?lgplv2"), ("lgpl 2 0 only", "lgpl 2 0")),
    "lgpl-2.1": ((f"(?:gnu )?(?:lesser|library) general public license {VERSION(2, 1)}", "(?:gnu )?lgpl (?:version )?v?2 1", "(?:gnu )?lgplv2 1"), ("lgpl 2 1 only", "lgpl 2 1")),
    "lgpl-2.1-or-later": ((f"(?:gnu )?(?:lesser|library) general public license {VERSION(2, 1)}{LATER}",), ("lgpl 2 1 or later",)),
    "lgpl-3": ((f"(?:gnu )?lesser general public license {VERSION(3)}", "(?:gnu )?lgpl (?:version )?v?3(?: 0)?", "(?:gnu )?lgplv3"), ("lgpl 3 0 only", "lgpl 3 0")),
    "lgpl-3-or-later": ((f"(?:gnu )?lesser general public license {VERSION(3)}{LATER}",), ("lgpl 3 0 or later",)),
    "lgpl": (("(?:gnu )?(?:lesser|library) general public license", "gnu lgpl", "lgpl license"), ("lgpl",)),
    "agpl-3": ((f"(?:gnu )?affero general public license {VERSION(3)}", "(?:gnu )?agpl (?:version )?v?3(?: 0)?", "(?:gnu )?agplv3"), ("agpl 3 0 only", "agpl 3 0")),
    "agpl-3-or-later": ((f"(?:gnu )?affero general public license {VERSION(3)}{LATER}",), ("agpl 3 0 or later",)),
    "agpl": (("(?:gnu )?affero general public license", "gnu agpl"), ("agpl",)),
    "gfdl-1.2": ((f"gnu free documentation license {VERSION(1, 2)}", "gfdl (?:version )?1 2"), ("gfdl 1 2", "gfdl 1 2 only", "gfdl 1 2 or later")),
    "gfdl-1.3": ((f"gnu free documentation license {VERSION(1, 3)}", "gfdl (?:version )?1 3"), ("gfdl 1 3", "gfdl 1 3 only", "gfdl 1 3 or later")),
    "gfdl": (("gnu free documentation license",), ("gfdl",)),
    "mpl-1.1": ((f"mozilla public license {VERSION(1, 1)}", "mpl 1 1"), ("mpl 1 1",)),
    "mpl-2": ((f"mozilla public license {VERSION(2)}", "mpl (?:version |v )?2 0"), ("mpl 2 0",)),
    "mpl": (("mozilla public license",), ("mpl",)),
    "epl-1": ((f"eclipse public license {VERSION(1)}",), ("epl 1 0",)),
    "epl-2": ((f"eclipse public license {VERSION(2)}",), ("epl 2 0",)),
    "epl": (("eclipse public license",), ("epl",)),
    "edl-1": ((f"eclipse distribution license {VERSION(1)}",), ("edl 1 0",)),
    "cpl-1": ((f"common public license {VERSION(1)}",), ("cpl 1 0",)),
    "ipl-1": (("ibm public license(?: (?:version )?1 0)?",), ("ipl 1 0",)),
    "cddl-1": ((f"common development and distribution license(?: cddl)? {VERSION(1)}",), ("cddl 1 0",)),
    "cddl-1.1": ((f"common development and distribution license(?: cddl)? {VERSION(1, 1)}",), ("cddl 1 1",)),
    "cddl": (("common development and distribution license",), ("cddl",)),
    "eupl-1.1": (("european union public licen[cs]e (?:version |v )?v?1 1",), ("eupl 1 1",)),
    "eupl-1.2": (("european union public licen[cs]e (?:version |v )?v?1 2",), ("eupl 1 2",)),
    "eupl": (("european union public licen[cs]e",), ("eupl",)),
    "ms-pl": (("microsoft public license",), ("ms pl",)),
    "ms-rl": (("microsoft reciprocal license",), ("ms rl",)),
    "artistic-1": ((f"artistic license {VERSION(1)}",), ("artistic 1 0",)),
    "artistic-2": ((f"artistic license {VERSION(2)}",), ("artistic 2 0",)),
    "artistic": (("artistic license", "same terms as perl itself"), ("artistic",)),
    "ofl-1.1": (("(?:sil )?open font license(?: (?:version )?1 1)?",), ("ofl 1 1",)),
    "psf-2": (("python software foundation license(?: (?:version )?2)?", "psf license(?: agreement)?"), ("psf 2 0", "python 2 0", "psf")),
    "postgresql": (("postgresql license",), ("postgresql",)),
    "openssl": (("openssl(?: ssleay)? license", "ssleay license"), ("openssl",)),
    "php-3": (("php license (?:version )?3 0",), ("php 3 0",)),
    "php-3.01": (("php license (?:version )?3 01",), ("php 3 01",)),
    "ruby": (("ruby license",), ("ruby",)),
    "vim": (("vim license",), ("vim",)),
    "w3c": (("w3c software (?:notice and )?(?:document )?license", "w3c license"), ("w3c",)),
    "x11": (("x11 license", "x consortium license"), ("x11",)),
    "ncsa": (("university of illinois ncsa open source license", "ncsa open source license"), ("ncsa",)),
    "afl-3": ((f"academic free license {VERSION(3)}",), ("afl 3 0",)),
    "osl-3": ((f"open software license {VERSION(3)}",), ("osl 3 0",)),
    "apsl-2": ((f"apple public source license {VERSION(2)}",), ("apsl 2 0",)),
    "ecl-2": ((f"educational community license {VERSION(2)}",), ("ecl 2 0",)),
    "cecill-2.1": (("cecill (?:free software )?license (?:agreement )?(?:version |v )?2 1",), ("cecill 2 1",)),
    "cecill": (("cecill (?:free software )?license",), ("cecill",)),
    "upl-1": (("universal permissive license(?: (?:version |v )?1 0)?",), ("upl 1 0",)),
    "zpl-2.1": ((f"zope public license {VERSION(2, 1)}",), ("zpl 2 1",)),
    "qpl-1": (("q public license(?: (?:version )?1 0)?",), ("qpl 1 0",)),
    "sspl-1": (("server side public license(?: (?:version |v )?1)?",), ("sspl 1 0",)),
    "busl-1.1": (("business source license(?: (?:version )?1 1)?",), ("busl 1 1",)),
    "elastic-2": ((f"elastic license {VERSION(2)}",), ("elastic 2 0",)),
    "commons-clause": (("commons clause license condition(?: v?1 0)?", "commons clause restriction"), ("commons clause",)),
    "json": (("json license",), ("json",)),
    "curl": (("curl license",), ("curl",)),
    "ijg": (("independent jpeg group s? ?license",), ("ijg",)),
    "unicode": (("unicode(?: inc)? license agreement", "unicode license v?3"), ("unicode dfs 2016", "unicode 3 0")),
    "bitstream-vera": (("bitstream vera(?: fonts)? license",), ("bitstream vera",)),
    "odbl-1": (("open (?:data commons open )?database license(?: odbl)?(?: v?1 0)?",), ("odbl 1 0",)),
    "odc-by-1": (("open data commons attribution license(?: v?1 0)?",), ("odc by 1 0",)),
    "pddl-1": (("(?:open data commons )?public domain dedication and license(?: v?1 0)?",), ("pddl 1 0",)),
    "ogl-uk-3": (("open government licen[cs]e (?:version |v )?v?3 0",), ("ogl uk 3 0",)),
    "bigscience-openrail-m": (("(?:bigscience |creativeml )?open rail m(?: license)?", "openrail m license"), ("openrail", "openrail m")),
    "blueoak-1": (("blue oak model license(?: 1 0 0)?",), ("blueoak 1 0 0",)),
    "mulan-psl-2": (("mulan permissive software license(?: (?:version |v )?v?2)?",), ("mulanpsl 2 0",)),
    "public-domain": (("public domain license",), ("public domain",)),
    "proprietary": (("proprietary (?:software )?license",), ("proprietary",)),
}
#: Parts of the names of the six families whose labels, names and identifiers follow one rule.
COMMONS = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nd": "attribution no ?deriv(?:ative)?s?", "by-nc": "attribution non ?commercial", "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s?"}
COMMONS_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

#: Wording of licenses themselves, and sentences that say more than a name.
TEXTS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("ofl-1.1", "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("boost-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "neither the names? of (?:[^ ]+ ){1,12}nor the names of (?:its|their|any) contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "terms and conditions for use reproduction and distribution 1 definitions license shall mean"),
    ("apache-1.1", "this product includes software developed by the apache software foundation"),
    ("gpl-2-or-later", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or"),
    ("gpl-3-or-later", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or"),
    ("gpl-2", "under the terms of the gnu general public license(?: version 2)? as published by the free software foundation(?: version 2)?"),
    ("lgpl-2.1-or-later", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or"),
    ("lgpl-3-or-later", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or"),
    ("agpl-3-or-later", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this (?:library|program)"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("epl-1", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "you just do what the fuck you want to"),
    ("cc0-1", "to the extent possible under law (?:[^ ]+ ){1,12}waived all copyright and related or neighboring rights"),
    ("public-domain", "(?:released|placed|dedicated|put) (?:in ?to |to |in )the public domain"),
    ("public-domain", "this (?:work|file|code|software|document|text) is (?:hereby )?in the public domain"),
    ("psf-2", "psf is making python available to licensee on an as is basis"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("json", "the software shall be used for good not evil"),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", "this product includes cryptographic software written by eric young"),
    ("ijg", "this software is based in part on the work of the independent jpeg group"),
    ("artistic", "you may distribute under the terms of either the gnu general public license or the artistic license"),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("eupl", "licensed under the eupl"),
    ("upl-1", "the above copyright notice and either this complete permission notice or at a minimum a reference to the upl must be included"),
    ("ncsa", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers"),
    ("commons-clause", "the license does not grant to you the right to sell the software"),
    ("busl-1.1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("elastic-2", "you may not provide the software to third parties as a hosted or managed service"),
    ("sspl-1", "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("proprietary", "this (?:software|program|document|source code) is (?:the )?(?:confidential and proprietary|proprietary and confidential)"),
    ("proprietary", "unauthori[sz]ed (?:copying|reproduction|distribution|use) of this (?:[^ ]+ ){1,4}is strictly prohibited"),
    ("all-rights-reserved", "copyright (?:[^ ]+ ){1,12}all rights reserved"),
    ("all-rights-reserved", "no part of this (?:publication|document|work|book|site) may be reproduced"),
)
#: Addresses, as their words are.
LINKS = (
    ("mit", "opensource org licenses mit(?: license)?(?: php)?"), ("mit", "mit license org"), ("apache-2", "(?:www )?apache org licenses license 2 0(?: txt| html)?"), ("apache-2", "opensource org licenses apache 2 0"), ("bsd-2-clause", "opensource org licenses bsd 2 clause"), ("bsd-3-clause", "opensource org licenses bsd 3 clause"),
    ("isc", "opensource org licenses isc"), ("zlib", "opensource org licenses zlib"), ("gpl-2", "gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?"), ("gpl-3", "gnu org licenses gpl 3 0(?: html| txt)?"), ("gpl", "gnu org licenses gpl(?: html| txt)?"), ("gpl", "gnu org copyleft gpl html"), ("lgpl-2.1", "gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt)?"),
    ("lgpl-3", "gnu org licenses lgpl 3 0(?: html| txt)?"), ("lgpl", "gnu org licenses lgpl(?: html| txt)?"), ("agpl-3", "gnu org licenses agpl(?: 3 0)?(?: html| txt)?"), ("gfdl", "gnu org licenses fdl(?: 1 3)?(?: html| txt)?"), ("mpl-2", "mozilla org mpl 2 0"), ("mpl", "mozilla org mpl"), ("epl-1", "eclipse org legal epl v10(?: html)?"), ("epl-2", "eclipse org legal epl (?:2 0|v20)(?: html)?"),
    ("boost-1", "boost org license 1 0 txt"), ("unlicense", "unlicense org"), ("wtfpl", "wtfpl net"), ("cc0-1", "creativecommons org publicdomain zero 1 0"), ("public-domain", "creativecommons org publicdomain mark 1 0"), ("ofl-1.1", "scripts sil org ofl"), ("odbl-1", "opendatacommons org licenses odbl"), ("odc-by-1", "opendatacommons org licenses by"), ("pddl-1", "opendatacommons org licenses pddl"),
    ("ogl-uk-3", "nationalarchives gov uk doc open government licence version 3"), ("json", "json org license html"), ("php-3.01", "php net license 3 01 txt"), ("w3c", "w3 org consortium legal"), ("artistic-2", "(?:perlfoundation|opensource) org (?:licenses )?artistic (?:license )?2 0"), ("cddl", "opensource org licenses cddl"),
)
#: What says that there is some license, and no more.
LOOSE = (
    ("license-mentioned", "see (?:the )?licen[cs]e (?:file )?for (?:more |full )?(?:details|information|terms)"), ("license-mentioned", "licensed under the (?:terms|conditions) of the"), ("license-mentioned", "use of this (?:source code|software|file|work) is governed by (?:an?|the) (?:[^ ]+ ){0,3}licen[cs]e"),
    ("creative-commons", "creative commons licen[cs]e"), ("creative-commons", "under (?:an?|the) creative commons"), ("open-source", "(?:released|available) as open source"), ("proprietary", "end user licen[cs]e agreement"), ("all-rights-reserved", "all rights reserved"),
)


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    pattern: str
    needs: frozenset[bytes]

    @property
    def priority(self) -> int:
        return BASE_KIND[0] if self.kind == "base" else KINDS[self.kind][0]

    @property
    def confidence(self) -> float:
        return BASE_KIND[1] if self.kind == "base" else KINDS[self.kind][1]


def needed(pattern: str) -> frozenset[bytes]:
    """Words that every match has: those of the pattern that stand outside groups and are joined to none."""

    def without(group: re.Match[str]) -> str:
        ways = group[1].removeprefix("?:").split("|")
        # A group that brings its own space leaves its neighbours as they are; any other is a part of the words beside it.
        return "" if all(w.endswith(" ") for w in ways) or all(w.startswith(" ") for w in ways) else "~"

    flat, before = pattern.replace(" ?", "~"), None
    while flat != before:  # from the innermost group
        before, flat = flat, re.sub(r"\(([^()]*)\)(?:[?*]|\{[^}]*\})?", without, flat)
    if "|" in flat:
        raise ValueError(f"alternatives outside a group: {pattern}")
    return frozenset(w.encode() for w in flat.split(" ") if re.fullmatch("[a-z0-9]+", w))


def rules(base: tuple[tuple[str, str], ...] = BASE) -> tuple[Rule, ...]:
    """All rules in order: base phrases, then tags, wording, notices, addresses, names, and loose ones."""
    named = dict(NAMED)
    for part, name in COMMONS.items():
        words = part.replace("-", " ")
        for version in COMMONS_VERSIONS:
            label = f"cc-{part}-{version.removesuffix(' 0').replace(' ', '.')}"
            named[label] = ((f"cc {words} {version}", f"creative commons {name} (?:version )?{version}(?: international| unported| generic)?", f"creative commons {name} {version.split()[0]} licen[cs]e"), (f"cc {words} {version}",))
        named[f"cc-{part}"] = ((f"cc {words}", f"creative commons {name}"), (f"cc {words}",))
    out = [("base", label, phrase) for phrase, label in base]
    for label, (_, ids) in named.items():
        for i in ids:
            out += [("tag", label, f"spdx license identifier {i}"), ("tag", label, f"licen[cs]e (?:is |type |name |id |expression )?{i}")]
    out += [("text", label, pattern) for label, pattern in TEXTS]
    for label, (names, _) in named.items():
        for name in names:
            out.append(("notice", label, f"(?:licen[cs]ed|released|distributed|available|provided|published|covered|shared|offered|redistribute it) under (?:the |a |an )?(?:terms (?:and conditions )?of )?(?:the )?{name}"))
    out += [("link", label, pattern) for label, pattern in LINKS]
    out += [("link", f"cc-{part}-{v.removesuffix(' 0').replace(' ', '.')}", f"creativecommons org licenses {part.replace('-', ' ')} {v}") for part in COMMONS for v in COMMONS_VERSIONS]
    out += [("name", label, name) for label, (names, _) in named.items() for name in names]
    out += [("loose", label, pattern) for label, pattern in LOOSE]
    return tuple(Rule(label, kind, pattern, needed(pattern)) for kind, label, pattern in out)


class Scanner:
    """Rules by the words that they need. Expressions are compiled when a text first has all the words of one."""

    def __init__(self, of: tuple[Rule, ...]):
        self.rules = of
        uses: dict[bytes, int] = {}
        for rule in of:
            if not rule.needs:
                raise ValueError(f"no word that every match has: {rule.pattern}")
            for w in rule.needs:
                uses[w] = uses.get(w, 0) + 1
        #: A rule is kept under the one of its words that the fewest rules need.
        self.by_word: dict[bytes, list[int]] = {}
        for i, rule in enumerate(of):
            self.by_word.setdefault(min(rule.needs, key=lambda w: (uses[w], w)), []).append(i)
        self.gate = frozenset(self.by_word)
        self.compiled: dict[int, re.Pattern[bytes]] = {}

    def found(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(rule, from, to) of all matches, in words; every place where a rule matches counts, whatever else does."""
        there = set(words)
        tried = sorted(i for w in self.gate & there for i in self.by_word[w] if self.rules[i].needs <= there)
        if not tried:
            return []
        text = b" " + b" ".join(words) + b" "
        spaces, out = None, []
        for i in tried:
            if i not in self.compiled:
                self.compiled[i] = re.compile(b" (?:" + self.rules[i].pattern.encode() + b")(?= )")
            search, at = self.compiled[i].search, 0
            while m := search(text, at):
                if spaces is None:
                    spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
                out.append((i, int(np.searchsorted(spaces, m.start())), int(np.searchsorted(spaces, m.end()))))
                at = m.start() + 1
        return out

    def resolved(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Without those that lie within, or around, one that comes before them in order of priority, length, place and rule."""
        of = self.rules
        kept = [d for d in found if of[d[0]].kind == "base"]
        starts: list[int] = []  # kept places hold none of each other, so their ends are in the order of their starts
        ends: list[int] = []
        for d in sorted((d for d in found if of[d[0]].kind != "base"), key=lambda d: (-of[d[0]].priority, d[1] - d[2], d[1], d[0])):
            at = bisect_right(starts, d[1])
            if at and ends[at - 1] >= d[2]:
                continue
            at = bisect_left(starts, d[1])
            if at < len(starts) and ends[at] <= d[2]:
                continue
            starts.insert(at, d[1])
            ends.insert(at, d[2])
            kept.append(d)
        return sorted(kept, key=lambda d: (d[1], d[2], d[0]))


@lru_cache(maxsize=4)
def scanner(base: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(rules(base))


FOUND = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("confidence", T.DoubleType())]))
ARROW_FOUND = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("confidence", pa.float64())]))


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, words: str = "n_words", found: str = "detections", base: tuple[tuple[str, str], ...] = BASE) -> DataFrame:
    """Columns `keep` of every row, its number of words, and its resolved detections: label, kind, [start, end) in words, confidence.

    A null or empty text has no words. Texts are scanned whole. Nothing is shuffled, and a task holds one text at a time.
    """
    keep = docs.columns if keep is None else keep

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = scanner(base)
        for batch in batches:
            numbers, rows = [], []
            for raw in texts_of(batch, "__text"):
                own = words_of(raw) if raw else []
                numbers.append(len(own))
                rows.append([{"label": r.label, "kind": r.kind, "start": a, "end": b, "confidence": r.confidence} for i, a, b in here.resolved(here.found(own)) for r in (here.rules[i],)])
            columns = [batch.column(batch.schema.get_field_index(n)) for n in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(numbers, pa.int64()), pa.array(rows, ARROW_FOUND)], [*keep, words, found])

    schema = T.StructType([*[docs.schema[n] for n in keep], T.StructField(words, T.LongType()), T.StructField(found, FOUND)])
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document, whatever further columns there are.

    A null text counts as empty: no words, no labels (empty strings), first_word and last_word null, score 0. Rows are
    scanned one by one, so repeated rows and null ids come as they are; an empty table gives an empty one. score is the
    confidence of the surest detection.
    """
    named = docs.select(F.col("doc_id").alias("k"), F.col("text").alias("t"))
    found = scan(named, "t", ["k"], "n_words", "d")
    base = F.filter("d", lambda x: x["kind"] == "base")
    labels = lambda d: F.array_join(F.array_sort(F.array_distinct(F.transform(d, lambda x: x["label"]))), ",")
    starts = F.transform(base, lambda x: x["start"])
    return found.select(
        F.col("k").alias("doc_id"), "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("d")).alias("labels"), F.coalesce(F.array_max(F.transform("d", lambda x: x["confidence"])), F.lit(0.0)).alias("score"),
    )
