"""License scans: ordered signature rules behind a keyword prefilter.

A text becomes its words, joined by single spaces. Texts without a gate word go no further. In the others
an automaton finds the rules' keywords, and only rules whose keyword occurs are tried, in the order of their
priority. A detection that lies inside one of an earlier rule is suppressed.

Two kinds of rules: hand-written signatures of license texts (grants, conditions, disclaimers, file headers), and mentions
of a license by name, written out from a table of names and a list of forms, of which each pair is a rule.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import partial
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearlines.llm.common import WORD_BYTES, arrow_map, per_worker

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label -> how the license is written, in words (a pattern over words joined by spaces).
NAMES = {
    "0bsd": "0bsd|zero clause bsd", "afl-3.0": "academic free(?: license)?(?: ?v| version)? ?3 0",
    "agpl-3.0": "agpl(?: ?v| version)? ?3(?: 0)?|affero general public license(?: ?v| version)? ?3(?: 0)?",
    "apache-1.1": "apache(?: software)?(?: license)?(?: ?v| version)? ?1 1",
    "apache-2.0": "apache(?: software)?(?: license)?(?: ?v| version)? ?2(?: 0)?", "apache": "apache",
    "artistic-1.0": "artistic(?: license)?(?: ?v| version)? ?1(?: 0)?",
    "artistic-2.0": "artistic(?: license)?(?: ?v| version)? ?2(?: 0)?",
    "blueoak-1.0.0": "blue oak(?: model license)?(?: 1 0 0)?", "bsl-1.0": "boost(?: software)?(?: license)?(?: 1 0)?",
    "bsd-2-clause": "bsd 2 clause|2 clause bsd|simplified bsd", "bsd-3-clause": "bsd 3 clause|3 clause bsd|new bsd",
    "bsd-4-clause": "bsd 4 clause|4 clause bsd|original bsd", "bsd": "bsd",
    "cc-by-4.0": "cc by 4 0|creative commons attribution(?: 4 0)?(?: international)?",
    "cc-by-3.0": "cc by 3 0|creative commons attribution 3 0(?: unported)?",
    "cc-by-sa-4.0": "cc by sa 4 0|creative commons attribution share ?alike(?: 4 0)?(?: international)?",
    "cc-by-sa-3.0": "cc by sa 3 0|creative commons attribution share ?alike 3 0(?: unported)?",
    "cc-by-nc-4.0": "cc by nc 4 0|creative commons attribution non ?commercial(?: 4 0)?(?: international)?",
    "cc-by-nc-sa-4.0": "cc by nc sa 4 0|creative commons attribution non ?commercial share ?alike(?: 4 0)?",
    "cc-by-nc-nd-4.0": "cc by nc nd 4 0|creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: 4 0)?",
    "cc-by-nd-4.0": "cc by nd 4 0|creative commons attribution no ?deriv(?:ative)?s(?: 4 0)?",
    "cc0-1.0": "cc0(?: 1 0)?(?: universal)?|creative commons zero", "cddl-1.0": "cddl(?: ?v| version)? ?1(?: 0)?|cddl",
    "cecill-2.1": "cecill(?: ?v| version)? ?2(?: 1)?|cecill", "cpl-1.0": "common public license(?: ?v| version)?(?: 1 0)?",
    "ecl-2.0": "educational community(?: license)?(?: ?v| version)?(?: 2 0)?",
    "epl-1.0": "eclipse public license(?: ?v| version)? ?1(?: 0)?|epl ?1(?: 0)?",
    "epl-2.0": "eclipse public license(?: ?v| version)? ?2(?: 0)?|epl ?2(?: 0)?",
    "eupl-1.2": "eupl(?: ?v| version)?(?: 1 2)?|european union public license",
    "gfdl-1.3": "gnu free documentation(?: license)?(?: ?v| version)?(?: 1 3)?|gfdl",
    "gpl-2.0": "(?:gnu )?gpl(?: ?v| version)? ?2(?: 0)?|(?:gnu )?general public license(?: ?v| version)? ?2(?: 0)?",
    "gpl-3.0": "(?:gnu )?gpl(?: ?v| version)? ?3(?: 0)?|(?:gnu )?general public license(?: ?v| version)? ?3(?: 0)?",
    "gpl": "(?:gnu )?gpl|(?:gnu )?general public", "isc": "isc", "json": "json license",
    "lgpl-2.1": "(?:gnu )?lgpl(?: ?v| version)? ?2 1|lesser general public license(?: ?v| version)? ?2 1",
    "lgpl-3.0": "(?:gnu )?lgpl(?: ?v| version)? ?3(?: 0)?|lesser general public license(?: ?v| version)? ?3(?: 0)?",
    "lgpl": "(?:gnu )?lgpl|lesser general public|library general public", "lppl-1.3c": "lppl|latex project public",
    "mit": "mit|expat", "mit-0": "mit no attribution|mit 0", "mpl-1.1": "mozilla public license(?: ?v| version)? ?1 1",
    "mpl-2.0": "mozilla public license(?: ?v| version)? ?2(?: 0)?|mpl ?2(?: 0)?", "ms-pl": "microsoft public|ms pl",
    "ms-rl": "microsoft reciprocal|ms rl", "mulanpsl-2.0": "mulan psl(?: v2)?|mulan permissive(?: software)?",
    "ncsa": "ncsa|university of illinois ncsa", "odbl-1.0": "odbl|open data commons open database",
    "odc-by-1.0": "odc by|open data commons attribution", "ofl-1.1": "sil open font|ofl(?: 1 1)?",
    "openssl": "openssl", "osl-3.0": "open software license(?: ?v| version)?(?: 3 0)?", "php-3.01": "php license",
    "postgresql": "postgresql", "proprietary": "proprietary", "python-2.0": "python software foundation|psf",
    "ruby": "ruby license", "unicode": "unicode license", "unlicense": "unlicense", "upl-1.0": "universal permissive",
    "vim": "vim license", "w3c": "w3c software", "wtfpl": "wtfpl|do what the fuck you want to public",
    "x11": "x11", "zlib": "zlib(?: libpng)?", "zpl-2.1": "zope public",
}

#: Form -> (confidence, pattern around ``@``, the name). Earlier forms have priority.
FORMS = {
    "spdx": (1.0, "spdx license identifier @"),
    "grant": (0.95, "(?:released|licensed|distributed|available|provided|published|shared|offered) under "
                    "(?:the )?(?:terms of )?(?:the )?(?:conditions of )?(?:the )?@(?: licen[cs]e)?"),
    "subject": (0.9, "(?:subject to|governed by|covered by|in accordance with) (?:the )?(?:terms of )?(?:the )?@(?: licen[cs]e)?"),
    "field": (0.85, "licen[cs]e[ds]? (?:is |type |name )?@"),
    "title": (0.8, "@(?: licen[cs]e[ds]?)?"),  # only of names that hold the word license themselves
    "named": (0.7, "@ licen[cs]e[ds]?"),
}
#: Label -> signatures of the license's own words, in order: grants and headers, conditions, disclaimers.
TEXTS = {
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
            "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
            "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute"),
    "x11": ("except as contained in this notice the names? of the (?:\\w+ ){1,6}shall not be used in advertising",),
    "bsl-1.0": ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software",),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that",
            "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that"),
    "0bsd": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)",),
    "postgresql": ("permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement",),
    "bsd-4-clause": ("all advertising materials mentioning features or use of this software must display",),
    "bsd-3-clause": ("neither the names? of (?:\\w+ ){1,12}nor the names of (?:its|their|any) contributors may be used to endorse or promote products",),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that",
            "redistributions of source code must retain the above copyright notice this list of conditions",
            "redistributions in binary form must reproduce the above copyright notice this list of conditions"),
    "unlicense": ("this is free and unencumbered software released into the public domain",
                  "anyone is free to copy modify publish use compile sell or distribute this software"),
    "zlib": ("altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
             "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    "apache-2.0": ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
                   "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
                   "you must cause any modified files to carry prominent notices stating that you changed the files"),
    "apache-1.1": ("this product includes software developed by the apache software foundation",),
    "agpl-3.0": ("under the terms of the gnu affero general public license as published by the free software foundation",
                 "your modified version must prominently offer all users interacting with it remotely through a computer network"),
    "lgpl-2.1": ("under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1",),
    "lgpl-3.0": ("under the terms of the gnu lesser general public license as published by the free software foundation either version 3",),
    "gpl-2.0": ("under the terms of the gnu general public license as published by the free software foundation either version 2",
                "under the terms of the gnu general public license version 2 as published by the free software foundation",
                "activities other than copying distribution and modification are not covered by this license"),
    "gpl-3.0": ("under the terms of the gnu general public license as published by the free software foundation either version 3",
                "the gnu general public license is a free copyleft license for software and other kinds of works"),
    "gpl": ("this program is free software you can redistribute it and or modify it",),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0",
                "if a copy of the mpl was not distributed with this file you can obtain one"),
    "mpl-1.1": ("the contents of this file are subject to the mozilla public license version 1 1",),
    "epl-2.0": ("this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0",),
    "epl-1.0": ("this program and the accompanying materials are made available under the terms of the eclipse public license v1 0",
                "this program and the accompanying materials are made available under the terms of the eclipse public license v 1 0"),
    "cc0-1.0": ("the person who associated a work with this deed has dedicated the work to the public domain",
                "to the extent possible under law (?:\\w+ ){1,8}waived all copyright and related or neighboring rights"),
    "wtfpl": ("everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed",
              "you just do what the fuck you want to"),
    "ofl-1.1": ("this font software is licensed under the sil open font license",
                "the font software may be bundled redistributed and or sold with any software"),
    "artistic-2.0": ("everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed "
                     "preamble this license establishes the terms under which a given free software package",),
    "python-2.0": ("psf is making python available to licensee on an as is basis",),
    "openssl": ("this product includes software developed by the openssl project for use in the openssl toolkit",),
    "json": ("the software shall be used for good not evil",),
    "ncsa": ("permission is hereby granted free of charge (?:\\w+ ){0,60}redistributions of source code must retain the above copyright notice",),
    "public-domain": ("(?:released|placed|dedicated|put) (?:in|into|to) the public domain",),
    "proprietary": ("unauthorized (?:copying|reproduction|use|distribution) (?:\\w+ ){0,12}(?:strictly prohibited|prohibited)",
                    "proprietary and confidential", "confidential and proprietary"),
}
TEXT_CONFIDENCE = 0.98
GATES = (b"licen", b" under ", b"spdx", b"subject to", b"governed by", b"covered by", b"in accordance with")


def rules() -> list[tuple[str, str, float, re.Pattern, list[str]]]:
    """Label, form, confidence, pattern and keywords of every rule, in order of priority.

    Within a form, longer names come first, so that a version beats the family.
    """
    names = sorted(NAMES.items(), key=lambda n: -len(n[1]))
    made = []
    for label, signatures in TEXTS.items():
        for words in signatures:
            plain = re.sub(r"\(\?[^)]*\)(?:\{[^}]*\})?|\w+\?", " ", words).split()
            pattern = re.compile(f"(?<= ){words}(?= )".encode())
            made.append((label, "text", TEXT_CONFIDENCE, pattern, [max(plain, key=len) if plain else ""]))
    for form, (confidence, around) in FORMS.items():
        for label, name in names:
            if form == "title" and "license" not in name:
                continue
            words = [re.sub(r"\(\?:[^)]*\)\??", " ", part).split() for part in re.split(r"\|(?![^(]*\))", name)]
            keys = [next((w for w in sorted(part, key=len, reverse=True) if w.isalnum()), "") for part in words]
            pattern = re.compile(f"(?<= ){around.replace('@', f'(?:{name})')}(?= )".encode())
            made.append((label, form, confidence, pattern, keys))
    return made


class Signatures:
    """The rules and the automaton of their keywords."""

    def __init__(self):
        import ahocorasick

        self.rules = rules()
        self.gates = dict.fromkeys([*GATES, *(rule[4][0].encode() for rule in self.rules if rule[1] == "text")])
        by: dict[str, list[int]] = {}
        for i, rule in enumerate(self.rules):
            for word in rule[4]:
                by.setdefault(word, []).append(i)
        self.keywords = ahocorasick.Automaton()
        for word, numbers in by.items():
            self.keywords.add_word(word, numbers)
        self.keywords.make_automaton()

    def detect(self, words: bytes) -> list[tuple[int, int, str, str, float]]:
        """(start, end, label, form, confidence) in bytes of the words, joined and framed by single spaces."""
        if not any(gate in words for gate in self.gates):
            return []
        due = sorted({i for _, numbers in self.keywords.iter(words.decode("latin-1")) for i in numbers})
        kept: list[tuple[int, int, str, str, float]] = []
        starts: list[int] = []
        reach: list[int] = []  # the largest end of what starts up to there
        for i in due:
            label, form, confidence, pattern, _ = self.rules[i]
            more = []
            for match in pattern.finditer(words):
                start, end = match.span()
                before = bisect_right(starts, start)
                if not before or reach[before - 1] < end:
                    more.append((start, end, label, form, confidence))
            if more:  # matches of one rule never overlap
                kept = sorted(kept + more)
                starts = [k[0] for k in kept]
                reach = list(accumulate((k[1] for k in kept), max))
        return kept


def base_places(words: bytes) -> list[tuple[int, str]]:
    """(byte, label) of every place of every base phrase; places may overlap."""
    found = []
    for phrase, label in BASE.items():
        sought, at = b" " + phrase.encode() + b" ", words.find(b" " + phrase.encode() + b" ")
        while at >= 0:
            found.append((at + 1, label))
            at = words.find(sought, at + 1)
    return found


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``, over its whole text: ``key``; ``n_words``; ``base`` (word, label), by word; and
    ``detections`` (start, end: words, end exclusive; label, form, confidence), by start.

    NULL and empty texts have no words. Equal detections of one interval go to the rule with priority,
    ties there to the longer name. NULL and repeated keys and rows give a row each; no other column is read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator):
        import pyarrow as pa

        signatures = per_worker("signatures", Signatures)
        place = pa.struct([("word", pa.int64()), ("label", pa.string())])
        found = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()),
                           ("form", pa.string()), ("confidence", pa.float64())])
        for batch in batches:
            counts, bases, detections = [], [], []
            for t in batch.column(1).to_pylist():
                parts = (t or "").encode().translate(WORD_BYTES).split()
                words = b" " + b" ".join(parts) + b" "
                begins = list(accumulate((len(p) + 1 for p in parts), initial=1))
                number = partial(bisect_right, begins, lo=0)  # one more than the word that holds a byte
                counts.append(len(parts))
                bases.append(sorted(({"word": number(at) - 1, "label": label} for at, label in base_places(words)),
                                    key=lambda p: (p["word"], p["label"])))
                detections.append([{"start": number(a) - 1, "end": number(b), "label": label, "form": form,
                                    "confidence": c} for a, b, label, form, c in signatures.detect(words)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(bases, pa.list_(place)),
                                              pa.array(detections, pa.list_(found))], ["key", "n_words", "base", "detections"])

    columns = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = (f"key {kind}, n_words long, base array<struct<word:bigint,label:string>>, detections "
              "array<struct<start:bigint,end:bigint,label:string,form:string,confidence:double>>")
    return arrow_map(columns, run, schema).withColumnRenamed("key", key)
