"""Texts of 2 MB that are hard on patterns: no scan may take the square of their length."""

import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from clearlines.llm import bpe, language, licenses, lines, packing, periods, quality, secrets

PATH = public_tokenizers.path("byte_bpe_50k.json")
UNITS = {"blanks": " ", "line breaks": "\n", "a letter": "a", "jwt": "eyJ", "dotted jwt": "eyJhbGciOiJ.", "license": "released under the mit license and ",
         "name": "mit license ", "link": "<link ", "assign": "token=", "open assign": "secret ", "key": "AKIA", "begin": "-----BEGIN PRIVATE KEY-----\n",
         "card": "card 4111 ", "signs": "<>!?", "bsd": "redistributions of source code must retain the above copyright notice this list of conditions "}


def scans():
    words = lambda t: b" " + b" ".join(t.encode().translate(licenses.WORD_BYTES).split()) + b" "
    dictionaries = {"en": b"the cat sat on the mat with a hat", "fr": b"le chat et la souris dans la maison"}
    return {"secrets": secrets.Scanner().spans, "licenses": lambda t: licenses.Signatures().detect(words(t)), "encoder": packing.Encoder(PATH).encode,
            "codec": bpe.Codec(PATH).encode, "lines": lines.text_facts, "periods": lambda t: list(periods.Gate().tiles(t.encode().split(), 4)),
            "language": language.Sizes(dictionaries).judge}


@pytest.mark.parametrize("name", sorted(UNITS))
def test_two_megabytes(name):
    text = (UNITS[name] * (2_000_000 // len(UNITS[name]) + 1))[:2_000_000]
    for scan, call in scans().items():
        call(text[:100])
        began = time.perf_counter()
        call(text)
        assert time.perf_counter() - began < 20, (scan, name)


@pytest.fixture(scope="module")
def reference():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return lambda text: found.encode(text, add_special_tokens=False).ids


def test_ids_of_blank_runs(reference):
    encode = packing.Encoder(PATH).encode
    assert encode(" " * 2_000_000) == reference(" " * 2_000_000)
    for run in (" " * 999, " " * 1000, " " * 1001, "\n" * 1500, " \n\t" * 700, " " * 1200, "\x85 " * 800, "\x1c" * 1100, "​" * 1100):
        for before in ("", "a", "a.", "<|endoftext|>"):
            for after in ("", "b", "'s", "1", "!", "<|endoftext|>", "\x1cb", run[:3] + "b"):
                assert encode(before + run + after) == reference(before + run + after), (before, run[:3], after)
    text = "x" + " " * 3000 + "y\n" + "\n" * 2000 + " z" + " " * 1000
    assert encode(text) == reference(text)


LICENSES = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that": "bsd",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products": "bsd-3-clause",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that": "isc",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "Licensed under GPLv3": "gpl-3.0", "Licensed under the GPLv2.": "gpl-2.0", "released under LGPLv2.1": "lgpl-2.1", "AGPLv3 license": "agpl-3.0",
    "Apache-2.0 license": "apache-2.0", "licensed under the Apache License, Version 2.0": "apache-2.0", "SPDX-License-Identifier: MPL-2.0": "mpl-2.0",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation, either version 3": "gpl-3.0",
    "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.": "zlib",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2.0",
}


def detected(text):
    return licenses.Signatures().detect(b" " + b" ".join(text.encode().translate(licenses.WORD_BYTES).split()) + b" ")


def test_license_texts():
    for text, label in LICENSES.items():
        assert label in {d[2] for d in detected(text)}, text
    assert len(detected("Apache-2.0 license")) == len(detected("SPDX-License-Identifier: MPL-2.0")) == 1
    for prose in ("They bought a commercial license for the shop.", "He has a driving license.", "free software for all", "under the bridge"):
        assert detected(prose) == [], prose


def test_every_signature_finds_itself():
    """Each plain signature is found in its own words, and its keyword is one of them."""
    for label, signatures in licenses.TEXTS.items():
        for words in signatures:
            if not set("(?{\\") & set(words):
                assert label in {d[2] for d in detected(words)}, words
    assert len(licenses.rules()) > 400 and all(key and key.isalnum() for rule in licenses.rules() if rule[1] == "text" for key in rule[4])


def test_short_lines_count(make):
    """A line of four letters in every document of a host goes, and a document of such lines is depleted."""
    rows = [(i, "Home\nLog in\n" + (f"own line number {'x' * i} of the document\n" if i else "")) for i in range(30)]
    found = {r.doc_id: r for r in lines.line_filter(make(rows)).collect()}
    assert all(len(r.removed_lines) == 2 for r in found.values()) and [k for k, r in found.items() if r.depleted] == [0]


def test_slices_leave_shared_headers_out(make):
    """A header in another language, shared by all, does not become the dictionary."""
    header = "en tete partage par tous les documents du corpus\n" * 60
    docs = make([(i, header + f"the cat number {i} sat on the mat {i * 7}\n" * 60, "en", "s") for i in range(20)])
    learned = language.learn(docs, quality.held_out("doc_id", 3, 1) | True)
    assert b"partage par tous" not in learned["en"]
    assert b"sat on the mat" in learned["en"]
