"""License statements against every stretch of words, wherever they stand."""

import random
import re

import zstandard

from fleetgauge.llm import licenses

NEAR = {f"CC-BY-{n}.0": f"Released under the CC-BY {n}.0 license." for n in range(1, 5)}
SOME = {n: t for i, (n, t) in enumerate(licenses.TEMPLATES.items()) if len(t.split()) < 50 and (i % 9 == 0 or n in licenses.PLAIN)}


def scan(text, templates=None, keep=0.8):
    known = licenses.prepared(licenses.TEMPLATES if templates is None else templates, keep)
    return licenses.scan(text.encode(), known, licenses.index(known), zstandard.ZstdCompressor(level=3, write_content_size=False))


def names(text, templates=None):
    return [x["license"] for x in scan(text, templates)[1]]


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row, old = [0], row
        for j, y in enumerate(b):
            row.append(old[j] + 1 if x == y else max(old[j + 1], row[j]))
    return row


def brute(text, templates, keep):
    raw, words = text.encode(), []
    cues = {raw.count(b"\n", 0, m.start()) for m in licenses.CUE.finditer(raw)}
    for i, line in enumerate(raw.split(b"\n")):
        words += [(w, i, i in cues) for w in licenses.WORD.findall(line.lower())]
    plain, all_ = zstandard.ZstdCompressor(level=3, write_content_size=False), []
    for t in licenses.prepared(templates, keep):
        n = len(t.words)
        for s in range(len(words)):
            block = [w for w, _, _ in words[s:s + 2 + 11 * n // 10]]
            held, later = common(t.words, block), common(t.words, block[1:])
            for j in range(1, len(block) + 1):
                numbers = [w for w in block[:j] if re.search(rb"\d", w)] == [w for w in t.words if re.search(rb"\d", w)]
                numbers = numbers and t.names.issubset(block[:j])
                if held[j] > held[j - 1] and held[j] > later[j - 1] and held[j] / n >= keep and numbers and any(c for _, _, c in words[s:s + j]):
                    differ = n + j - 2 * held[j]
                    all_.append((differ - held[j], differ, t, s, s + j, held[j] / n))
    at = [m.span() for m in licenses.WORD.finditer(raw)]

    def key(x):
        own = b" ".join(raw[at[x[3]][0]:at[x[4] - 1][1]].split())
        return *x[:2], len(x[2].press.compress(own)) / len(plain.compress(own)), x[2].name, x[3], x[4]

    out = []
    for x in sorted(all_, key=key):
        if all(x[4] <= y[3] or y[4] <= x[3] for y in out):
            out.append(x)
    return [(x[2].name, words[x[3]][1], x[5]) for x in sorted(out, key=lambda x: x[3])]


def texts(seed, breaks):
    r, given = random.Random(seed), list(SOME.values()) + list(NEAR.values())
    for _ in range(40):
        parts = []
        for _ in range(r.randint(1, 5)):
            words = r.choice(given).split()[:60]
            for _ in range(r.choice([0, 0, 0, 1, 2])):
                k = r.randrange(len(words))
                words[k:k + r.choice([0, 1])] = [r.choice(["the", "2.0", "software", "zz", "license"])]
            parts += words + [r.choice(["over", "the", "a", "work", "license", "3", "is"]) for _ in range(r.choice([0, 0, 3, 30]))]
        yield "".join(w + (r.choice(breaks) if r.random() < 0.15 else " ") for w in parts)


def test_statements_within_lines():
    assert names("Copyright (c) 2020 Jane Doe. Released under the MIT License.") == ["MIT"]
    assert names("word " * 300 + "Released under the MIT License.") == ["MIT"]
    assert names("Code: Released under the MIT License. Texts: Licensed under CC BY-NC 4.0. End.") == ["MIT", "CC-BY-NC-4.0"]
    assert names("Released under the MIT License. " * 500) == ["MIT"] * 500
    assert names("x. Released under the CC-BY 4.0 license.", NEAR) == ["CC-BY-4.0"]


def test_every_stretch():
    every = {**SOME, **NEAR}
    for text in texts(1, [" "]):
        assert [(x["license"], x["line"], x["share"]) for x in scan(text, every)[1]] == brute(text, every, 0.8)


def test_statements_wrapped_before_the_cue():
    assert names("# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0.") == ["MPL-2.0"]
    assert names("x\n/* This work is\n * licensed under the GNU General Public License, version 3. */") == ["GPL-3.0"]
    assert scan("# put into the public\n# domain")[0] == 1
    every = {**SOME, **NEAR}
    for text in texts(2, [" ", "\n", "\n# ", "\n\n"]):
        assert [(x["license"], x["line"], x["share"]) for x in scan(text, every)[1]] == brute(text, every, 0.8)


def test_customary_set():
    for name, text in licenses.TEMPLATES.items():
        assert licenses.CUE.search(text.encode()) and names(text) == [name]
    assert names("""    This library is free software; you can redistribute it and/or
    modify it under the terms of the GNU Lesser General Public
    License as published by the Free Software Foundation; either
    version 2.1 of the License, or (at your option) any later version.""") == ["LGPL-2.1-or-later-header"]
    assert names("// SPDX-License-Identifier: AGPL-3.0-or-later\nint x;") == ["AGPL-3.0-or-later-spdx"]
    assert names("released under the Foo license, licensed under the FOO License") == []
    two = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
  * Redistributions of source code must retain the above copyright notice, this
    list of conditions and the following disclaimer.
  * Redistributions in binary form must reproduce the above copyright notice, this
    list of conditions and the following disclaimer in the documentation and/or
    other materials provided with the distribution.
"""
    end = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES"
    three = """  * Neither the name of Foo nor the names of its contributors may be used to endorse
    or promote products derived from this software without specific prior written permission.
"""
    assert names(two + end) == ["BSD-2-Clause-text"] and names(two + three + end) == ["BSD-3-Clause-text"]


def test_templates_that_rank_alike():
    for n in range(1, 5):
        assert names(f"Released under the CC-BY {n}.0 license.", NEAR) == [f"CC-BY-{n}.0"]
