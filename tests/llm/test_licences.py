from __future__ import annotations

import random

import pytest

from looptrace.llm import licences


def unpruned(scanner, text):
    found = {}
    for line, words in scanner.units(text):
        unit = licences.bigrams(words)
        for name, template in scanner.known:
            score = licences.dice(unit, template)
            if score >= scanner.least and (line not in found or score > found[line][1]):
                found[line] = name, score
    return [(line, *found[line]) for line in sorted(found)]


def test_bounds_lose_nothing(spark, given):
    scanner = licences.Scanner()
    texts = [r.text for r in spark.read.parquet(f"{given}/documents.parquet").collect()]
    texts += [t[:k] + " x " + t[k:] for ts in licences.TEMPLATES.values() for t in ts
              for k in (0, len(t) // 2, len(t))]
    assert any(unpruned(scanner, t) for t in texts)
    for text in texts:
        assert scanner.scan(text) == unpruned(scanner, text)


@pytest.mark.parametrize("name", sorted(licences.TEMPLATES))
def test_every_template_is_found_in_a_text(name):
    for template in licences.TEMPLATES[name]:
        text = f"Some words.\nCopyright (c) 2020 Someone\n{template}\n\nOther words here."
        assert name in {n for _, n, _ in licences.Scanner().scan(text)}


def test_rows_of_any_kind(docs):
    mit = "Released under the MIT License."
    rows = docs((1, mit), (1, mit), (2, None), (3, ""), (4, "license " * 100_000), (None, mit.upper()),
                (5, "the lazy dog"), (6, f"A.\nLicensed under CC BY-NC 4.0.\n{mit}"))
    out = licences.licences(rows).collect()
    got = sorted(((r.doc_id, r.licence, r.n_notices, r.notices) for r in out), key=str)
    assert got == sorted([(1, "MIT", 1, "0:MIT")] * 2 + [(None, "MIT", 1, "0:MIT")] + [
        (i, None, 0, "") for i in (2, 3, 4, 5)] + [
        (6, "CC-BY-NC-4.0", 2, "1:CC-BY-NC-4.0,2:MIT")], key=str)
    assert licences.licences(docs()).collect() == []


@pytest.mark.parametrize("text, name", [
    ("This project is licensed under the MIT License.", "MIT"),
    ("This software is released under the MIT license, see below.", "MIT"),
    ("Distributed under the MIT License.", "MIT"),
    ("int main() { // Copyright 2020 Bob, released under the MIT License. */ return 0; }", "MIT"),
    ("<p>About us</p> " + " ".join(licences.TEMPLATES["MIT"][2].split()) + " <a>more</a> " * 200, "MIT"),
    (licences.TEMPLATES["BSD-2-Clause"][1].replace(" 1.", "\n\n1.").replace(" 2.", "\n\n2."),
     "BSD-2-Clause"),
    ("# " + licences.TEMPLATES["Apache-2.0"][2].replace("\n", "\n# ") + "\nimport os\nx = 1\n" * 50,
     "Apache-2.0"),
])
def test_notices_inside_longer_units(text, name):
    got = licences.Scanner().scan("Some words before.\n" + text + "\nand after")
    assert name in {n for _, n, _ in got}


def test_windows_against_all_windows():
    draw = random.Random(3)
    template = licences.bigrams("a b c d e f".split())
    for _ in range(400):
        words = draw.choices("abcdefx", k=draw.randrange(2, 30))
        best = max(
            licences.dice(licences.bigrams(words[i:j]), template)
            for i in range(len(words)) for j in range(i + 2, len(words) + 1)
        )
        found = licences.Words(words, list(range(len(words))), {}).windows(template, 0.5)
        assert max((w[0] for w in found), default=0) == (pytest.approx(best) if best >= 0.5 else 0)
        for score, _, first, last in found:
            assert score == pytest.approx(
                licences.dice(licences.bigrams(words[first : last + 2]), template))


GNU = """This program is free software; you can redistribute it and/or modify it under the terms of
the GNU {}General Public License as published by the Free Software Foundation; either version {} of
the License, or (at your option) any later version."""
CREATIVE = "This work is licensed under a Creative Commons Attribution{} {} License."


@pytest.mark.parametrize("text, name", [
    (GNU.format("", 2), "GPL-2.0"), (GNU.format("", 3), "GPL-3.0"),
    (GNU.format("Affero ", 3), "AGPL-3.0"), (GNU.format("Lesser ", 3), "LGPL-3.0"),
    (GNU.format("Lesser ", 2.1).replace("program", "library"), "LGPL-2.1"),
    (CREATIVE.format("-NoDerivatives", "4.0 International"), "CC-BY-ND-4.0"),
    (CREATIVE.format("-NonCommercial-NoDerivatives", "4.0 International"), "CC-BY-NC-ND-4.0"),
    (CREATIVE.format("-NonCommercial-ShareAlike", "4.0 International"), "CC-BY-NC-SA-4.0"),
    (CREATIVE.format("-ShareAlike", "3.0 Unported"), "CC-BY-SA-3.0"),
    ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"), ("released under GPLv2", "GPL-2.0"),
    ("under the terms of the GNU General Public License v3.0", "GPL-3.0"),
    ("We reprint a book released under the MIT Press", None),
    ("Licensed under CC BY-XY 9.0.", None),
])
def test_variants_and_versions_decide(text, name):
    found = licences.Scanner().scan(f"Some words here.\n{text} and after.\n")
    assert {n for _, n, _ in found} == ({name} if name else set())


@pytest.mark.parametrize("name", licences.FULL)
def test_full_texts_within_others(name):
    text = next(t for t in reversed(licences.TEMPLATES[name]) if len(t) > 1000)
    found = licences.Scanner().scan(f"First.\n\n{text.replace('. ', '. x ', 3)}\n\nLast.")
    assert max(found, key=lambda x: x[2])[1] == name
    bsd = f"{licences.TEMPLATES['BSD-2-Clause'][1]}\n{licences.BSD_THIRD}\n{licences.BSD_END}"
    assert [n for _, n, _ in licences.Scanner().scan(bsd)] == ["BSD-3-Clause"]


NOTICES = (
    "Licensed under GPL v3.", "Licensed under the MIT License.", "Licensed under CC BY-NC 4.0.",
    "Released under the BSD 2-Clause License.", "Licensed under the Apache License, Version 2.0.",
    "Licensed under the Mozilla Public License 2.0.", "Under LGPLv2.1.", "Licensed under CC0 1.0 License.",
    "SPDX-License-Identifier: AGPL-3.0-only", "This work is licensed under a Creative Commons"
    " Attribution-ShareAlike 3.0 Unported License.",
)


@pytest.mark.parametrize("notice", NOTICES)
def test_an_answer_does_not_hang_on_the_text_before(notice):
    scanner = licences.Scanner()
    alone = scanner.scan(notice)
    assert len(alone) == 1
    log = "\n".join(f"- v{i}.{i % 9}.{i % 5} fixes version {i}.0 of gpl{i}" for i in range(500))
    for before in (log, "version " + " v".join(map(str, range(70)))):
        got = scanner.scan(f"{before}\n{notice}\n{log}")
        line = before.count("\n") + 1
        assert [(n, name, score) for n, name, score in got if n == line] == [(line, *alone[0][1:])]


def test_templates_with_more_marks_than_a_word_has_bits():
    templates = {f"L{i}": [f"Licensed under the Own License, version {i}."] for i in range(90)}
    scanner = licences.Scanner(templates)
    assert len(scanner.bits) > 63
    for i in (0, 61, 62, 63, 64, 89):
        assert [x[1] for x in scanner.scan(templates[f"L{i}"][0])] == [f"L{i}"]
    assert scanner.scan("Licensed under the Own License, version 900.") == []
