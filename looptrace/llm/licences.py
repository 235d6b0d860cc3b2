"""Licence notices in whole texts, by the Dice coefficient of word bigrams with templates.

Texts and templates are lowered and cut into words. A notice may stand anywhere in a text's words,
within a line or over many: for each template every window of words is compared that can reach
LEAST, once in all words and once in those of the lines that don't just claim copyright. A template
is looked for only in texts that have enough of its bigrams, and no window grows beyond the sizes
that allow LEAST or past a repetition of its first bigram, which adds nothing. No bound loses a
match.

Of overlapping windows of one template that of the highest coefficient stays, then of those of
different templates that with the most bigrams in common. A window goes to the template of the
highest coefficient, of equals to the first by name. Each line has the best of the windows that
start on it, and a text's licence is that of the best, of equals the earliest; "All rights
reserved" yields to any other. A null or empty text has no licence. Repeated rows are scanned each;
empty tables give no rows; columns named like a result are replaced, others pass through.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from looptrace.llm.common import append

LEAST = 0.8
RESERVED = "Proprietary"  # stands beside the claims of other licences too

# Usual notices and the opening or whole text of short licences, by name.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to
        in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License
        for the specific language governing permissions and limitations under the License.""",
    ],
    "BSD-2-Clause": [
        "Released under the BSD 2-Clause License.",
        """Redistribution and use in source and binary forms, with or without modification, are
        permitted provided that the following conditions are met: 1. Redistributions of source code
        must retain the above copyright notice, this list of conditions and the following
        disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution.""",
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the"
        " LICENSE file.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0"
        " International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International"
        " License.",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        """This program is free software: you can redistribute it and/or modify it under the terms
        of the GNU General Public License as published by the Free Software Foundation, either
        version 3 of the License, or (at your option) any later version.""",
    ],
    "ISC": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or
        without fee is hereby granted, provided that the above copyright notice and this permission
        notice appear in all copies.""",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this
        software and associated documentation files (the "Software"), to deal in the Software
        without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons
        to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial
        portions of the Software.""",
    ],
    "MPL-2.0": [
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a
        copy of the MPL was not distributed with this file, You can obtain one at
        http://mozilla.org/MPL/2.0/.""",
    ],
    "Proprietary": [
        "All rights reserved.",
        "All rights reserved. No part of this work may be reproduced without permission.",
    ],
}

FAMILIES = {
    "GPL": ("GNU General Public License", ("1.0", "2.0", "3.0")),
    "LGPL": ("GNU Lesser General Public License", ("2.1", "3.0")),
    "AGPL": ("GNU Affero General Public License", ("1.0", "3.0")),
}
HEADER = """This {thing} is free software{sign} you can redistribute it and/or modify it under the
terms of the {title} as published by the Free Software Foundation{either} version {version} of the
License{later}"""
WARRANTY = """This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
See the {title} for more details."""
NAMED = {
    "Apache-1.0": ["Apache License, Version 1.0"],
    "Apache-1.1": ["Apache License, Version 1.1"],
    "Apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0", "Apache License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "BSD License"],
    "CC0-1.0": ["CC0 1.0 License", "Creative Commons CC0 1.0 Universal License"],
    "ISC": ["ISC License"],
    "MIT": ["MIT License"],
    "MPL-1.1": ["Mozilla Public License, Version 1.1", "Mozilla Public License 1.1"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"],
    "Unlicense": ["Unlicense"],
}
NOTICES = (
    "Licensed under the {}.", "Licensed under the terms of the {}.", "Licensed under {}.",
)
CC_PARTS = {"NC": "NonCommercial", "ND": "NoDerivatives", "SA": "ShareAlike"}
CC_VERSIONS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported",
               "4.0": "International"}
FULL = ("Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense")
REMOTE = """Remote Network Interaction; Notwithstanding any other provision of this License, if you
modify the Program, your modified version must prominently offer all users interacting with it
remotely through a computer network (if your version supports such interaction) an opportunity to
receive the Corresponding Source of your version by providing access to the Corresponding Source
from a network server at no charge, through some standard or customary means of facilitating
copying of software."""
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY
EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE."""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be
used to endorse or promote products derived from this software without specific prior written
permission."""


def _add_templates() -> None:
    """Notices by name, headers of the GNU licences, all Creative Commons variants, full texts."""
    def add(name: str, *texts: str) -> None:
        own = TEMPLATES.setdefault(name, [])
        own += [t for t in texts if t not in own]

    for name, titles in NAMED.items():
        add(name, *(n.format(t) for t in titles for n in NOTICES))
    for short, (title, versions) in FAMILIES.items():
        add(short, *(n.format(t) for t in (title, f"{short} License") for n in NOTICES))
        for version in versions:
            number = version.removesuffix(".0")
            add(f"{short}-{version}", f"This work is licensed under the {title}, version {number}.")
            for n in {number, version}:
                add(f"{short}-{version}", *(
                    NOTICES[0].format(f"{name}{sign}{n}")
                    for name in (title, short, f"GNU {short}") for sign in (" v", " version ", " ")),
                    NOTICES[1].format(f"{title} v{n}"), NOTICES[1].format(f"{title} version {n}"),
                    NOTICES[2].format(f"{short} {n}"), NOTICES[2].format(f"{short} v{n}"),
                    f"Under the {short}v{n}.", f"Under {short}v{n}.")
            for thing in ("program", "library"):
                for either, later in ((", either", ", or (at your option) any later version."),
                                      (";", "."), (",", " only.")):
                    head = HEADER.format(thing=thing, title=title, version=number, either=either,
                                         later=later, sign=":")
                    add(f"{short}-{version}", head,
                        f"{head} {WARRANTY.format(thing=thing, title=title)}")
    for chosen in ((), ("NC",), ("ND",), ("SA",), ("NC", "ND"), ("NC", "SA")):
        for version, kind in CC_VERSIONS.items():
            short = "-".join(("BY", *chosen))
            long = "-".join(("Attribution", *(CC_PARTS[c] for c in chosen)))
            texts = [f"Licensed under CC {short} {version}.",
                     f"This work is licensed under a Creative Commons {long} {version} {kind} License."]
            if "ND" in chosen and version < "4":
                texts.append(texts[1].replace("NoDerivatives", "NoDerivs"))
            add(f"CC-{short}-{version}", *texts)
    add("CC0-1.0", "Released under CC0 1.0.", "Dedicated to the public domain under CC0 1.0.",
        """To the extent possible under law, the author has waived all copyright and related or
        neighboring rights to this work.""")
    add("Unlicense", "Released into the public domain under the Unlicense.",
        "This is free and unencumbered software released into the public domain.")
    conditions = TEMPLATES["BSD-2-Clause"][1]
    add("BSD-2-Clause", f"{conditions} {BSD_END}")
    add("BSD-3-Clause", f"{conditions} {BSD_THIRD}", f"{conditions} {BSD_THIRD} {BSD_END}")
    folder = resources.files(__package__).joinpath("licence_texts")  # also in a zip
    for name in FULL:
        text = folder.joinpath(f"{name}.txt").read_text(encoding="utf-8")
        add(name, text.split("For more information, please refer to")[0])
    affero = re.sub(r"GNU\s+General\s+Public", "GNU Affero General Public", TEMPLATES["GPL-3.0"][-1],
                    flags=re.I)
    add("AGPL-3.0", affero.replace("  13. ", f"  13. {REMOTE} ", 1))
    for name in list(TEMPLATES):
        if name != RESERVED:
            known = [name] if "GPL-" not in name else [name, f"{name}-only", f"{name}-or-later"]
            add(name, *(f"SPDX-License-Identifier: {x}" for x in known))


_add_templates()

WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
CLAIM = re.compile(r"\s*(?:copyright\b|\(c\)|©)", re.I)
CLAIM_LINE = re.compile(r"^\s*(?:copyright\b|\(c\)|©)", re.I | re.M)
Bigrams = frozenset[tuple[str, str]]


def bigrams(words: list[str]) -> Bigrams:
    return frozenset(zip(words, words[1:]))


def normal_words(lines: list[str]) -> list[str]:
    """Words of lines, those left out that only claim copyright."""
    return [w for line in lines if not CLAIM.match(line) for w in WORD.findall(line.lower())]


# Words that tell licences apart whose notices are alike, and notices from mere mentions ("under"). A number counts after one of NUMBERED only.
VARIANTS = {"nc": "nc", "noncommercial": "nc", "nd": "nd", "noderivatives": "nd", "noderivs": "nd",
            "sa": "sa", "sharealike": "sa", "lesser": "lesser", "affero": "affero",
            "unlicense": "unlicense", "cc0": "cc0", "under": "under"}
PAIRED = {("non", "commercial"): "nc", ("share", "alike"): "sa", ("no", "derivatives"): "nd",
          ("no", "derivs"): "nd", ("no", "derivative"): "nd", ("general", "public"): "gnu",
          ("mozilla", "public"): "mozilla", ("creative", "commons"): "cc", ("cc", "by"): "cc"}
NUMBERED = {"version", "v", "license", "by", "attribution", "alike", "commercial", "derivatives",
            "derivs", "derivative", "gpl", "lgpl", "agpl", "cc0", "mpl", "apache", "bsd", *VARIANTS} - {"under"}
TITLED = {"mit", "isc", "bsd", "apache", "clause", "unlicense"}  # name a licence before "license"
VERSIONED = re.compile(r"([al]?gpl)?v?([0-9]+(?:\.[0-9]+)*)\Z")
LONG_TEXT = 300  # bigrams of a template that is a whole licence; its wording alone decides


def marks_of(pair: tuple[str, str]) -> set[str]:
    """What a bigram says about variant and version."""
    first, second = pair
    found = {VARIANTS[w] for w in pair if w in VARIANTS}
    if pair in PAIRED:
        found.add(PAIRED[pair])
    if second in ("license", "licence") and first in TITLED:
        found.add(first)
    for word in pair:
        got = VERSIONED.match(word)
        if got and (not word[0].isdigit() or (word is second and first in NUMBERED)):
            found.add(got[2].removesuffix(".0"))
            if got[1]:
                found.add(got[1])
    for word in pair:
        if word in ("gpl", "lgpl", "agpl"):
            found.add(word)
    return found


@lru_cache(maxsize=4096)
def marks(found: Bigrams) -> frozenset[str]:
    return frozenset(m for p in found for m in marks_of(p))


def dice(a: Bigrams, b: Bigrams) -> float:
    """The coefficient of a window and a template; 0 if they name different variants or versions."""
    score = 2 * len(a & b) / (len(a) + len(b))
    return 0.0 if score and len(b) <= LONG_TEXT and marks(a) != marks(b) else score


class Words:
    """A sequence of words as numbered bigrams: where each stands before and next, and which of
    the templates' marks (`bits`) each has; all marks of no template are one more bit."""

    def __init__(self, words: list[str], places: list[int], bits: dict[str, int]):
        self.words, self.places = words, places
        number: dict[tuple[str, str], int] = {}
        self.ids = np.array(
            [number.setdefault(p, len(number)) for p in zip(words, words[1:])], np.int64
        )
        self.pairs = list(number)
        n = len(self.ids)
        order = np.argsort(self.ids, kind="stable")
        same = self.ids[order][1:] == self.ids[order][:-1]
        self.before, self.next = np.full(n, -1), np.full(n, n)
        self.before[order[1:][same]] = order[:-1][same]
        self.next[order[:-1][same]] = order[1:][same]
        self.bits = bits
        own = [self.mask(marks_of(p)) for p in self.pairs]
        self.marked = np.array(own, np.int64 if len(bits) < 63 else object)[self.ids]

    def mask(self, found: Iterable[str]) -> int:
        """Marks as bits."""
        places = {self.bits.get(m, len(self.bits)) for m in found}
        return sum(1 << p for p in places)

    def windows(self, template: Bigrams, least: float) -> list[tuple[float, int, int, int]]:
        """(coefficient, bigrams in common, first, last bigram) of each start's best window.

        The best window starts and ends with bigrams of the template, and its first bigram doesn't
        stand in it again: without that it would be as good or better.
        """
        exact = len(template) <= LONG_TEXT
        mask = self.mask(marks(template)) if exact else 0
        size, most = len(template), len(template) * (2 - least) / least + 1e-9
        hits = np.array([p in template for p in self.pairs], bool)[self.ids]
        found = []
        # After another of the template's that doesn't stand in the window, a start is the worse one.
        starts = hits.copy()
        starts[1:] &= ~(hits[:-1] & (self.next[:-1] >= self.next[1:]))
        for s in np.flatnonzero(starts).tolist():
            stop, length = int(self.next[s]), int(2 * most) + 8
            while True:
                e = min(stop, s + length)
                new = self.before[s:e] < s
                distinct = np.cumsum(new)
                if e == stop or distinct[-1] > most:
                    break
                length *= 2
            on = hits[s:e]
            common = np.cumsum(new & on)
            fits = on & (distinct <= most)
            if exact:
                fits &= np.bitwise_or.accumulate(self.marked[s:e]) == mask
            scores = np.where(fits, 2 * common / (distinct + size), 0)
            at = int(scores.argmax())
            if scores[at] >= least:
                found.append((float(scores[at]), int(common[at]), s, s + at))
        return found


def apart(spans: list[tuple]) -> list[tuple]:
    """Of spans (..., first, last) in order of preference those that overlap none before them."""
    kept, starts, ends = [], [], []
    for span in spans:
        at = bisect(starts, span[-1])
        if not at or ends[at - 1] < span[-2]:
            kept.append(span)
            starts.insert(at, span[-2])
            ends.insert(at, span[-1])
    return kept


class Scanner:
    def __init__(self, templates: dict[str, list[str]] | None = None, least: float = LEAST):
        templates = TEMPLATES if templates is None else templates
        self.least = least
        self.known = sorted(
            (
                (name, found)
                for name, texts in templates.items()
                for found in {bigrams(normal_words([" ".join(t.split())])) for t in texts}
                if found
            ),
            key=lambda x: (x[0], sorted(x[1])),
        )
        self.enough = [len(b) * least / (2 - least) - 1e-9 for _, b in self.known]
        told = sorted({m for _, b in self.known if len(b) <= LONG_TEXT for m in marks(b)})
        self.bits = {m: i for i, m in enumerate(told)}
        self.having: dict[tuple[str, str], list[int]] = defaultdict(list)
        for k, (_, found) in enumerate(self.known):
            for pair in found:
                self.having[pair].append(k)

    def possible(self, words: list[str]) -> list[int]:
        """The templates of which a text has as many bigrams as a match shares."""
        shared = Counter(
            k for p in self.having.keys() & set(zip(words, words[1:])) for k in self.having[p]
        )
        return sorted(k for k, n in shared.items() if n >= self.enough[k])

    def best(self, unit: Bigrams) -> tuple[str, float] | None:
        """The template closest to a unit, if one is close enough."""
        low, high = self.least / (2 - self.least), (2 - self.least) / self.least
        found = None
        for name, template in self.known:
            if low * len(template) <= len(unit) + 1e-9 and len(unit) <= high * len(template) + 1e-9:
                score = dice(unit, template)
                if score >= self.least and (found is None or score > found[1]):
                    found = name, score
        return found

    def units(self, text: str) -> Iterator[tuple[int, list[str]]]:
        """(line number, words) of the windows that are close to some template, in order."""
        found = [WORD.findall(line.lower()) for line in text.split("\n")]
        claims = [bool(CLAIM.match(line)) for line in text.split("\n")]
        words = [w for line in found for w in line]
        line_of = [i for i, line in enumerate(found) for _ in line]
        sequences = [Words(words, list(range(len(words))), self.bits)]
        if any(claims):
            left = [k for k, i in enumerate(line_of) if not claims[i]]
            sequences.append(Words([words[k] for k in left], left, self.bits))
        chosen = []
        for k in sorted({k for q in sequences for k in self.possible(q.words)}):
            windows = [
                (score, common, q, first, last, q.places[first], q.places[last + 1])
                for q in sequences
                for score, common, first, last in q.windows(self.known[k][1], self.least)
            ]
            windows.sort(key=lambda w: (-w[0], w[5], w[6]))
            chosen += apart(windows)
        chosen.sort(key=lambda w: (-w[1], -w[0], w[5], w[6]))
        for _, _, q, first, last, place, _ in sorted(apart(chosen), key=lambda w: w[5]):
            yield line_of[place], q.words[first : last + 2]

    def scan(self, text: str) -> list[tuple[int, str, float]]:
        """(line, licence, coefficient) of a text's windows that match, each line's best."""
        if not self.possible(words := WORD.findall(text.lower())) and not (
            CLAIM_LINE.search(text) and len(words) > 1 and self.possible(normal_words(text.split("\n")))
        ):
            return []
        found: dict[int, tuple[str, float]] = {}
        for line, words in self.units(text):
            if got := self.best(bigrams(words)):
                if line not in found or got[1] > found[line][1]:
                    found[line] = got
        return [(line, *found[line]) for line in sorted(found)]


FIELDS = (
    T.StructField("licence", T.StringType()),
    T.StructField("dice", T.DoubleType()),
    T.StructField("line", T.LongType()),
    T.StructField("n_notices", T.LongType()),
    T.StructField("notices", T.StringType()),
)


def licences(docs: DataFrame, templates: dict[str, list[str]] | None = None,
             least: float = LEAST) -> DataFrame:
    """`docs` with licence, dice and line of the best notice (null without one), n_notices, and
    notices as line:licence in order, comma-joined."""
    scanner = Scanner(templates, least)

    def build(column: pa.Array) -> list[pa.Array]:
        rows = [scanner.scan(t) if t else [] for t in column.to_pylist()]
        tops = [max(r, key=lambda x: (x[1] != RESERVED, x[2], -x[0])) if r else (None,) * 3
                for r in rows]
        return [
            pa.array([t[1] for t in tops], pa.string()),
            pa.array([t[2] for t in tops], pa.float64()),
            pa.array([t[0] for t in tops], pa.int64()),
            pa.array([len(r) for r in rows], pa.int64()),
            pa.array([",".join(f"{n}:{name}" for n, name, _ in r) for r in rows], pa.string()),
        ]

    return append(docs, FIELDS, build)
