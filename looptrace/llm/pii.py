"""Personal data in whole texts: patterns, and what a conditional random field adds to them.

Patterns find emails, addresses of hosts, card and phone numbers. Where a text has something like
them (long digit runs, an @ or a spelt-out dot), the tokens around it are labelled by a linear-chain
CRF over word shapes, which also knows spelt-out and oddly separated forms. Its spans are added
where they overlap no other and hold what their kind needs; no pattern's span is ever removed.

The labelled table is small: written lines with marked spans, and windows of a bounded sample of
documents labelled by the patterns. A null or empty text has no spans. Repeated rows are searched
each; overlapping finds of different patterns all stay; empty tables give no rows; columns named
like a result are replaced, others pass through. All scans are linear in the text.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from looptrace.llm import crf
from looptrace.llm.common import append, bounded_batches

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 2_000  # documents, about, whose windows join the labelled table
WINDOWS = 200  # of them that do, at most, and of at most LONGEST_WINDOW characters
LONGEST_WINDOW = 240
MARGIN = 48  # characters beside a find that the CRF sees
TOKENS_AT_ONCE = 100_000  # tokens that are labelled together; a longer window is alone
Span = tuple[str, int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*+\Z")
DIGITS = re.compile(r"[0-9]++(?:[ ().\-/\[\]]{1,3}[0-9]++)*+")
NUMBERED = re.compile(r"[0-9 +().\-/\[\]]{7,40}")  # what a number's span may hold
SPELT_OUT = re.compile(r"[A-Za-z0-9 ._%+@()\[\]{}<>-]{7,120}")
AT = ("at", "arroba", "arobase")
DOT = ("dot", "punto", "punkt", "point")
SPELT = re.compile(
    rf"[\[({{<] ?(?:{'|'.join(AT + DOT)}) ?[\])}}>]|\b(?:{'|'.join(AT[1:] + DOT)})\b|@", re.I
)

LABEL = r"[A-Za-z0-9_%+-]+"
SIGN = r"(?: ?[\[({{<] ?(?:{0}) ?[\])}}>] ?| (?:{0}) | ?{1} ?)"
DOTTED = rf"{LABEL}(?:{SIGN.format('|'.join(DOT), '[.]')}{LABEL})*"
WRITTEN = re.compile(rf"{DOTTED}{SIGN.format('|'.join(AT), '@')}{DOTTED}", re.I)


def emails(text: str) -> Iterator[Span]:
    """An @ with the run of local characters before it and a domain of two labels after it."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = start < at and DOMAIN.match(text, at + 1)
        if domain:
            yield "email", start, domain.end()
            free = domain.end()
        else:
            free = at + 1
        at = text.find("@", free)


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(int(d) for d in digits[::-2])) % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def small_parts(text: str) -> bool:
    parts = [p.lstrip("0") or "0" for p in text.split(".")]
    return all(len(p) <= 3 and int(p) <= 255 for p in parts)


def pattern_spans(text: str) -> list[Span]:
    """Leftmost finds that don't overlap within a kind, by kind and start; failing ones are dropped."""
    found = list(emails(text))
    found += [("ip", *m.span()) for m in IP.finditer(text) if small_parts(m[0])]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = only_digits(m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text)
                  if 9 <= len(only_digits(m[0])) <= 15]
    return found


def windows(text: str) -> list[tuple[int, int]]:
    """Parts of a text that the CRF looks at: around long digit runs, @ and spelt-out signs."""
    near = [
        m.span() for m in DIGITS.finditer(text)
        if m.end() - m.start() >= 7 and len(only_digits(m[0])) >= 4
    ]
    near += [m.span() for m in SPELT.finditer(text)]
    merged: list[list[int]] = []
    for start, end in sorted(near):
        start, end = max(0, start - MARGIN), min(len(text), end + MARGIN)
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end])
    return [(a, b) for a, b in merged]


def holds(kind: str, found: str) -> bool:
    """What a span of a kind must have, however it is written."""
    digits = only_digits(found)
    if not (SPELT_OUT if kind == "email" else NUMBERED).fullmatch(found) or not balanced(found):
        return False
    if kind == "email":
        lowered = found.lower()
        words = set(re.findall(r"[a-z]+|@|\.", lowered))
        return not words.isdisjoint(("@", *AT)) and not words.isdisjoint((".", *DOT))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", found)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A span without signs around it, but for brackets that close in it."""
    closing = text.rfind(")", start, end)
    while start < end and not text[start].isalnum() and text[start] != "+" and not (
        text[start] == "(" and start < closing
    ):
        start += 1
    while start < end and not text[end - 1].isalnum():
        end -= 1
    return start, end


def balanced(text: str) -> bool:
    return all(text.count(a) == text.count(b) for a, b in ("()", "[]", "{}", "<>"))


def added_spans(texts: list[str], base: list[list[Span]], model: crf.Model) -> list[list[Span]]:
    """The spans that the CRF adds to each text, decoded in one batch."""
    out: list[list[Span]] = [[] for _ in texts]
    waiting: list[tuple[int, int, list]] = []
    held = 0
    for i, text in enumerate(texts):
        for start, end in windows(text):
            toks = crf.tokens(text[start:end])
            if toks:
                waiting.append((i, start, toks))
                held += len(toks)
            if held > TOKENS_AT_ONCE:
                _add_decoded(texts, base, out, waiting, model)
                waiting, held = [], 0
    _add_decoded(texts, base, out, waiting, model)
    return out


def _add_decoded(
    texts: list[str],
    base: list[list[Span]],
    out: list[list[Span]],
    waiting: list[tuple[int, int, list]],
    model: crf.Model,
) -> None:
    """Adds the spans of windows, as (text, start, tokens), to those of their texts."""
    now, taken = -1, bytearray()
    rows = [[t[2] for t in toks] for _, _, toks in waiting]
    for (i, start, toks), labels in zip(waiting, model.decode(rows)):
        text = texts[i]
        if i != now:
            now, taken = i, bytearray(len(text))
            for _, a, b in base[i] + out[i]:
                taken[a:b] = b"\1" * (b - a)
        names = [model.labels[k] for k in labels]
        t = 0
        while t < len(names):
            if names[t][0] != "B":
                t += 1
                continue
            kind, first = names[t][2:], t
            t += 1
            while t < len(names) and names[t] == f"I-{kind}":
                t += 1
            a, b = trimmed(text, start + toks[first][0], start + toks[t - 1][1])
            if kind == "email" and holds(kind, text[a:b]):
                if m := WRITTEN.search(text, a, b):  # without words beside the address
                    a, b = m.span() if holds(kind, m[0]) else (a, b)
            if holds(kind, text[a:b]) and taken.find(1, a, b) < 0:
                out[i].append((kind, a, b))
                taken[a:b] = b"\1" * (b - a)


def joined(spans: list[Span]) -> str:
    ordered = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered)


# The written part of the labelled table: forms of each kind, text that is none, and lines to put
# either in. Digits are drawn anew for every copy, and so are all words but the cues.
FORMS = {
    "email": """
anna.meier at mail dot example dot com
meier at example dot com
ANNA AT EXAMPLE DOT ORG
anna dot meier at example dot com
j.doe (at) example (dot) org
j_doe(at)example(dot)org
j.doe(at)mail.example.net
bob_smith [at] host [dot] example [dot] net
bob[at]example[dot]org
bob-smith [at] example.com
lee @ example . com
kim@example [dot] com
kim @ mail.example.com
x99 <at> host <dot> com
bob <at> example.com
bob{at}example.com
bob ( at ) example.com
bob [ at ] example [ dot ] com
bob {at} example {dot} com
ana arroba ejemplo punto com
ana.ruiz arroba ejemplo punto com punto mx
ana (arroba) ejemplo (punto) com
anna at beispiel punkt com
anna punkt meier at beispiel punkt org
jean arobase exemple point net
jean point dupont arobase exemple point org
jean [arobase] exemple [point] com
jean arobase exemple.com
info@example.com
sales@mail.example.org
""".strip().split("\n"),
    "phone": """
+1 (555) 555-0101
+44 20 7946 0958
+49-30-1234567
(555) 555-0187
555-555-0199
1-555-555-0199
555.555.0142
555 555 0142
0049 30 1234567
00 49 171 1234567
020 7946 0999
0171/1234567
0171 - 1234567
030 1234567
""".strip().split("\n"),
    "ip": """
192.168.10.7
10 . 0 . 200 . 14
172[.]16[.]4[.]9
192.168.1[.]10
172.16.0(.)1
10(.)0(.)0(.)12
203.0.113.9
""".strip().split("\n"),
    "card": """
4111 1111 1111 1111
4012-8888-8888-1881
5500.0000.0000.0004
5500/0000/0000/0004
4111 - 1111 - 1111 - 1111
378282246310005
4111111111111111
""".strip().split("\n"),
}
NONE = """
she was at home and the dot on the map was red
look at the dot at the left of the page
a dot at the end
at this point they look at the next point of the list
the point is that she was at home
el punto es que la arroba pesa un cuarto
en este punto del camino y en otro punto
der punkt ist klein und punkt drei folgt
jusqu au point de depart et point final
a caixa tem uma arroba de peso
2024-05-17 at 10:45
17.05.2024 10:30:45
2023-05-12 to 2024-06-13
1,299.50 of 12,345 pieces
1,234,567.89
version 4.0 and build 10.2.33
v1.2.3.4.5 of 20230512
order no 483920175 has 3 items
page 12-15, 17-19, 21-23
ISBN 978-3-16-148410-0
id 123-45-6789
4be64439e3e49cf46b2d7c90f3602a3d
token = "908038b7daaf91e4"
between 1914 and 1918 about 20000000
1999, 2001 and 2010 there were 12345678
3.14159 26535 89793
48.2082, 16.3738
1920/1080 at 60
2560 x 1440 at 144
7302918455120934 units
CC BY-NC 4.0.
Version 2.0 of 2004-01-01
""".strip().split("\n")
CARRIERS = """
{}
the {} and
please write {} before noon
contact: {}.
mail {} for details, thanks
please write to {} before noon today
call {} now
tel {}
phone: {} in the office
host {} did not answer
card {} was charged.
Ouon ai ({}), le que
und die {} ist
""".strip().split("\n")
COPIES = 8


def redrawn(text: str, draw: random.Random, numbers_below_256: bool) -> str:
    """The same form with other digits, and other words but for the cues."""

    def number(m: re.Match) -> str:
        if numbers_below_256:
            return str(draw.randrange(256))
        return "".join(str(draw.randrange(10)) for _ in m[0])

    def word(m: re.Match) -> str:
        if m[0].lower() in crf.CUES:
            return m[0]
        new = "".join(draw.choice("abcdefghiklmnoprstuvw") for _ in range(draw.randrange(2, 11)))
        return new.upper() if m[0].isupper() else new

    return re.sub(r"[A-Za-z]+", word, re.sub(r"[0-9]+", number, text))


def written_rows(seed: int = 11) -> list[tuple[str, list[Span]]]:
    """The written forms, each several times in lines of all sorts."""
    draw, rows = random.Random(seed), []
    for kind, forms in [*FORMS.items(), ("", NONE)]:
        for form in forms:
            for _ in range(COPIES):
                found = redrawn(form, draw, kind == "ip") if kind else re.sub(
                    "[0-9]", lambda m: str(draw.randrange(10)), form)
                before, after = draw.choice(CARRIERS).split("{}")
                spans = [(kind, len(before), len(before) + len(found))] if kind else []
                rows.append((before + found + after, spans))
    return rows


def sampled_rows(docs: DataFrame) -> list[tuple[str, list[Span]]]:
    """Windows of a bounded sample of documents, labelled by the patterns."""
    rows = docs.count()
    if not rows:
        return []
    sample = docs.select("text").where("text IS NOT NULL")
    if rows > SAMPLE_DOCS:
        sample = sample.sample(fraction=SAMPLE_DOCS / rows, seed=5)

    def cut(batches):
        for batch in batches:
            made = []
            for text in batch.column(0).to_pylist():
                spans = pattern_spans(text)
                for a, b in windows(text):
                    inside = [(k, s - a, e - a) for k, s, e in spans if a <= s and e <= b]
                    made.append((text[a:b], ";".join(f"{k}:{s}:{e}" for k, s, e in inside)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([m[i] for m in made], pa.string()) for i in (0, 1)], names=["w", "s"]
            )

    bounded_batches(docs.sparkSession)
    found = (
        sample.mapInArrow(cut, "w string, s string")
        .where(F.length("w") <= LONGEST_WINDOW)
        .orderBy(F.xxhash64("w"), "w")
        .limit(WINDOWS)
        .collect()
    )
    out = []
    for r in found:
        spans = [x.split(":") for x in r.s.split(";") if x]
        out.append((r.w, [(k, int(a), int(b)) for k, a, b in spans]))
    return out


def train(rows: list[tuple[str, list[Span]]]) -> crf.Model:
    shapes, tags = [], []
    for text, spans in rows:
        toks = crf.tokens(text)
        row = ["O"] * len(toks)
        for kind, a, b in spans:
            inside = [i for i, (s, e, _) in enumerate(toks) if s < b and a < e and row[i] == "O"]
            for n, i in enumerate(inside):
                row[i] = f"{'I' if n else 'B'}-{kind}"
        if toks:
            shapes.append([t[2] for t in toks])
            tags.append(row)
    return crf.train(shapes, tags, list(KINDS))


FIELDS = (
    *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
    T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()),
    T.StructField("n_added", T.LongType()),
    T.StructField("redacted", T.StringType()),
)


def find(docs: DataFrame, model: crf.Model | None = None, redacted: bool = True) -> DataFrame:
    """`docs` with the number of pattern finds per kind, base_sha256 (of their spans), spans (all,
    as kind:start:end in code points), n_added and, if asked for, the text with every span
    replaced by its kind in angle brackets (null stays null)."""
    sent = docs.sparkSession.sparkContext.broadcast(
        model or train(written_rows() + sampled_rows(docs))
    )
    fields = FIELDS if redacted else FIELDS[:-1]

    def build(column: pa.Array) -> list[pa.Array]:
        given = column.to_pylist()
        texts = [t or "" for t in given]
        base = [pattern_spans(t) for t in texts]
        added = added_spans(texts, base, sent.value)
        out = [
            pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in KINDS
        ]
        out += [
            pa.array([hashlib.sha256(joined(s).encode()).hexdigest() for s in base], pa.string()),
            pa.array([joined(b + a) for b, a in zip(base, added)], pa.string()),
            pa.array([len(a) for a in added], pa.int64()),
        ]
        if redacted:
            out.append(pa.array(
                [None if t is None else redact(t, b + a) for t, b, a in zip(given, base, added)],
                pa.string(),
            ))
        return out

    return append(docs, fields, build)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind."""
    parts, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            parts += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join(parts) + text[done:] if spans else text
