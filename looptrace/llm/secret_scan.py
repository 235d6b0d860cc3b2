"""Secrets in whole texts: patterns, and strings whose tokens are too short to be language.

A byte-level vocabulary writes words in few long tokens and random strings in many short ones. So a
run of 16 or more characters of keys (letters, digits, `+ / _ -`, and up to two `=` behind it) that
takes a token for every 1.9 characters or fewer is added as a `random` span, unless it overlaps a
pattern's span or is known to be harmless: a digest (hexadecimal of a usual length, or named sha...
or md5), embedded data (behind `base64,`), a UUID, or a name (all of its parts are words, numbers, or
words with a number, but for odd parts below eight characters). No pattern's span is ever removed.

A null or empty text has no spans. Runs of any length are judged whole, in pieces of 256
characters, and every scan is linear in the text. Repeated rows are searched each; spans with the
same start are ordered by kind; an empty table gives no rows; columns named like a result are
replaced, others pass through.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from looptrace.llm.common import append

KINDS = ("assign", "access", "hex", "random")
SHORTEST = 16  # characters of a run that is judged
MAX_RATIO = 1.9  # characters per token of a random string, at most
ODD_PART = 8  # characters of the longest part that is neither word nor number, at least
PIECE = 256  # characters that are tokenized together
Span = tuple[str, int, int]

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)""",
    re.I | re.A,
)
NAMES = ("passw", "secret", "token", "apikey", "api_key")  # one of them is in any such find
ACCESS = re.compile(r"AKIA[A-Z0-9]++")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")
RUN = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{SHORTEST},}}+={{0,2}}+")

# Hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
DIGEST_NAME = re.compile(r"(?:sha-?(?:1|224|256|384|512)|md5)[-_:=/]", re.I)
NAMED_BEFORE = re.compile(r"(?:sha-?(?:1|224|256|384|512)|md5)[ :=(]{1,2}\Z|base64,\Z", re.I)
HEXADECIMAL = re.compile(r"[0-9a-f]+|[0-9A-F]+")
UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I)
PART = re.compile(r"[A-Za-z0-9]+")
PLAIN = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)[0-9]{0,8}|[0-9]+(?:[A-Z]?[a-z]+|[A-Z]+)?")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokens of a string by the vocabulary at `path`, read once per worker."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(t): int(n) for t, n in map(bytes.split, file)}
        _encoders[path] = tiktoken.Encoding(
            "secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
    return _encoders[path]


def base_spans(text: str) -> list[Span]:
    """Leftmost finds that don't overlap within a kind; failing ones are dropped."""
    found = []
    lowered = text.lower()
    if any(n in lowered for n in NAMES):
        found += [
            ("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6
        ]
    if "AKIA" in text:
        found += [
            ("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20
        ]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def harmless(text: str, start: int, end: int) -> bool:
    """Whether a run is a known digest, embedded data or an identifier."""
    run = text[start:end].rstrip("=")
    if HEXADECIMAL.fullmatch(run) and len(run) in DIGEST_LENGTHS:
        return True
    if DIGEST_NAME.match(run) or NAMED_BEFORE.search(text[max(0, start - 12) : start]):
        return True
    if UUID.fullmatch(run):
        return True
    odd = (m.end() - m.start() for m in PART.finditer(run) if not PLAIN.fullmatch(m[0]))
    return max(odd, default=0) < ODD_PART


def ratio(run: str, encode) -> float:
    """Characters per token."""
    return len(run) / sum(len(encode(run[i : i + PIECE])) for i in range(0, len(run), PIECE))


def added_spans(text: str, base: list[Span], encode, max_ratio: float) -> list[Span]:
    """Runs that the token-efficiency test exposes, beside the patterns' finds."""
    out, taken = [], bytearray(len(text) if base else 0)
    for _, a, b in base:
        taken[a:b] = b"\1" * (b - a)
    for m in RUN.finditer(text):
        a, b = m.span()
        if (
            taken.find(1, a, b) < 0
            and not harmless(text, a, b)
            and ratio(m[0], encode) <= max_ratio
        ):
            out.append(("random", a, b))
    return out


def joined(spans: list[Span]) -> str:
    ordered = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered)


FIELDS = (
    *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
    T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()),
    T.StructField("redacted", T.StringType()),
)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span, or run of spans that overlap, replaced by its first one's kind."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
        if a >= done:
            out += [text[done:a], f"<{kind}>"]
        done = max(done, b)
    return "".join(out) + text[done:]


def scan(
    docs: DataFrame,
    max_ratio: float = MAX_RATIO,
    path: str | None = None,
    redacted: bool = True,
) -> DataFrame:
    """`docs` with the number of finds per kind, base_sha256 (of the patterns' spans), spans (all, as
    kind:start:end in code points, by start and kind) and, if asked for, the text with every span
    replaced by its kind in angle brackets (null stays null)."""
    path = path or default_path()
    fields = FIELDS if redacted else FIELDS[:-1]

    def build(column: pa.Array) -> list[pa.Array]:
        encode, given = encoder(path), column.to_pylist()
        base = [base_spans(t) if t else [] for t in given]
        spans = [
            b + added_spans(t, b, encode, max_ratio) if t else [] for t, b in zip(given, base)
        ]
        out = [pa.array([sum(s[0] == k for s in row) for row in spans], pa.int64()) for k in KINDS]
        out.append(pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base]))
        out.append(pa.array([joined(s) for s in spans], pa.string()))
        if redacted:
            out.append(
                pa.array([t and masked(t, s) for t, s in zip(given, spans)], pa.string())
            )
        return out

    return append(docs, fields, build)
