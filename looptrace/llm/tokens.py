"""Token ids of whole texts in a worker, by the public byte-level BPE vocabulary in a .json file.

Texts are cut at single spaces. A piece that starts with no white space, with the space before it,
has the same ids wherever it stands, so pieces are looked up in a cache first. A text in which some
piece is empty or starts with white space, or that has a special string of the vocabulary, is
encoded as a whole by the tokenizers library.
"""

from __future__ import annotations

import json
from array import array

SAFE = "ɐ"  # below it, the libraries' Unicode tables agree on letters and numbers
CACHED = 400_000  # pieces that a worker keeps; beyond, it starts anew


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.piece_ids = self._ranked(spec)

    def _ranked(self, spec):
        """A faster encoder of the same vocabulary, if ids follow the merges; else None."""
        cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
        vocab, merges = model["vocab"], model["merges"]
        if (
            model["type"] != "BPE"
            or spec.get("normalizer")
            or cut.get("type") != "ByteLevel"
            or cut.get("add_prefix_space")
            or not cut.get("use_regex", True)
            or any(
                vocab.get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1)) != 256 + i
                for i, m in enumerate(merges)
            )
        ):
            return None
        import public_tokenizers
        import tiktoken

        byte_of = _byte_of()
        ranks = {
            bytes(byte_of[c] for c in token): i
            for token, i in vocab.items()
            if token not in self.special
        }
        return tiktoken.Encoding(
            "ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )._core_bpe.encode_ordinary

    def encode(self, text: str) -> list[int]:
        """Ids of a text that may be anything."""
        return self.whole.encode(text, add_special_tokens=False).ids

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of a text without special strings."""
        if self.piece_ids and (piece.isascii() or max(piece) < SAFE):
            return self.piece_ids(piece)
        return self.encode(piece)

    def pieces(self, text: str) -> tuple[str, list[str]] | None:
        """What stands before the first space, and the pieces that follow one; None: not so cut."""
        if not self.piece_ids or any(s in text for s in self.special):
            return None
        first, *rest = text.split(" ")
        return first, rest

    def plain(self, text: str) -> list[int]:
        """Ids of a text that could not be looked up piece by piece."""
        if any(s in text for s in self.special):
            return self.encode(text)
        return self.encode_piece(text)


def cuttable(piece: str) -> bool:
    return bool(piece) and not piece[0].isspace()


class Ids(dict):
    """Little-endian 32-bit ids of a piece with the space before it; None: not cuttable."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes | None:
        if len(self) >= CACHED:
            self.clear()
        found = None
        if cuttable(piece):
            found = array("I", self.encoder.encode_piece(" " + piece)).tobytes()
        if len(piece) <= 64:
            self[piece] = found
        return found

    def of(self, text: str) -> bytes:
        """Ids of a whole text."""
        cut = self.encoder.pieces(text)
        if cut:
            try:
                first = array("I", self.encoder.encode_piece(cut[0])).tobytes() if cut[0] else b""
                return first + b"".join(map(self.__getitem__, cut[1]))
            except TypeError:
                pass
        return array("I", self.encoder.plain(text)).tobytes()


_encoders: dict[str, Encoder] = {}
_ids: dict[str, Ids] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def ids(path: str) -> Ids:
    if path not in _ids:
        _ids[path] = Ids(encoder(path))
    return _ids[path]
