"""A linear-chain conditional random field over word shapes, in numpy."""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

import numpy as np

TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
AROUND = 3  # tokens to either side whose shapes count
PADDED = 60_000  # tokens, with padding, of rows that are decoded together; a longer row is alone
STEPS = 4_096  # tokens of a row whose scores are held at once
# Words that stand for signs or announce personal data, as shapes of their own.
CUES = frozenset(
    "at dot com org net mail email tel phone mobile call fax ip host address card visa iban no"
    " arroba punto punkt point arobase".split()
)


def shape(token: str) -> str:
    """The kind of a token: its length for numbers, case and length for words, signs themselves."""
    if token.isascii() and token.isdigit():
        small = "b" if len(token) <= 3 and int(token) <= 255 else ""
        return f"{small}{min(len(token), 8)}"
    if token.isalpha():
        if token.lower() in CUES:
            return token.lower()
        case = "x" if token.islower() else "X" if token.isupper() else "Xx"
        return case + str(min(len(token), 4) if len(token) < 3 else 3 + (len(token) > 7))
    return token if token.isascii() else "?"


def tokens(text: str) -> list[tuple[int, int, str]]:
    """(start, end, shape) of the tokens; a gap before a token is part of its shape."""
    out, last = [], 0
    for m in TOKEN.finditer(text):
        gap = "_" if m.start() > last else ""
        out.append((m.start(), m.end(), sys.intern(shape(m[0]) + gap)))
        last = m.end()
    return out


@dataclass
class Model:
    labels: list[str]  # "O", then "B-kind" and "I-kind"
    shapes: dict[str, int]  # 0 is for padding and 1 for shapes not seen
    emit: np.ndarray  # [2 * AROUND + 1, shapes, labels]
    move: np.ndarray  # [labels, labels]; -inf where I- follows neither its B- nor itself
    begin: np.ndarray

    def ids(self, rows: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(r) for r in rows], np.int64)
        out = np.zeros((len(rows), lengths.max() + 2 * AROUND), np.int64)
        for i, row in enumerate(rows):
            out[i, AROUND : AROUND + len(row)] = [self.shapes.get(s, 1) for s in row]
        return out, lengths

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        steps = ids.shape[1] - 2 * AROUND
        return sum(self.emit[o][ids[:, o : o + steps]] for o in range(2 * AROUND + 1))

    def decode(self, rows: list[list[str]]) -> list[np.ndarray]:
        """The best labels of each row of shapes (Viterbi over the rows of a batch at once). A row of
        any length is decoded whole: the best scores go on from step to step, and only a byte per
        token and label is kept for the way back."""
        found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(rows)
        order = sorted((i for i in range(len(rows)) if rows[i]), key=lambda i: len(rows[i]))
        while order:
            n = 1
            while n < min(256, len(order)) and (n + 1) * len(rows[order[n]]) <= PADDED:
                n += 1
            part, order = order[:n], order[n:]
            ids, lengths = self.ids([rows[i] for i in part])
            steps = ids.shape[1] - 2 * AROUND
            back = np.zeros((steps, n, len(self.labels)), np.int8)
            best = None
            for first in range(0, steps, STEPS):
                scores = self.emissions(ids[:, first : first + STEPS + 2 * AROUND])
                for t in range(scores.shape[1]):
                    if best is None:
                        best = scores[:, 0] + self.begin
                        continue
                    reached = best[:, :, None] + self.move
                    back[first + t] = reached.argmax(1)
                    on = (first + t < lengths)[:, None]
                    best = np.where(on, reached.max(1) + scores[:, t], best)
            last = best.argmax(1)
            labels = np.zeros((steps, n), np.int8)
            every = np.arange(n)
            for t in range(steps - 1, -1, -1):
                labels[t] = last
                if t:
                    last = np.where(t < lengths, back[t, every, last], last)
            for k, i in enumerate(part):
                found[i] = labels[: lengths[k], k]
        return found


def _by_length(rows: list[list[str]], groups: int = 6) -> list[list[int]]:
    """Numbers of rows in groups of like length, so that little is padding."""
    order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
    size = max(1, -(-len(order) // groups))
    return [order[i : i + size] for i in range(0, len(order), size)]


class Group:
    """Training rows of like length; the step comes first in all arrays."""

    def __init__(self, model: Model, rows: list[list[str]], tags: list[list[str]]):
        ids, lengths = model.ids(rows)
        n = len(model.labels)
        self.steps = ids.shape[1] - 2 * AROUND
        self.ids = np.ascontiguousarray(ids.T)
        self.real = (np.arange(self.steps)[:, None] < lengths)[:, :, None]
        at = np.zeros((self.steps, len(rows)), np.int64)
        for i, row in enumerate(tags):
            at[: len(row), i] = [model.labels.index(t) for t in row]
        self.gold = np.eye(n)[at] * self.real
        self.moves = np.einsum("tij,tik->jk", self.gold[:-1], self.gold[1:])
        # which token stands where: slopes of the emissions are sums by this
        seen, self.place = np.unique(self.ids, return_inverse=True)
        self.seen, self.place = seen, self.place.reshape(self.ids.shape)

    def add_slopes(self, model: Model, emit: np.ndarray, move: np.ndarray) -> None:
        """Adds the slopes of the log likelihood (scaled forward and backward sums)."""
        scores = sum(model.emit[o][self.ids[o : o + self.steps]] for o in range(2 * AROUND + 1))
        likely = np.exp(scores - scores.max(2, keepdims=True))
        go = np.exp(model.move)
        ahead, scale = np.empty_like(likely), np.empty(likely.shape[:2])
        now = likely[0] * np.exp(model.begin)
        for t in range(self.steps):
            if t:
                now = np.where(self.real[t], (ahead[t - 1] @ go) * likely[t], ahead[t - 1])
            scale[t] = now.sum(1)
            ahead[t] = now / scale[t][:, None]
        behind = np.ones_like(likely)
        expected = np.zeros_like(move)
        for t in range(self.steps - 1, 0, -1):
            after = likely[t] * behind[t] / scale[t][:, None] * self.real[t]
            behind[t - 1] = np.where(self.real[t], after @ go.T, 1)
            expected += ahead[t - 1].T @ after
        move += self.moves - expected * go
        slope = self.gold - ahead * behind * self.real
        n = len(model.labels)
        for o in range(2 * AROUND + 1):
            place = self.place[o : o + self.steps].ravel()
            flat = slope.reshape(-1, n)
            sums = [np.bincount(place, flat[:, k], len(self.seen)) for k in range(n)]
            emit[o][self.seen] += np.stack(sums, 1)


def train(
    rows: list[list[str]],
    tags: list[list[str]],
    kinds: list[str],
    rounds: int = 80,
    rate: float = 0.15,
    penalty: float = 2e-3,
) -> Model:
    """Greatest penalised likelihood of the tags, by gradient steps with adapted rates."""
    labels = ["O"] + [f"{p}-{k}" for k in kinds for p in "BI"]
    n = len(labels)
    seen = sorted({s for r in rows for s in r})
    shapes = {s: i + 2 for i, s in enumerate(seen)}
    allowed = np.ones((n, n), bool)
    begins = np.ones(n, bool)
    for j, label in enumerate(labels):
        if label[0] == "I":
            begins[j] = False
            allowed[:, j] = [x[1:] == label[1:] for x in labels]
    barred = np.where(allowed, 0.0, -1e9)
    model = Model(
        labels, shapes, np.zeros((2 * AROUND + 1, len(shapes) + 2, n)), barred.copy(),
        np.where(begins, 0.0, -1e9),
    )
    groups = [
        Group(model, [rows[i] for i in part], [tags[i] for i in part])
        for part in _by_length(rows)
    ]
    count = len(rows)
    weights = [model.emit, np.zeros((n, n))]
    first = [np.zeros_like(w) for w in weights]
    second = [np.zeros_like(w) for w in weights]
    for r in range(1, rounds + 1):
        model.move = weights[1] + barred
        grads = [np.zeros_like(w) for w in weights]
        for group in groups:
            group.add_slopes(model, *grads)
        for w, g, m, v in zip(weights, grads, first, second):
            g /= count
            g -= penalty * w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    model.move = weights[1] + barred
    return model
