"""Language of whole texts by interpolated Kneser-Ney models over characters.

Texts are lowered, runs of anything but letters become one space, and every language gets a model
of four-character strings. A gram is packed into 64 bits and mixed, which loses nothing within
the basic plane; per order the grams of all languages lie in one sorted array, each with the log
probabilities of only those languages that have it. A language that lacks a gram backs off, by its own
weight of the context if it has that. So the models' size is the sum of what the languages have. A
text goes to the language of the lowest cross-entropy per character.

The models are fitted on a sample of distinct labelled texts, taken in hash order up to about
MAX_CHARS characters per language and TOTAL_CHARS in all; of a very long text evenly spread windows
are taken. Every language gives at least one text, and copies count once; of more than MAX_LANGUAGES
labels those with the most texts are learned. One in eight texts calibrates the models: the
temperature of the score, and how far above a language's usual cross-entropy a text may lie before it
is rejected. For that the models are fitted without those texts, and then anew with them. The limit
comes from a high quantile of those texts whose best language is their label, so that a few wrong
labels or odd texts don't move it.

A null text, or one without a letter, is `und` with score 0 and is rejected. Ties go to the
language first in code-point order. Texts of any length are judged whole, in pieces. Repeated rows are
judged each. With no labelled rows all are `und`. Empty tables give no rows; columns named like a
result are replaced, others pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from looptrace.llm.common import append, bounded_batches, stored

ORDER = 4
MAX_CHARS = 1_500_000  # per language, about, that the counts are taken from
TOTAL_CHARS = 60_000_000  # of all languages, about
MAX_LANGUAGES = 1_000  # labels that are learned, at most
CELLS = 1_000_000  # logs of grams and languages that are held at once
MAX_DOCS = 400  # per language that calibrate, at most
MAX_CHECKS = 20_000  # of all languages, about
WINDOW = 2_000  # characters of a window of a long text
WINDOWS = 50  # of a text, at most, evenly spread; shorter texts are taken whole
SPACE = 32
UND = "und"
MIX = 0x9E3779B97F4A7C15  # odd, so mixing is one to one
LEAST_LIMIT = 15.0  # deviations above the usual cross-entropy that are never rejected
TYPICAL = 0.95  # share of the rightly labelled calibrating texts that sets the limit
BEYOND = 1.5  # times the worst of those that is not rejected either


def _letters() -> np.ndarray:
    """The lowered letter of each code point, folded to 16 bits; a space for all others."""
    table = np.full(0x110000, SPACE, np.uint16)
    for c in range(0x33000):  # no letters are assigned beyond
        if chr(c).isalpha():
            table[c] = max(ord(chr(c).lower()[0]) & 0xFFFF, SPACE + 1)
    return table


_table: np.ndarray | None = None


def normal(text: str) -> np.ndarray:
    """The letters of a text with one space between words and at both ends, as 16-bit codes."""
    global _table
    if _table is None:
        _table = _letters()
    codes = _table[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
    gap = codes == SPACE
    codes = codes[~gap | np.append(False, ~gap[:-1])] if len(codes) else codes
    if not len(codes) or (len(codes) == 1 and codes[0] == SPACE):
        return np.zeros(0, np.uint16)
    ends = [SPACE] * (1 if codes[-1] == SPACE else 2)
    return np.concatenate([[SPACE], codes, ends[1:], [SPACE] * max(0, ORDER - len(codes) - len(ends))]
                          ).astype(np.uint16)


def grams(codes: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The packed strings of `order` codes, one for each character after the first."""
    n = len(codes) - order + 1
    out = np.zeros(n, np.uint64)
    for k in range(order):
        out = (out << np.uint64(16)) | codes[k : k + n].astype(np.uint64)
    return out


def suffix(packed: np.ndarray, order: int) -> np.ndarray:
    return packed & np.uint64((1 << (16 * (order - 1))) - 1)


def mixed(packed: np.ndarray) -> np.ndarray:
    return packed * np.uint64(MIX)


@dataclass
class Level:
    """Grams of one order: their mixed hashes, sorted, and for each the languages that have it, as
    numbers ascending, with their logs; those of gram i lie from starts[i] to starts[i + 1]."""

    hashes: np.ndarray
    starts: np.ndarray
    languages: np.ndarray
    logs: np.ndarray

    def fill(self, packed: np.ndarray, out: np.ndarray, add: bool = False) -> None:
        """Puts the logs of the grams' languages into the rows of `out`, or adds them."""
        if not len(self.hashes):
            return
        wanted = mixed(packed)
        at = np.searchsorted(self.hashes, wanted)
        at[at == len(self.hashes)] = 0
        rows = np.flatnonzero(self.hashes[at] == wanted)
        first, n = self.starts[at[rows]], np.diff(self.starts)[at[rows]]
        row = np.repeat(rows, n)
        entry = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        if add:
            out[row, self.languages[entry]] += self.logs[entry]
        else:
            out[row, self.languages[entry]] = self.logs[entry]


def level(packed: np.ndarray, languages: np.ndarray, logs: np.ndarray) -> Level:
    """Of rows (gram, language, log) in any order."""
    hashes = mixed(packed)
    order = np.lexsort((languages, hashes))
    hashes = hashes[order]
    starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    return Level(hashes[starts], np.append(starts, len(hashes)).astype(np.int32),
                 languages[order].astype(np.int16), logs[order].astype(np.float32))


@dataclass
class Model:
    languages: list[str]
    probabilities: list[Level]  # by order, from 1
    backoffs: list[Level]  # by order; of contexts one shorter
    floor: float  # log probability of a character never seen
    temperature: float = 1.0
    usual: np.ndarray | None = None  # by language: mean and deviation of the cross-entropy
    limit: float = float("inf")

    def logs(self, packed: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Per gram and language the log probability of its last character after the others."""
        if not order:
            return np.full((len(packed), len(self.languages)), self.floor, np.float32)
        shorter, place = np.unique(suffix(packed, order), return_inverse=True)
        out = self.logs(shorter, order - 1)[place]
        self.backoffs[order - 1].fill(packed >> np.uint64(16), out, add=True)
        self.probabilities[order - 1].fill(packed, out)
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Characters of each text, and nats per character under each language."""
        coded = [grams(c) if len(c) else c.astype(np.uint64) for c in map(normal, texts)]
        sizes = np.array([len(c) for c in coded], np.int64)
        out = np.zeros((len(texts), len(self.languages)))
        every = np.concatenate([np.zeros(0, np.uint64), *coded])
        owner = np.repeat(np.arange(len(texts)), sizes)
        step = max(1, CELLS // len(self.languages))
        for start in range(0, len(every), step):
            part, of = every[start : start + step], owner[start : start + step]
            distinct, place = np.unique(part, return_inverse=True)
            logs = self.logs(distinct)[place]
            firsts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            out[of[firsts]] += np.add.reduceat(logs, firsts, axis=0, dtype=np.float64)
        full = sizes > 0
        out[full] = -out[full] / sizes[full, None]
        return sizes, out

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best language by number (-1: none), its score, its cross-entropy, and whether rejected."""
        sizes, nats = self.entropies(texts)
        best = nats.argmin(1)
        low = nats[np.arange(len(texts)), best]
        odds = np.exp(-(nats - low[:, None]) * sizes[:, None] * self.temperature)
        score = 1 / odds.sum(1)
        rejected = excess(low, sizes, self.usual[best]) > self.limit
        none = sizes == 0
        return (np.where(none, -1, best), np.where(none, 0, score), np.where(none, 0, low),
                rejected | none)


def excess(low: np.ndarray, sizes: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """Deviations above the usual cross-entropy; short texts vary more."""
    return (low - usual[:, 0]) / (usual[:, 1] * np.sqrt(1 + 400 / np.maximum(sizes, 1)))


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Interpolated Kneser-Ney models from each language's distinct grams and their counts.

    The highest order uses counts, the lower ones the number of distinct characters before a gram;
    each order takes one discount, n1 / (n1 + 2 n2), off every count and gives it to the order below.
    """
    languages = sorted(counts)
    found: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(ORDER)]
    rests: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(ORDER)]
    characters = []
    tops = {name: counts[name] for name in languages}
    per_language = {}
    for name, (packed, n) in tops.items():
        orders = [(packed, n.astype(np.float64))]
        for order in range(ORDER, 1, -1):
            packed, kinds = np.unique(suffix(packed, order), return_counts=True)
            orders.append((packed, kinds.astype(np.float64)))
        per_language[name] = orders[::-1]
        characters.append(packed)
    floor = -float(np.log(len(np.unique(np.concatenate(characters))) + 1))
    for k, name in enumerate(languages):
        below_grams, below = np.zeros(1, np.uint64), np.array([np.exp(floor)])
        for order, (packed, n) in enumerate(per_language[name], 1):
            ones, twos = (n == 1).sum(), (n == 2).sum()
            off = ones / (ones + 2 * twos) if ones and twos else 0.5
            contexts, after = np.unique(packed >> np.uint64(16), return_inverse=True)
            totals = np.bincount(after, n, len(contexts))
            left = off * np.bincount(after, minlength=len(contexts)) / totals
            shorter = suffix(packed, order) if order > 1 else np.zeros(len(packed), np.uint64)
            lower = below[np.searchsorted(below_grams, shorter)]  # a gram's suffix is in the model too
            chances = (n - off) / totals[after] + left[after] * lower
            here = np.full(len(packed), k)
            found[order - 1].append((packed, here, np.log(chances)))
            rests[order - 1].append((contexts, np.full(len(contexts), k), np.log(left)))
            below_grams, below = packed, chances
    return Model(
        languages,
        [level(*map(np.concatenate, zip(*rows))) for rows in found],
        [level(*map(np.concatenate, zip(*rows))) for rows in rests],
        floor,
    )


def share(levels: list[tuple[int, int, float]], max_chars: int) -> float:
    """The greatest hash, from 0 to 1, of the texts taken of a language: of those before it there
    are about `max_chars` characters. Levels are (k, characters, least hash) of the texts whose
    hashes are from 2 ** -(k + 1) to 2 ** -k."""
    taken, reached = 0, 0.0
    for k, chars, _ in sorted(levels, reverse=True):
        if taken + chars > max_chars:
            reached = 2.0 ** -(k + 1) * (1 + (max_chars - taken) / chars)
            break
        taken, reached = taken + chars, 2.0**-k
    return max(reached, min(first for _, _, first in levels))


def train(labelled: DataFrame, max_chars: int = MAX_CHARS, max_docs: int = MAX_DOCS) -> Model | None:
    """A model of the labelled rows (text, lang). None if no row has both a text and a label.

    Distinct texts are taken in order of a hash until a language has about `max_chars` characters, or
    its part of TOTAL_CHARS, the first in any case; one in eight of the others calibrates.
    """
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    key = F.xxhash64("text", F.lit(17))
    point = F.shiftrightunsigned("key", 11).cast("double") / float(1 << 53)
    level = F.floor(-F.log2(F.greatest("point", F.lit(2.0**-53)))).cast("int")
    chars = F.least(F.length("text"), F.lit(WINDOW * WINDOWS)).cast("long")
    distinct = rows.select("lang", key.alias("key"), chars.alias("chars")).groupBy("lang", "key")
    per_language = (
        distinct.agg(F.max("chars").alias("chars"))
        .select("lang", "chars", point.alias("point"))
        .groupBy("lang", level.alias("level"))
        .agg(F.sum("chars").alias("chars"), F.min("point").alias("first"), F.count("*").alias("n"))
        .groupBy("lang")
        .agg(F.collect_list(F.struct("level", "chars", "first")).alias("levels"), F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "lang")
        .limit(MAX_LANGUAGES)
    )
    levels = {r.lang: [tuple(x) for x in r.levels] for r in per_language.collect()}
    if not levels:
        return None
    max_chars = min(max_chars, TOTAL_CHARS // len(levels))

    shares = labelled.sparkSession.createDataFrame(
        [(k, share(found, max_chars), min(x for _, _, x in found)) for k, found in levels.items()],
        "lang string, share double, first double",
    )
    long = F.length("text") > WINDOW * WINDOWS
    step = (F.length("text") - WINDOW) / float(WINDOWS - 1)
    spread = F.concat_ws(" ", *(
        F.substr("text", (step * i).cast("int") + 1, F.lit(WINDOW)) for i in range(WINDOWS)
    ))
    sample = stored(
        rows.withColumn("key", key)
        .withColumn("point", point)
        .join(F.broadcast(shares), "lang")  # a row per language learned
        .where("point <= share")
        .groupBy("lang", "key", "point", "first")
        .agg(F.first("text").alias("text"))
        .select(
            F.when(long, spread).otherwise(F.col("text")).alias("text"),
            "lang",
            ((F.pmod(F.xxhash64("text", F.lit(29)), F.lit(8)) == 0)
             & (F.col("point") > F.col("first"))).alias("calibrates"),
        ),
        "langid",
    )

    def count(batches):
        for batch in batches:
            found: dict[tuple[str, bool], list[np.ndarray]] = {}
            for text, lang, kept in zip(*(c.to_pylist() for c in batch.columns)):
                codes = normal(text)
                if len(codes):
                    found.setdefault((lang, kept), []).append(grams(codes))
            for (lang, kept), parts in found.items():
                packed, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(packed)), pa.array(packed.view(np.int64)),
                     pa.array(n * (not kept), pa.int64()), pa.array(n, pa.int64())],
                    names=["lang", "gram", "learned", "n"],
                )

    bounded_batches(labelled.sparkSession)
    counted = (
        sample.select("text", "lang", "calibrates")
        .mapInArrow(count, "lang string, gram long, learned long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("learned").alias("learned"), F.sum("n").alias("n"))
        .orderBy("lang")
        .toArrow()  # as many as the sample's characters at most
    )
    if not len(counted):  # no text has a letter
        return None
    lang = counted["lang"].combine_chunks().dictionary_encode()
    number, names = np.asarray(lang.indices), lang.dictionary.to_pylist()
    edges = [*np.searchsorted(number, np.arange(len(names))), len(number)]  # numbered as they come

    def counts(column: str) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        out = {}
        grams_of, all_n = counted["gram"].to_numpy().view(np.uint64), counted[column].to_numpy()
        for name, a, b in zip(names, edges, edges[1:]):
            own = np.flatnonzero(all_n[a:b]) + a
            if len(own):
                own = own[np.argsort(grams_of[own])]
                out[name] = grams_of[own], all_n[own]
        return out

    learned = counts("learned")
    checks = (
        sample.where("calibrates")
        .select("text", "lang", F.row_number().over(
            Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text")).alias("at"))
        .where(F.col("at") <= min(max_docs, max(1, MAX_CHECKS // len(levels))))
        .collect()
    )
    unseen = kneser_ney(learned) if learned else None
    model = kneser_ney(counts("n"))
    if unseen:
        calibrate(unseen, [r.text for r in checks], [r.lang for r in checks])
        usual = dict(zip(unseen.languages, unseen.usual))
        model.temperature, model.limit = unseen.temperature, unseen.limit
        typical = np.median(unseen.usual, axis=0)
        model.usual = np.stack([usual.get(name, typical) for name in model.languages])
    else:
        calibrate(model, [], [])
    return model


def calibrate(model: Model, texts: list[str], labels: list[str]) -> None:
    """Sets temperature, usual cross-entropies and the limit from texts that weren't counted."""
    number = {name: i for i, name in enumerate(model.languages)}
    known = [(t, number[x]) for t, x in zip(texts, labels) if x in number]
    sizes, nats = model.entropies([t for t, _ in known])
    own = np.array([x for _, x in known], np.int64)
    on = sizes > 0
    sizes, nats, own = sizes[on], nats[on], own[on]
    model.usual = np.tile([3.0, 1.0], (len(model.languages), 1))
    if not len(own):
        return
    low = nats[np.arange(len(own)), own]
    for k in range(len(model.languages)):
        mine = low[(own == k) & (sizes >= 20)]
        values = mine if len(mine) >= 5 else low
        model.usual[k] = np.median(values), max(0.05, 1.5 * np.median(abs(values - np.median(values))))
    right = low <= nats.min(1)  # others may be labelled wrongly
    if right.any():
        excesses = excess(low, sizes, model.usual[own])[right]
        worst = np.quantile(excesses, TYPICAL, method="lower")
        model.limit = float(max(LEAST_LIMIT, BEYOND * worst))
    else:
        model.limit = LEAST_LIMIT
    losses = []
    for temperature in (0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0):
        odds = -(nats - low[:, None]) * sizes[:, None] * temperature
        losses.append((np.logaddexp.reduce(odds, axis=1).mean(), temperature))
    model.temperature = min(losses)[1]


FIELDS = (
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("cross_entropy", T.DoubleType()),
    T.StructField("rejected", T.BooleanType()),
)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """`docs` with lang_pred, score (0 to 1), cross_entropy (nats per character) and rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def build(column: pa.Array) -> list[pa.Array]:
        texts = [t or "" for t in column.to_pylist()]
        if sent.value is None:
            best, score, nats, rejected = ([-1] * len(texts), [0.0] * len(texts),
                                           [0.0] * len(texts), [True] * len(texts))
        else:
            best, score, nats, rejected = sent.value.judge(texts)
        names = sent.value.languages if sent.value else []
        return [
            pa.array([UND if b < 0 else names[b] for b in best], pa.string()),
            pa.array(score, pa.float64()),
            pa.array(nats, pa.float64()),
            pa.array(rejected, pa.bool_()),
        ]

    return append(docs, FIELDS, build)
