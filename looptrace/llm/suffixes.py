"""Removes byte strings of SPAN bytes that occur more than once, by merging sorted suffixes.

Every window of SPAN bytes names one of its first REACH positions as its anchor: the least hash of
GRAM bytes, the first of equals. Equal windows name the same place, so only the suffixes at anchors
need be sorted, and windows are equal only if the suffixes at their anchors share their first
SHARED bytes and what stands before the anchors agrees as far as the windows go.

1. Texts are dealt into parts. Each part sends the hashes of its suffixes' first SHARED bytes; those
   that no other place has are done with.
2. Each part sorts its remaining suffixes, as far as its windows reach, and sends them as front-coded
   runs: the length shared with the suffix before, and the rest. Equal suffixes travel once.
3. A task merges the runs of one share of the hashes by a loser tree that keeps the lengths shared
   with the last winner and compares bytes only beyond them. Neighbours that share SHARED bytes
   or more form a group, in which equal windows are found from the shared lengths, or by counting
   the windows' strings if there are three suffixes or more.
4. Each part marks the bytes that its repeated windows cover.

A place that more than HOT parts share sends every window as a suffix of its own instead, spread by
their own hashes, so no task gets an unbounded group. Texts are compared as UTF-8; a null text is
empty. Equal rows repeat each other: they are one row with a count, whose text is a repetition as a
whole, and each gets the answer. Very long texts are a row of a part each, and are looked at in steps.
Empty tables give no rows; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from looptrace.llm.common import partitions_for

SPAN = 200
REACH = 100
GRAM = 12
SHARED = SPAN - REACH + 1  # bytes from an anchor that lie in every window that may name it
PART_BYTES = 8 << 20  # text of a part, about
SENT_BYTES = 1 << 20  # text that a row of a part holds, about
HOT = 2_000  # parts
STEP = 1 << 19  # windows whose anchors are looked for together
FACTOR = np.uint64(0x9E3779B97F4A7C15)
BYTE = np.random.default_rng(8).integers(0, 1 << 64, 256, dtype=np.uint64)
Record = tuple[bytes, bytes]  # a suffix, as far as its windows reach, and what they have before it


# Parts of the texts


def dealt(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (part, ids, counts, sizes, blob): some texts of a part, compressed together. Equal rows of
    a task travel once, with their count."""
    key = docs.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("part", T.IntegerType()),
        T.StructField("ids", T.ArrayType(key)),
        T.StructField("counts", T.ArrayType(T.LongType())),
        T.StructField("sizes", T.ArrayType(T.LongType())),
        T.StructField("blob", T.BinaryType()),
    ])
    rows = docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int").alias("part"),
        "doc_id", F.col("text").cast("binary").alias("text"),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: dict[int, Counter] = {}  # by part, rows (doc_id, text) and how often each was met
        waiting = 0
        squeeze = zstandard.ZstdCompressor(level=1).compress

        def sent(part: int) -> pa.RecordBatch:
            rows = pending.pop(part)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()),
                 pa.array([[doc for doc, _ in rows]], pa.list_(ids_type[0])),
                 pa.array([list(rows.values())], pa.list_(pa.int64())),
                 pa.array([[len(t) for _, t in rows]], pa.list_(pa.int64())),
                 pa.array([squeeze(b"".join(t for _, t in rows))], pa.binary())],
                names=["part", "ids", "counts", "sizes", "blob"],
            )

        ids_type = [pa.int64()]
        for batch in batches:
            ids_type[0] = batch.schema.field(1).type
            for part, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                row, rows = (doc, text or b""), pending.setdefault(part, Counter())
                size = 0 if row in rows else len(row[1])
                rows[row] += 1
                waiting += size
                if waiting > 32 * SENT_BYTES or size > SENT_BYTES:
                    for p in list(pending):
                        yield sent(p)
                    waiting = 0
        for p in list(pending):
            yield sent(p)

    return rows.mapInArrow(pack, schema)


class Part:
    """The texts of a part in one buffer, equal rows once, ordered so that every attempt sees the
    same."""

    def __init__(self, table: pa.Table):
        unpack = zstandard.ZstdDecompressor().decompress
        met: Counter = Counter()
        for i in range(len(table)):
            ids, counts, sizes, blob = (
                table[c][i].as_py() for c in ("ids", "counts", "sizes", "blob")
            )
            raw, at = unpack(blob) if sum(sizes) else b"", 0
            for doc, count, size in zip(ids, counts, sizes):
                met[doc, raw[at : at + size]] += count
                at += size
        rows = sorted(met, key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
        self.ids = [r[0] for r in rows]
        self.counts = [met[r] for r in rows]
        self.text = b"".join(r[1] for r in rows)
        self.ends = np.cumsum([len(r[1]) for r in rows], dtype=np.int64)
        self.codes = BYTE  # hashes of single bytes

    def anchors(self) -> tuple[np.ndarray, ...]:
        """Anchors, their first and last windows, and the hashes of their first SHARED bytes."""
        data = np.frombuffer(self.text, np.uint8)
        found = [_anchors(data, self.ends, s) for s in range(0, len(data), STEP)]
        if not found:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
        return tuple(np.concatenate(x) for x in zip(*found))


def _anchors(data: np.ndarray, ends: np.ndarray, start: int) -> tuple[np.ndarray, ...]:
    """Of the windows that start in [start, start + STEP); none crosses the end of a text."""
    windows = max(0, min(STEP, len(data) - start - SPAN + 1))
    if not windows:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    codes = BYTE[data[start : start + windows + SPAN - 1]]
    power, one = {1: codes}, FACTOR
    size, factors = 1, {1: one}
    while size * 2 <= SHARED:
        factors[size * 2] = np.uint64(int(factors[size]) ** 2 % (1 << 64))
        power[size * 2] = power[size][:-size] * factors[size] + power[size][size:]
        size *= 2

    def strings(length: int) -> np.ndarray:
        out, done = None, 0
        for k in sorted(power, reverse=True):
            if length & k:
                part = power[k][done:]
                out = part if out is None else out[: len(part)] * factors[k] + part[: len(out)]
                done += k
        return out

    with np.errstate(over="ignore"):
        grams = strings(GRAM)[: windows + REACH - 1]
        grams = (grams ^ (grams >> np.uint64(29))) * FACTOR
        shared = strings(SHARED)
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width * 2 <= REACH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < REACH:
        least = np.minimum(least[: windows], least[REACH - width :][:windows])
    named = (least[:windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = np.ones(windows, bool)
    first = np.searchsorted(ends, start, "right")
    last = np.searchsorted(ends, start + windows + SPAN)
    for end in ends[first : last + 1]:
        valid[max(0, end - SPAN + 1 - start) : max(0, end - start)] = False
    at = np.flatnonzero(valid)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    named = named[at]
    new = np.append(True, (named[1:] != named[:-1]) | (at[1:] != at[:-1] + 1))
    begins = np.flatnonzero(new)
    stops = np.append(begins[1:], len(at)) - 1
    anchor = named[begins]
    hashes = shared[anchor]
    hashes = (hashes ^ (hashes >> np.uint64(32))) * FACTOR
    return anchor + start, at[begins] + start, at[stops] + start, hashes ^ (hashes >> np.uint64(31))


# Step 1: which suffixes have a partner


def sent_hashes(table: pa.Table, shares: int) -> pa.Table:
    part = table["part"][0].as_py()
    hashes = np.unique(Part(table).anchors()[3])
    share = (hashes % np.uint64(shares)).astype(np.int64)
    order = np.argsort(share, kind="stable")
    hashes, share = hashes[order], share[order]
    cuts = np.flatnonzero(np.append(True, share[1:] != share[:-1])) if len(share) else []
    stops = [*cuts[1:], len(share)] if len(cuts) else []
    return pa.table({
        "share": pa.array(share[cuts] if len(cuts) else [], pa.int32()),
        "part": pa.array([part] * len(cuts), pa.int32()),
        "blob": pa.array([hashes[s:e].tobytes() for s, e in zip(cuts, stops)], pa.binary()),
    })


def repeated_hashes(table: pa.Table, hot: int) -> pa.Table:
    """For each part the hashes that another part has too; those of many parts apart."""
    parts = table["part"].to_pylist()
    blobs = [np.frombuffer(b, np.uint64) for b in table["blob"].to_pylist()]
    hashes = np.concatenate(blobs)
    owner = np.repeat(np.arange(len(parts)), [len(b) for b in blobs])
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    begins = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    many = np.diff(np.append(begins, len(hashes)))
    many = np.repeat(many, many)
    out: dict[str, list] = {"part": [], "share": [], "kind": [], "blob": []}
    for kind, wanted in (("shared", (many > 1) & (many <= hot)), ("hot", many > hot)):
        found, by = hashes[wanted], owner[wanted]
        order = np.argsort(by, kind="stable")
        found, by = found[order], by[order]
        cuts = np.flatnonzero(np.append(True, by[1:] != by[:-1])) if len(by) else []
        stops = [*cuts[1:], len(by)] if len(cuts) else []
        for s, e in zip(cuts, stops):
            out["part"].append(parts[by[s]])
            out["share"].append(0)
            out["kind"].append(kind)
            out["blob"].append(found[s:e].tobytes())
    return _replies(out)


REPLY = "part int, share int, kind string, blob binary"


def _replies(out: dict[str, list]) -> pa.Table:
    types = {"part": pa.int32(), "share": pa.int32(), "kind": pa.string(), "blob": pa.binary()}
    return pa.table({k: pa.array(out[k], t) for k, t in types.items()})


# Step 2: sorted runs


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of what two strings share at their starts, of which `known` bytes are known."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    apart = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return n - (apart.bit_length() + 7) // 8


def common_end(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    return common(a[len(a) - n :][::-1], b[len(b) - n :][::-1])


def runs(part: Part, replies: pa.Table, shares: int) -> dict[int, list[tuple[Record, list[int]]]]:
    """By share of the hashes, the part's sorted suffixes that may have partners, each with the
    first windows of its places."""
    sent: dict[str, list[np.ndarray]] = {"shared": [], "hot": []}
    for kind, blob in zip(replies["kind"].to_pylist(), replies["blob"].to_pylist()):
        if kind in sent:
            sent[kind].append(np.frombuffer(blob, np.uint64))
    anchor, lo, hi, hashes = part.anchors()
    if not len(anchor):
        return {}
    unique, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    hot = np.isin(unique, np.concatenate([np.zeros(0, np.uint64), *sent["hot"]]))
    wanted = (counts > 1) | np.isin(
        unique, np.concatenate([np.zeros(0, np.uint64), *sent["shared"]])
    )
    found: dict[int, dict[Record, list[int]]] = {}
    text = part.text
    at = np.flatnonzero((wanted & ~hot)[inverse])
    share = (hashes[at] % np.uint64(shares)).astype(np.int64)
    for a, s, e, n in zip(anchor[at].tolist(), lo[at].tolist(), hi[at].tolist(), share.tolist()):
        found.setdefault(n, {}).setdefault((text[a : e + SPAN], text[s:a]), []).append(s)
    for i in np.flatnonzero(hot[inverse]):
        for p in range(int(lo[i]), int(hi[i]) + 1):
            window = text[p : p + SPAN]
            n = xxhash.xxh3_64_intdigest(window) % shares
            found.setdefault(n, {}).setdefault((window, b""), []).append(p)
    return {n: sorted(records.items()) for n, records in found.items()}


def coded(run: list[tuple[Record, list[int]]]) -> bytes:
    """A run, front-coded: shared lengths, lengths, counts up to two, and what is new of each."""
    shared, sizes, before, counts, rest = [], [], [], [], []
    last = b""
    for (suffix, left), places in run:
        known = common(last, suffix)
        shared.append(known)
        sizes.append(len(suffix))
        before.append(len(left))
        counts.append(min(2, len(places)))
        rest += (suffix[known:], left)
        last = suffix
    head = len(run).to_bytes(4, "little")
    return zstandard.ZstdCompressor(level=1).compress(
        head + bytes(shared) + bytes(sizes) + bytes(before) + bytes(counts) + b"".join(rest)
    )


def decoded(blob: bytes) -> Iterator[tuple[int, bytes, bytes, int]]:
    """(shared length, suffix, left, count) of each suffix of a run, one at a time."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    shared, sizes, before, counts = (raw[4 + k * n : 4 + (k + 1) * n] for k in range(4))
    at, last = 4 + 4 * n, b""
    for known, size, left, count in zip(shared, sizes, before, counts):
        new = size - known
        last = last[:known] + raw[at : at + new]
        at += new
        yield known, last, raw[at : at + left], count
        at += left


def sent_runs(part: pa.Table, replies: pa.Table, shares: int) -> pa.Table:
    number = part["part"][0].as_py() if len(part) else 0
    found = runs(Part(part), replies, shares) if len(part) else {}
    return pa.table({
        "share": pa.array(list(found), pa.int32()),
        "part": pa.array([number] * len(found), pa.int32()),
        "blob": pa.array([coded(r) for r in found.values()], pa.binary()),
    })


# Step 3: merging


def merged(streams: list[Iterator]) -> Iterator[tuple[int, int, int, bytes, bytes, int]]:
    """(shared with the one before, run, place in it, suffix, left, count) in order of the suffixes.

    A loser tree: a node keeps the run that lost there and how much its suffix shares with the
    winner it lost to. Of two suffixes, the one that shares more with the last winner is smaller;
    only when they share equally much are bytes compared, and only beyond what is shared.
    """
    k = 1
    while k < len(streams):
        k *= 2
    heads: list = [next(s, None) for s in streams] + [None] * (k - len(streams))
    places = [0] * k
    shared = [0] * k
    losers = [0] * k

    def play(i: int, j: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared length becomes that with the winner."""
        a, b = heads[i], heads[j]
        if a is None or b is None:
            return (j, i) if a is None else (i, j)
        if shared[i] != shared[j]:
            return (i, j) if shared[i] > shared[j] else (j, i)
        x, y = a[1], b[1]
        n = common(x, y, shared[i])
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            shared[j] = n
            return i, j
        shared[i] = n
        return j, i

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if k > 1 else 0
    while heads[winner] is not None:
        _, suffix, left, count = heads[winner]
        yield shared[winner], winner, places[winner], suffix, left, count
        heads[winner] = after = next(streams[winner], None)
        places[winner] += 1
        shared[winner] = after[0] if after else 0
        node = (winner + k) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def windows_of(suffix: bytes, left: bytes) -> int:
    return len(left) + len(suffix) - SPAN + 1


def repeated_windows(counts: dict[Record, int], shared: int) -> dict[Record, int]:
    """Per suffix of a group a mask of its repeated windows, the first window in the lowest bit."""
    every = {r: (1 << windows_of(*r)) - 1 for r in counts}
    masks = {r: every[r] if n > 1 else 0 for r, n in counts.items()}
    if len(counts) == 2:
        (x, p), (y, q) = counts
        after = shared if x != y else len(x)
        before = common_end(p, q)
        # a window with `o` bytes before the anchor is equal if o <= before and SPAN - o <= after
        for record in counts:
            size = len(record[1])
            first, last = max(0, size - before), size - max(0, SPAN - after)
            if first <= last:
                masks[record] |= ((1 << (last + 1)) - (1 << first)) & every[record]
        return masks
    for o in range(REACH):
        found: list[tuple[bytes, Record]] = []
        seen: Counter[bytes] = Counter()
        for record, n in counts.items():
            suffix, left = record
            if SPAN - len(suffix) <= o <= len(left):
                window = left[len(left) - o :] + suffix[: SPAN - o]
                seen[window] += n
                if n == 1:
                    found.append((window, record))
        for window, record in found:
            if seen[window] > 1:
                masks[record] |= 1 << (len(record[1]) - o)
    return masks


MASK = (REACH + 7) // 8


def merged_runs(table: pa.Table) -> pa.Table:
    """For each run the places of its suffixes with repeated windows, and their masks."""
    order = sorted(range(len(table)), key=lambda i: table["part"][i].as_py())
    parts = [table["part"][i].as_py() for i in order]
    found: list[tuple[list[int], list[bytes]]] = [([], []) for _ in parts]
    group: list[tuple[int, int, Record]] = []
    counts: dict[Record, int] = {}
    least = [SPAN]

    def close() -> None:
        if len(counts) > 1 or any(n > 1 for n in counts.values()):
            if len(counts) == 1:
                masks = {r: (1 << windows_of(*r)) - 1 for r in counts}
            else:
                masks = repeated_windows(counts, least[0])
            for run, place, record in group:
                if masks[record]:
                    found[run][0].append(place)
                    found[run][1].append(masks[record].to_bytes(MASK, "little"))
        group.clear()
        counts.clear()
        least[0] = SPAN

    for shared, run, place, suffix, left, count in merged(
        [decoded(table["blob"][i].as_py()) for i in order]
    ):
        if group:
            if shared < SHARED:
                close()
            elif shared < len(suffix) or shared < len(group[-1][2][0]):
                least[0] = min(least[0], shared)
        record = (suffix, left)
        group.append((run, place, record))
        counts[record] = counts.get(record, 0) + count
    close()
    share = table["share"][0].as_py()
    out: dict[str, list] = {"part": [], "share": [], "kind": [], "blob": []}
    for part, (places, masks) in zip(parts, found):
        if places:
            out["part"].append(part)
            out["share"].append(share)
            out["kind"].append("repeated")
            out["blob"].append(zstandard.ZstdCompressor(level=1).compress(
                len(places).to_bytes(4, "little") + np.array(places, np.uint32).tobytes()
                + b"".join(masks)
            ))
    return _replies(out)


# Step 4: what is left of each text


def cleaned(table: pa.Table, replies: pa.Table, shares: int, id_type, texts: bool) -> pa.Table:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["text"] * texts
    kinds = [id_type, pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.string()] * texts
    if not len(table):
        return pa.table([pa.array([], t) for t in kinds], names=names)
    part = Part(table)
    covered = np.zeros(len(part.text) + 1, np.int32)
    answers = {
        s: b
        for s, k, b in zip(*(replies[c].to_pylist() for c in ("share", "kind", "blob")))
        if k == "repeated"
    }
    if answers:
        built = runs(part, replies, shares)
        starts: list[np.ndarray] = []
        for share, blob in answers.items():
            raw = zstandard.ZstdDecompressor().decompress(blob)
            n = int.from_bytes(raw[:4], "little")
            places = np.frombuffer(raw, np.uint32, n, 4)
            masks = np.frombuffer(raw, np.uint8, n * MASK, 4 + 4 * n).reshape(n, MASK)
            bits = np.unpackbits(masks, axis=1, bitorder="little")
            run = built[share]
            sizes = [len(run[p][1]) for p in places.tolist()]
            firsts = np.concatenate([np.array(run[p][1], np.int64) for p in places.tolist()])
            which, offset = np.nonzero(bits[np.repeat(np.arange(n), sizes)])
            starts.append(firsts[which] + offset)
        at = np.concatenate(starts)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + SPAN, -1)
    gone = np.cumsum(covered)[:-1] > 0
    data = np.frombuffer(part.text, np.uint8)
    rows, often = [], []
    for doc, count, start, end in zip(
        part.ids, part.counts, [0, *part.ends[:-1].tolist()], part.ends.tolist()
    ):
        cut = gone[start:end]
        if count > 1 and end - start >= SPAN:  # equal rows repeat all of each other
            cut = np.ones(end - start, bool)
        often.append(count)
        removed = int(cut.sum())
        kept = part.text[start:end] if not removed else data[start:end][~cut].tobytes()
        spans = int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum()) if removed else 0
        row = [doc, end - start, removed, spans, hashlib.sha256(kept).hexdigest()]
        rows.append(row + [kept.decode("utf-8", "replace")] * texts)
    found = pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)
    return found.take(pa.array(np.repeat(np.arange(len(rows)), often)))


def remove_repeats(docs: DataFrame, hot: int = HOT, part_bytes: int = PART_BYTES,
                   with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the text left
    (a character that lost some of its bytes becomes a replacement mark there)."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = shares = partitions_for(total, part_bytes)
    texts = dealt(docs, parts)
    key = docs.schema["doc_id"].dataType
    id_type = docs.limit(0).select("doc_id").toArrow().schema.field(0).type
    hashes = texts.groupBy("part").applyInArrow(
        lambda t: sent_hashes(t, shares), "share int, part int, blob binary"
    )
    replies = hashes.groupBy("share").applyInArrow(lambda t: repeated_hashes(t, hot), REPLY)
    sorted_runs = (
        texts.groupBy("part")
        .cogroup(replies.groupBy("part"))
        .applyInArrow(lambda t, r: sent_runs(t, r, shares), "share int, part int, blob binary")
    )
    repeated = sorted_runs.groupBy("share").applyInArrow(merged_runs, REPLY)
    schema = T.StructType([
        T.StructField("doc_id", key),
        *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")),
        T.StructField("kept_sha256", T.StringType()),
        *([T.StructField("text", T.StringType())] * with_text),
    ])
    return (
        texts.groupBy("part")
        .cogroup(replies.unionByName(repeated).groupBy("part"))
        .applyInArrow(lambda t, r: cleaned(t, r, shares, id_type, with_text), schema)
    )
