"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set holds its distinct shingles of five words, lower-cased in A-Z; with fewer words the
whole sequence is its one shingle. A sketch of SIZE coordinates is filled in rounds: each throws all
shingles into hashed bins and keeps the least value per bin, where a later round counts only in bins
still empty; after SIZE rounds each bin in turn takes the least of all, so every coordinate is
filled and agrees with the chance of the sets' similarity. Documents that agree in a whole band are
candidates. Their connected groups are verified on full sets, and links at 85 hundredths or more
make the components.

Documents with equal words are one class and compared once, so copies are never paired up. Groups
of candidates above BLOCK classes are cut into blocks, and a task gets two of them.

A null, empty or blank text has an empty set and is alone. Equal rows link like other copies; a
component takes its smallest doc_id, nulls left aside (null if it has no other). Empty tables give
no rows; only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from looptrace.llm.common import (
    append, components, join_counted, partitions_for, stored, utf8,
)

SHINGLE = 5
BAND, BANDS = 5, 25  # at a similarity of 0.85 a pair shares no band in fewer than one of 10**6 cases
SIZE = BAND * BANDS
BLOCK = 1500  # classes of a candidate group that a task takes in one block
TASK_SHINGLES = 500_000  # shingles of small candidate groups that go to one task, about
LINK = 85  # hundredths
PRIME1, PRIME2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * PRIME1
    x = (x ^ (x >> np.uint64(29))) * PRIME2
    return x ^ (x >> np.uint64(32))


def shingles(words: list[bytes]) -> np.ndarray:
    """The set of a document's words, as sorted 64-bit hashes."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    mixed = hashed[:n].copy()
    for k in range(1, SHINGLE):
        mixed = scrambled(mixed + PRIME2) + hashed[k : k + n]
    return np.unique(scrambled(mixed))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of SIZE coordinates for each non-empty set."""
    if not sets:
        return np.zeros((0, SIZE), np.uint64)
    cells = np.full(len(sets) * SIZE, EMPTY)
    items = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)) * SIZE, [len(s) for s in sets])
    for r in range(2 * SIZE):
        drawn = scrambled(items + np.uint64((r + 1) * int(PRIME1) % (1 << 64)))
        values = (np.uint64(r) << np.uint64(32)) | (drawn & np.uint64(0xFFFFFFFF))
        if r < SIZE:
            bins = (((drawn >> np.uint64(32)) * np.uint64(SIZE)) >> np.uint64(32)).astype(np.int64)
        else:
            bins = r - SIZE
        np.minimum.at(cells, owner + bins, values)
        open_rows = (cells.reshape(-1, SIZE) == EMPTY).any(1)
        if not open_rows.any():
            break
        still = open_rows[owner // SIZE]
        items, owner = items[still], owner[still]
    return cells.reshape(-1, SIZE)


def bands(rows: np.ndarray) -> np.ndarray:
    out = np.tile(np.arange(BANDS, dtype=np.uint64) * PRIME2, (len(rows), 1))
    for k in range(BAND):
        out = scrambled(out + rows[:, k::BAND])
    return out


FIELDS = (
    T.StructField("key", T.BinaryType()),
    T.StructField("n_shingles", T.LongType()),
    T.StructField("bands", T.ArrayType(T.LongType())),
)


def signed(docs: DataFrame) -> DataFrame:
    """`docs` with the key of their words, the size of their set and the hashes of their bands."""

    def build(text: pa.Array) -> list[pa.Array]:
        words = [t.lower().split() if t else [] for t in utf8(text)]
        sets = [shingles(w) for w in words]
        full = [i for i, s in enumerate(sets) if len(s)]
        hashed = bands(sketches([sets[i] for i in full])).view(np.int64)
        ends = np.zeros(len(sets) + 1, np.int32)
        ends[[i + 1 for i in full]] = BANDS
        return [
            pa.array([xxhash.xxh3_128_digest(b" ".join(w)) for w in words], pa.binary()),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)),
                                     pa.array(hashed.ravel())),
        ]

    return append(docs, FIELDS, build)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairs' intersections: columns in few sets pair by pair, others by products."""
    m = len(sets)
    if m <= 8:
        out = np.zeros((m, m), np.int64)
        for i in range(m):
            for j in range(i):
                out[i, j] = out[j, i] = len(
                    np.intersect1d(sets[i], sets[j], assume_unique=True)
                )
        return out
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    items = np.concatenate(sets)
    order = np.argsort(items, kind="stable")
    items, owner = items[order], owner[order]
    starts = np.flatnonzero(np.append(True, items[1:] != items[:-1]))
    spread = np.diff(np.append(starts, len(items)))
    out = np.zeros((m, m), np.float32)
    for n in range(2, 9):
        at = starts[spread == n]
        for a in range(n):
            for b in range(a + 1, n):
                np.add.at(out, (owner[at + a], owner[at + b]), 1)
    common = np.flatnonzero(spread > 8)
    for k in range(0, len(common), 4096):
        part = common[k : k + 4096]
        n = spread[part]
        column = np.repeat(np.arange(len(part)), n)
        member = np.repeat(starts[part] - np.cumsum(n) + n, n) + np.arange(n.sum())
        dense = np.zeros((m, len(part)), np.float32)
        dense[owner[member], column] = 1
        out += np.triu(dense @ dense.T, 1)
    return (out + out.T).astype(np.int64)


def linked(sets: list[np.ndarray], sides: np.ndarray, across: bool, link: int) -> list[tuple[int, int]]:
    """Edges that join the sets linked among each other, or only those linked across two sides."""
    sizes = np.array([len(s) for s in sets], np.int64)
    common = overlaps(sets)
    joined = 100 * common >= link * (sizes[:, None] + sizes - common)
    np.fill_diagonal(joined, False)
    if across:
        joined &= sides[:, None] != sides
    lowest = np.arange(len(sets))
    while True:
        near = np.where(joined, lowest, len(sets)).min(1, initial=len(sets))
        new = np.minimum(lowest, near)
        if (new == lowest).all():
            return [(i, int(k)) for i, k in enumerate(lowest) if i != k]
        lowest = new


def verify(table: pa.Table, link: int = LINK) -> pa.Table:
    """Edges between the keys of the classes that a task holds, group by group."""
    rows: dict[int, dict[bytes, tuple[int, bytes]]] = {}
    across = table["lo"][0].as_py() < table["hi"][0].as_py()
    for group, side, key, text in zip(
        table["grp"].to_pylist(), table["side"].to_pylist(), table["key"].to_pylist(),
        table["text"].cast(pa.binary()).to_pylist(),
    ):
        rows.setdefault(group, {})[key] = (side, text)
    a, b = [], []
    for members in rows.values():
        if len(members) > 1:
            keys = list(members)
            sets = [shingles(members[k][1].lower().split()) for k in keys]
            sides = np.array([members[k][0] for k in keys])
            for i, j in linked(sets, sides, across, link):
                a.append(keys[i])
                b.append(keys[j])
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def near_classes(docs: DataFrame, rows: DataFrame, link: int = LINK, block: int = BLOCK) -> DataFrame:
    """(key, component): the classes of equal words in components of two classes or more.

    `docs` has doc_id, text and text_hash, and `rows` the signatures of the same rows.
    """
    edges = candidate_tasks(docs, rows, block).groupBy("task", "lo", "hi").applyInArrow(
        lambda table: verify(table, link), "a binary, b binary"
    )
    return components(edges, "links").withColumnRenamed("node", "key")


def candidate_tasks(docs: DataFrame, rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The texts that a task (task, lo, hi) compares: one of each class of its candidate groups."""
    classes = stored(
        rows.where("n_shingles > 0")
        .groupBy("key")
        .agg(F.min(F.struct("text_hash", "doc_id")).alias("one"), F.min("n_shingles").alias("n"),
             F.first("bands").alias("bands"))
        .select("key", F.xxhash64("key").alias("node"), "one.*", "n", "bands"),
        "classes",
    )
    banded = classes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("z"))
    pairs = banded.join(shared.where("a < z"), "band").select("a", F.col("node").alias("b"))
    groups = components(pairs, "candidates").withColumnRenamed("component", "grp")
    members = stored(classes.drop("bands").join(groups, "node"), "members")
    sizes = members.groupBy("grp").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    large = sizes.where(F.col("m") > block).select(
        "grp", F.ceil(F.col("m") / block).cast("int").alias("blocks")
    )
    total = members.agg(F.sum("n")).first()[0] or 0
    bins = partitions_for(total, TASK_SHINGLES)
    spread = members.join(large, "grp", "left").withColumn(
        "side", F.pmod(F.xxhash64("key", F.lit(3)), F.coalesce("blocks", F.lit(1))).cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    placed = spread.withColumn("other", other).select(
        "doc_id", "text_hash", "key", "grp", "side",
        F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("grp"), F.lit(bins)))
        .otherwise(F.col("grp")).alias("task"),
        F.when(F.col("blocks").isNull(), -1).otherwise(F.least("side", "other")).alias("lo"),
        F.when(F.col("blocks").isNull(), -1).otherwise(F.greatest("side", "other")).alias("hi"),
    )
    # a class has one row: equal rows are one before any text moves
    texts = docs.groupBy(F.struct("doc_id", "text_hash").alias("row")).agg(
        F.first("text").alias("text")
    )
    # the hash is never null; saying so gives both sides one type, and their join one shuffle
    hashed = F.coalesce("text_hash", F.lit(0).cast("long")).alias("text_hash")
    placed = placed.withColumn("row", F.struct("doc_id", hashed))
    return placed.join(texts, "row").select("task", "lo", "hi", "grp", "side", "key", "text")


def near_duplicates(docs: DataFrame, link: int = LINK) -> DataFrame:
    """Per row: doc_id, text_hash, n_shingles, component_id, kept, and `one`: whether it has the
    doc_id and text that stand for its component (the smallest doc_id, nulls last)."""
    base = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    rows = stored(signed(base).drop("text"), "signatures")
    found = near_classes(base, rows, link)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash"))
    classes = (
        rows.where("n_shingles > 0")
        .groupBy("key")
        .agg(first.alias("f"), F.count("*").alias("rows_of_key"))
        .join(found, "key", "left")
        .select("key", "f", "rows_of_key", F.coalesce("component", "key").alias("component"))
    )
    classes = stored(classes, "components")
    lowest = classes.groupBy("component").agg(F.min("f").alias("f"), F.count("*").alias("rows_of"))
    named = stored(
        join_counted(classes.drop("f"), lowest, "component").select(
            "key", "rows_of_key", F.col("f.doc_id").alias("component_id"),
            F.col("f.text_hash").alias("one_hash"),
        ),
        "named",
    )
    named = named.withColumnRenamed("rows_of_key", "rows_of")
    full = join_counted(rows.where("n_shingles > 0"), named, "key").select(
        "doc_id", "text_hash", "n_shingles", "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"),
        (F.col("doc_id").eqNullSafe(F.col("component_id"))
         & (F.col("text_hash") == F.col("one_hash"))).alias("one"),
    )
    empty = rows.where("n_shingles = 0").select(
        "doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"),
        F.col("doc_id").isNotNull().alias("kept"), F.lit(True).alias("one"),
    )
    return full.unionByName(empty)


def keep_one(docs: DataFrame, link: int = LINK) -> DataFrame:
    """`docs` with one row of each component; of repeated rows one stays."""
    found = near_duplicates(docs, link).where("one")
    chosen = found.groupBy("doc_id", "text_hash").agg(
        F.max(F.when(F.col("n_shingles") > 0, F.lit(1)).otherwise(0)).alias("_full"),
        F.count("*").alias("_n"),
    ).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_full", "_n")
    hashed = docs.withColumn("_text_hash", F.xxhash64("text"))
    rows = hashed.join(
        chosen,
        (F.col("_text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")),
    )
    single = (F.col("_n") == 1) | (F.col("_full") == 0)
    repeated = rows.where(~single).dropDuplicates(["_id", "_hash"])
    return rows.where(single).unionByName(repeated).select(*(f"`{c}`" for c in docs.columns))
