"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations.

A unit vector is rotated by three rounds of random signs and a Hadamard transform; its code is the
largest coordinate, with sign. A table joins the codes of FUNCTIONS rotations into a bucket. Every
vector lies in its own bucket of each of the TABLES tables and probes the buckets in which one code
is the second largest coordinate. Where two meet, their cosine is taken in double precision.

Equal vectors of a label are one class and compared once; links are counted by class sizes. A pair
counts in the first bucket where it meets, so what a bucket gives is one count and one edge per
class, never its pairs. Buckets above BLOCK classes are cut into blocks, two to a task.

Vectors are compared within equal labels only. Null, empty and zero vectors, ones with null or
non-finite components and ones without a label link with nothing; nor do vectors of different
lengths. Repeated rows are copies of each other; a component takes its smallest vec_id, nulls left
aside. Empty tables give no rows; only vec_id, embedding and label are read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from looptrace.llm.common import append, components, join_counted, partitions_for, stored

LINK = 0.98
TABLES, FUNCTIONS = 8, 2
PROBES = 1 + FUNCTIONS  # buckets of a table that a vector is in: its own, then the probed ones
BLOCK = 1500  # classes of a bucket that a task takes in one block
TASK_ROWS = 20_000  # rows of small buckets that go to one task, about
SENT_BUCKETS = 100_000  # large buckets, known by number and blocks, that are sent to every task
SEED = 20
CODE = np.int32 if FUNCTIONS <= 2 else np.int64  # holds FUNCTIONS codes of up to 2**15 entries
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=64)
def signs(size: int, table: int, function: int) -> np.ndarray:
    draw = np.random.default_rng([SEED, size, table, function])
    return draw.choice(np.array([-1.0, 1.0], np.float32), (3, size))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast transform of each row; rows have a power of two of entries."""
    n = x.shape[1]
    step = 1
    while step < n:
        x = x.reshape(len(x), -1, 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2)
        step *= 2
        x = x.reshape(-1, n)
    return x / np.float32(np.sqrt(n))


def codes(unit: np.ndarray) -> np.ndarray:
    """[vectors, TABLES, PROBES] numbers of the buckets, the own one first."""
    size = max(2, 1 << (unit.shape[1] - 1).bit_length())
    start = np.zeros((len(unit), size), np.float32)
    start[:, : unit.shape[1]] = unit
    rows = np.arange(len(unit))
    out = np.zeros((len(unit), TABLES, PROBES), CODE)
    for t in range(TABLES):
        best, second = [], []
        for f in range(FUNCTIONS):
            x = start
            for s in signs(size, t, f):
                x = hadamard(x * s)
            big = np.abs(x)
            for found in (best, second):
                at = big.argmax(1)
                found.append(2 * at + (x[rows, at] < 0))
                big[rows, at] = -1
        for p in range(PROBES):
            number = np.zeros(len(unit), np.int64)
            for f in range(FUNCTIONS):
                number = number * (2 * size) + (second[f] if p == f + 1 else best[f])
            out[:, t, p] = number
    return out


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def hashed(docs: DataFrame) -> DataFrame:
    """`docs` (vec_id, embedding, label_key, valid) with the class key, the vector's bytes, and the
    bucket numbers of the valid ones."""
    fields = [
        T.StructField("key", T.BinaryType()),
        T.StructField("raw", T.BinaryType()),
        T.StructField("codes", T.BinaryType()),
    ]

    def build(embedding: pa.Array, label: pa.Array, valid: pa.Array) -> list[pa.Array]:
        n = len(embedding)
        keys: list = [None] * n
        raws: list = [None] * n
        coded: list = [None] * n
        ok = np.flatnonzero(np.array(valid.to_pylist(), bool))
        by_size: dict[int, list[int]] = {}
        for i in ok:
            by_size.setdefault(len(embedding[i]), []).append(int(i))
        labels = label.to_pylist()
        for size, members in by_size.items():
            flat = embedding.take(pa.array(members)).flatten().to_numpy(zero_copy_only=False)
            vectors = flat.reshape(len(members), size) + 0.0  # no negative zeros
            found = codes(unit_rows(vectors))
            for i, vector, c in zip(members, vectors, found):
                raws[i] = vector.tobytes()
                keys[i] = xxhash.xxh3_128_digest(labels[i].to_bytes(8, "little", signed=True)
                                                 + raws[i])
                coded[i] = c.tobytes()
        return [pa.array(x, pa.binary()) for x in (keys, raws, coded)]

    return append(docs, fields, build, ("embedding", "label_key", "valid"))


def bucket_rows(classes: DataFrame, only_buckets: bool = False) -> DataFrame:
    """A row per class, table and bucket: bucket, table, own, and the class's key, raw, codes, m."""

    def explode(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            c = np.frombuffer(b"".join(batch.column(2).to_pylist()), CODE).astype(np.uint64)
            c = c.reshape(n, TABLES, PROBES)
            salt = np.array(batch.column(3).to_pylist(), np.int64).view(np.uint64)
            salt = salt ^ np.array([len(r) for r in batch.column(1).to_pylist()], np.uint64)
            at = np.arange(TABLES, dtype=np.uint64)[None, :, None]
            hashes = (c * np.uint64(64) + at) * MULTIPLIER
            hashes = ((hashes ^ (hashes >> np.uint64(31))) + salt[:, None, None]) * MULTIPLIER
            if only_buckets:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64).ravel())], names=["bucket"]
                )
                continue
            for t in range(TABLES):
                for p in range(PROBES):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(hashes[:, t, p].view(np.int64)),
                         pa.array(np.full(n, t, np.int32)), pa.array(np.full(n, p == 0)),
                         *(batch.column(k) for k in range(5))],
                        names=["bucket", "table", "own", "key", "raw", "codes", "label_key", "m"],
                    )

    return classes.select("key", "raw", "codes", "label_key", "m").mapInArrow(
        explode,
        "bucket long" if only_buckets else
        "bucket long, table int, own boolean, key binary, raw binary, codes binary,"
        " label_key long, m long",
    )


def meets(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of codes, by table: whether a's own bucket is among b's, and b's among a's."""
    return (a[:, :, :1] == b).any(2), (b[:, :, :1] == a).any(2)


def bucket_links(part: dict, dtype, link: float, across: bool) -> list[tuple[bytes, bytes, int]]:
    """(class, smallest class it is joined to here, members of the classes it is linked with) for
    one bucket, or across two blocks of one; only pairs that first meet here count."""
    label = np.array(part["label_key"])
    side = np.array(part["side"])
    found = []
    for one in np.unique(label):
        for length in {len(r) for r, x in zip(part["raw"], label) if x == one}:
            own = [i for i in np.flatnonzero(label == one) if len(part["raw"][i]) == length]
            if len(own) > 1:
                found += _links({k: [v[i] for i in own] for k, v in part.items()},
                                side[own], dtype, link, across)
    return found


def _links(part: dict, side: np.ndarray, dtype, link: float, across: bool) -> list[tuple[bytes, bytes, int]]:
    n = len(side)
    vectors = unit_rows(np.frombuffer(b"".join(part["raw"]), dtype).reshape(n, -1))
    coded = np.frombuffer(b"".join(part["codes"]), CODE).reshape(n, TABLES, PROBES)
    own = np.array(part["own"])
    table = part["table"][0]
    near = vectors @ vectors.T >= link
    near &= own[:, None] | own
    if across:
        near &= side[:, None] != side
    a, b = np.nonzero(np.triu(near, 1))
    keep = np.zeros(len(a), bool)
    for k in range(0, len(a), 200_000):
        x, y = a[k : k + 200_000], b[k : k + 200_000]
        one, other = meets(coded[x], coded[y])
        earlier = (one | other)[:, :table].any(1)
        mine, theirs = coded[x, table, 0], coded[y, table, 0]
        # of two buckets of this table in which they meet, the one of the smaller number counts
        here = np.where(own[x], mine, theirs)
        twice = one[:, table] & other[:, table] & (mine != theirs)
        keep[k : k + 200_000] = ~earlier & (~twice | (here == np.minimum(mine, theirs)))
    a, b = a[keep], b[keep]
    if not len(a):
        return []
    m = np.array(part["m"], np.int64)
    links = np.bincount(a, m[b], n) + np.bincount(b, m[a], n)
    keys = part["key"]
    lowest = np.arange(n)
    while True:
        new = lowest.copy()
        np.minimum.at(new, a, lowest[b])
        np.minimum.at(new, b, lowest[a])
        new = new[new]
        if (new == lowest).all():
            break
        lowest = new
    return [(keys[i], keys[lowest[i]], int(links[i])) for i in np.flatnonzero(links)]


def class_links(classes: DataFrame, dtype: str, link: float = LINK, block: int = BLOCK) -> DataFrame:
    """(key, other, links) parts: sum the links by key; key and other are joined."""
    sizes = bucket_rows(classes, only_buckets=True).groupBy("bucket").agg(F.count("*").alias("n"))
    large = stored(
        sizes.where(F.col("n") > block).select(
            "bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks")
        ),
        "large",
    )
    if large.count() <= SENT_BUCKETS:
        large = F.broadcast(large)
    rows = bucket_rows(classes)
    bins = partitions_for(classes.count() * TABLES * PROBES, TASK_ROWS)
    spread = (
        rows.join(large, "bucket", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("side", F.pmod(F.xxhash64("key", F.lit(3)), F.col("blocks")).cast("int"))
    )
    whole = F.col("blocks") == 1
    tasks = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.when(whole, F.pmod("bucket", F.lit(bins))).otherwise(F.col("bucket")).alias("task"),
        F.when(whole, -1).otherwise(F.least("side", "other")).alias("lo"),
        F.when(whole, -1).otherwise(F.greatest("side", "other")).alias("hi"),
        *rows.columns, "side",
    )

    def join(group: pa.Table) -> pa.Table:
        buckets = np.array(group["bucket"])
        order = np.argsort(buckets, kind="stable")
        columns = {c: group[c].take(pa.array(order)).to_pylist()
                   for c in ("table", "own", "key", "raw", "codes", "label_key", "m", "side")}
        cuts = np.flatnonzero(np.diff(buckets[order])) + 1
        across = group["lo"][0].as_py() < group["hi"][0].as_py()
        found = []
        for s, e in zip([0, *cuts], [*cuts, len(order)]):
            if e - s < 2:
                continue
            found += bucket_links({c: v[s:e] for c, v in columns.items()}, dtype, link, across)
        return pa.table({
            "key": pa.array([f[0] for f in found], pa.binary()),
            "other": pa.array([f[1] for f in found], pa.binary()),
            "links": pa.array([f[2] for f in found], pa.int64()),
        })

    return stored(
        tasks.groupBy("task", "lo", "hi").applyInArrow(
            join, "key binary, other binary, links long"
        ),
        "links",
    )


def near_vectors(docs: DataFrame, link: float = LINK) -> DataFrame:
    """Per row: vec_id, n_links, component_id and kept."""
    kind = docs.schema["embedding"].dataType.elementType
    dtype = "<f4" if isinstance(kind, T.FloatType) else "<f8"
    if not isinstance(kind, (T.FloatType, T.DoubleType)):
        docs = docs.withColumn("embedding", F.col("embedding").cast("array<double>"))
    finite = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    valid = F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    base = docs.select(
        "vec_id", "embedding", F.xxhash64("label").alias("label_key"),
        F.coalesce(valid, F.lit(False)).alias("valid"),
    )
    rows = stored(hashed(base).drop("embedding"), "vectors")
    good = rows.where("valid")
    classes = stored(
        good.groupBy("key").agg(
            F.count("*").alias("m"), F.min("vec_id").alias("low"),
            F.first("raw").alias("raw"), F.first("codes").alias("codes"),
            F.first("label_key").alias("label_key"),
        ),
        "classes",
    )
    parts = class_links(classes, dtype, link)
    counts = parts.groupBy("key").agg(F.sum("links").alias("links"))
    joined = components(parts.select(F.col("key").alias("a"), F.col("other").alias("b")), "joined")
    named = (
        classes.select("key", "m", "low")
        .join(counts, "key", "left")
        .join(joined.withColumnRenamed("node", "key"), "key", "left")
        .withColumn("component", F.coalesce("component", "key"))
    )
    named = stored(named, "components")
    lowest = named.groupBy("component").agg(
        F.min("low").alias("component_id"), F.count("*").alias("rows_of")
    )
    per_class = join_counted(named, lowest, "component").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id",
        F.col("m").alias("rows_of"),
    )
    linked = join_counted(good, per_class, "key").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT valid").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )
