"""The trie of conversations' first turns, with what each subtree would save if shared turns were
stored once.

A node stands for a sequence of first turns (role and text); its members are the conversations that
start with it. Sequences are known by the exclusive or of hashes of (depth, role, text), two of 64
bits made from SHA-256: such a hash is a running one, which slices of a long conversation hand on,
and the parent's is the node's own without its last turn. A node's name is its smallest member and
its depth.

Subtree sums come from an Euler tour: every node has an enter and an exit arc, children are visited
by their smallest members, and the tour is a linked list. It is ranked by contraction: tasks join the
arcs that follow each other within the task into one, and go on with those until few are left; then
offsets are added on the way back. Tasks take the arcs of neighbouring names at first, as most arcs
follow their neighbours, and pairs drawn by hash at every second step, so that a quarter goes
whatever the tree looks like. Leaves and savings of a subtree are the differences of the prefix sums
at its two arcs.

Turns are ordered by number, null first, equal numbers by a hash of role and text. Null role or text
counts as empty; rows without conv_id take no part; repeated rows are turns each. Texts of any length
count in full. A conversation or a node's members may hold any share of all rows: nothing gathers
them, but for one pass that hashes the sorted ids of those that end at one node, in pieces made
beforehand. An empty table gives no rows, other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from looptrace.llm.common import join_counted, partitions_for
from looptrace.operators.slices import previous, running_sum, sliced, with_carry
from looptrace.session import stored

ARCS = 250_000  # arcs that a task joins
FEWEST = 1_000  # of them, if there are enough tasks
SHARED = 8  # first turns that a conversation may share, in `rebuilt`
SUMS = ("n", "leaves", "saved")
EMPTY = hashlib.sha256().hexdigest()


def fingerprints(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, a, b, row_no, bytes): every turn, its role and text as two numbers."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat_ws(":", F.length(role), role, text), 256)

    def number(start: int) -> Column:
        return F.conv(F.substring(digest, start, 15), 16, 10).cast("long")

    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        number(1).alias("a"),
        number(16).alias("b"),
        F.monotonically_increasing_id().alias("row_no"),
        F.octet_length(text).cast("long").alias("bytes"),
    )


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and ids of conversations that share their starts: conversation c has the first h turns of
    c - c % 5, then its own after its first h, where h is crc32(c) % 9."""
    turns = fingerprints(conversations).withColumn("one", F.lit(1))
    numbered = stored(
        running_sum(turns, "conv_id", ["turn", "a", "b", "row_no"], "one", "at").select(
            "conv_id", "at", "a", "b", "bytes"
        ),
        "turns",
    )
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED + 1)
    ids = stored(numbered.select("conv_id").distinct(), "ids")
    starts = numbered.where((F.col("at") <= SHARED) & (F.col("conv_id") % 5 == 0))
    asked = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"),
                       shared.alias("h"))
    first = asked.where("h > 0").join(
        starts.withColumnRenamed("conv_id", "base"), "base"
    ).where("at <= h")
    columns = ("conv_id", "part", "at", "a", "b", "bytes")
    own = numbered.where(F.col("at") > shared).withColumn("part", F.lit(1))
    return first.withColumn("part", F.lit(0)).select(*columns).union(own.select(*columns)), ids


def prefixes(turns: DataFrame, order: list[str]) -> DataFrame:
    """(conv_id, depth, x, y, px, py, bytes): every prefix of every conversation and its parent."""
    cut = sliced(turns, "conv_id", order)
    within = Window.partitionBy("conv_id", "_slice").orderBy(*order)
    before = (Window.unboundedPreceding, -1)
    counted = with_carry(
        cut,
        cut.withColumn("_at", F.row_number().over(within)),
        "conv_id",
        F.count("*").alias("_n"),
        lambda w: F.sum("_n").over(w.rowsBetween(*before)),
    )
    depth = F.col("_at") + F.coalesce("_carry", F.lit(0))
    hashed = counted.select(
        "conv_id",
        "_slice",
        "bytes",
        depth.cast("long").alias("depth"),
        F.xxhash64(depth, "a", "b").alias("f"),
        F.xxhash64("b", depth, "a").alias("g"),
    )
    along = Window.partitionBy("conv_id", "_slice").orderBy("depth")

    def handed(w: Window) -> Column:
        x, y = (F.bit_xor(f"_x.{c}").over(w.rowsBetween(*before)) for c in "fg")
        return F.when(x.isNotNull(), F.struct(x.alias("f"), y.alias("g")))

    run = along.rowsBetween(Window.unboundedPreceding, 0)
    summed = with_carry(
        hashed,
        hashed.withColumn("x", F.bit_xor("f").over(run)).withColumn("y", F.bit_xor("g").over(run)),
        "conv_id",
        F.struct(F.bit_xor("f").alias("f"), F.bit_xor("g").alias("g")).alias("_x"),
        handed,
    )
    x = F.col("x").bitwiseXOR(F.coalesce("_carry.f", F.lit(0)))
    y = F.col("y").bitwiseXOR(F.coalesce("_carry.g", F.lit(0)))
    return summed.select(
        "conv_id",
        "depth",
        x.alias("x"),
        y.alias("y"),
        x.bitwiseXOR(F.col("f")).alias("px"),
        y.bitwiseXOR(F.col("g")).alias("py"),
        "bytes",
    )


def nodes_of(steps: DataFrame, ids: DataFrame) -> DataFrame:
    """(depth, x, y, px, py, conv_id, n_convs, saved, n_children, first_child): one row per node."""
    members = (F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    parents = (F.min("px").alias("px"), F.min("py").alias("py"), F.max("bytes").alias("bytes"))
    nodes = steps.groupBy("depth", "x", "y").agg(*members, *parents)
    root = ids.agg(*members).where("n_convs > 0").select(
        *(F.lit(0).cast("long").alias(c) for c in ("depth", "x", "y")), "conv_id", "n_convs",
        *(F.lit(None).cast("long").alias(c) for c in ("px", "py")),
        F.lit(0).cast("long").alias("bytes"),
    )
    nodes = stored(
        nodes.unionByName(root).withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")), "nodes"
    )
    children = (
        nodes.where("depth > 0")
        .groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y"))
        .agg(F.count("*").alias("n_children"), F.min("conv_id").alias("first_child"))
    )
    return stored(
        nodes.join(children, ["depth", "x", "y"], "left").fillna(0, ["n_children"]), "nodes"
    )


def with_neighbours(nodes: DataFrame) -> DataFrame:
    """`nodes` with parent_conv_id and next_sibling, by name; null: none."""
    parents = nodes.where("n_children > 0").select(
        F.struct("depth", "x", "y").alias("key"),
        F.col("conv_id").alias("parent_conv_id"),
        F.col("n_children").alias("rows_of"),
    )
    key = F.struct((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y"))
    children = nodes.where("depth > 0").select(
        key.alias("key"), "conv_id", "depth", "x", "y", "n_convs", "saved", "n_children", "first_child"
    )
    named = join_counted(children, parents, "key").withColumn("down", F.bitwise_not("conv_id"))
    beside = previous(named, "key", ["down"], ["conv_id"])
    beside = beside.withColumn("next_sibling", F.col("prev.conv_id")).drop("prev", "down", "key")
    return beside.unionByName(nodes.where("depth = 0").drop("px", "py", "bytes"), True)


def arcs_of(tree: DataFrame) -> DataFrame:
    """(conv, code, next_conv, next_code, n, leaves, saved): the tour; the code of the enter arc is
    twice the depth, that of the exit arc one more."""
    leaf = F.col("n_children") == 0
    code = F.col("depth") * 2

    def arc(own: Column, conv: Column, follows: Column, leaves: Column, saved: Column) -> Column:
        return F.struct(
            F.col("conv_id").alias("conv"),
            own.alias("code"),
            conv.cast("long").alias("next_conv"),
            F.when(conv.isNotNull(), follows).cast("long").alias("next_code"),
            F.lit(1).cast("long").alias("n"),
            leaves.cast("long").alias("leaves"),
            saved.cast("long").alias("saved"),
        )

    enter = arc(
        code,
        F.when(leaf, F.col("conv_id")).otherwise(F.col("first_child")),
        F.when(leaf, code + 1).otherwise(code + 2),
        leaf,
        F.col("saved"),
    )
    on = F.col("next_sibling").isNotNull()
    leave = arc(
        code + 1,
        F.coalesce("next_sibling", "parent_conv_id"),
        F.when(on, code).otherwise(code - 1),
        F.lit(0),
        F.lit(0),
    )
    return tree.select(F.inline(F.array(enter, leave)))


def joined_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every arc the first one of its chain within the task, and the sums from there up to it; for
    first ones also the sums of the chain and what follows it."""
    parts = list(batches)
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    conv, code, n_conv, n_code = (
        table[c].combine_chunks().fill_null(-1).to_numpy() for c in ("conv", "code", "next_conv", "next_code")
    )
    values = np.stack([table[c].to_numpy() for c in SUMS])
    rows = len(conv)
    _, place = np.unique(np.concatenate([conv, n_conv]), return_inverse=True)
    width = int(max(code.max(), n_code.max())) + 2
    own, following = (place[s] * width + c for s, c in ((slice(rows), code), (slice(rows, None), n_code)))
    order = np.argsort(own)
    found = order[np.minimum(np.searchsorted(own, following, sorter=order), rows - 1)]
    linked = (own[found] == following) & (n_code >= 0)
    head = np.arange(rows)
    head[found[linked]] = np.flatnonzero(linked)  # the arc before, if it is here
    before = np.where(head == np.arange(rows), 0, values[:, head])
    while True:
        further = head[head]
        if (further == head).all():
            break
        before += before[:, head]
        head = further
    total = np.zeros_like(values)
    end = np.flatnonzero(~linked)
    total[:, head[end]] = before[:, end] + values[:, end]
    last = np.arange(rows)
    last[head[end]] = end
    first = head == np.arange(rows)
    goes_on = first & (n_code[last] >= 0)
    columns = {"conv": conv, "code": code, "head_conv": conv[head], "head_code": code[head]}
    columns |= {f"{c}_before": before[i] for i, c in enumerate(SUMS)}
    columns |= {c: pa.array(total[i], mask=~first) for i, c in enumerate(SUMS)}
    columns["next_conv"] = pa.array(n_conv[last], mask=~goes_on)
    columns["next_code"] = pa.array(n_code[last], mask=~goes_on)
    yield pa.RecordBatch.from_pydict(columns)


CHAINS = "conv long, code long, head_conv long, head_code long, " + ", ".join(
    [f"{c}_before long" for c in SUMS] + [f"{c} long" for c in SUMS]
) + ", next_conv long, next_code long"


def _dealt(arcs: DataFrame, rows: int, step: int) -> DataFrame:
    """Arcs by neighbouring names, or every second time in pairs that a hash draws."""
    tasks = arcs.sparkSession.sparkContext.defaultParallelism
    parts = max(partitions_for(rows, ARCS), min(tasks, partitions_for(rows, FEWEST)))
    if step % 2 == 0:
        down = F.col("code") % 2 == 0
        place = F.when(down, F.col("code")).otherwise((1 << 62) - F.col("code"))
        return arcs.repartitionByRange(parts, "conv", place)

    def drawn(conv: str, code: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(step), conv, code), F.lit(2))

    joins = (drawn("conv", "code") == 0) & (drawn("next_conv", "next_code") == 1)
    return arcs.repartition(
        parts,
        F.when(joins, F.col("next_conv")).otherwise(F.col("conv")),
        F.when(joins, F.col("next_code")).otherwise(F.col("code")),
    )


def ranked(arcs: DataFrame) -> DataFrame:
    """(conv, code, n, leaves, saved): the sums over all arcs of the list before each arc."""
    levels, rows = [], arcs.count()
    while rows > ARCS or not levels:
        level = stored(_dealt(arcs, rows, len(levels)).mapInArrow(joined_chains, CHAINS), "chains")
        levels.append(level)
        arcs = level.where("n IS NOT NULL").select(
            "conv", "code", "next_conv", "next_code", *SUMS
        )
        rows = arcs.count()
    top = stored(arcs.coalesce(1).mapInArrow(joined_chains, CHAINS), "chains")  # ARCS at most
    sums = top.select("conv", "code", *(F.col(f"{c}_before").alias(c) for c in SUMS))
    for level in reversed(levels):
        heads = sums.select(
            F.col("conv").alias("head_conv"), F.col("code").alias("head_code"), *SUMS
        )
        below = level.drop(*SUMS, "next_conv", "next_code")
        sums = below.join(heads, ["head_conv", "head_code"]).select(
            "conv", "code", *((F.col(c) + F.col(f"{c}_before")).alias(c) for c in SUMS)
        )
    return sums


def _runs(table: pa.Table | pa.RecordBatch) -> list[tuple[tuple, int, int]]:
    """(key, start, end) of neighbouring rows with the same depth, x and y."""
    keys = np.stack([np.asarray(table.column(c)) for c in ("depth", "x", "y")])
    cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
    edges = [0, *cuts.tolist(), keys.shape[1]]
    return [(tuple(keys[:, a].tolist()), a, b) for a, b in zip(edges, edges[1:]) if a < b]


def ids_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids to comma-joined pieces per node."""
    for batch in batches:
        ids = batch.column("conv_id").to_pylist()
        runs = _runs(batch)
        yield pa.RecordBatch.from_pydict(
            {
                **{c: pa.array([r[0][i] for r in runs], pa.int64()) for i, c in enumerate(("depth", "x", "y"))},
                "first": pa.array([ids[a] for _, a, _ in runs], pa.int64()),
                "ids": pa.array([",".join(map(str, ids[a:b])) for _, a, b in runs], pa.string()),
            }
        )


def ids_hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's pieces, joined by commas; one piece after the other."""

    def rows(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done)) or [()] * 4
        values = [pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(columns[3], pa.string())]
        return pa.RecordBatch.from_arrays(values, names=["depth", "x", "y", "ends_sha256"])

    now, state = None, None
    for batch in batches:
        pieces, done = batch.column("ids"), []
        for key, a, b in _runs(batch):
            if key != now:
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(",".join(pieces.slice(a, b - a).to_pylist()).encode())
        yield rows(done)
    if now is not None:
        yield rows([(*now, state.hexdigest())])


def ends_hashed(steps: DataFrame, ids: DataFrame) -> DataFrame:
    """(depth, x, y, ends_sha256) of the nodes at which conversations end."""
    last = steps.groupBy("conv_id").agg(F.max_by(F.struct("depth", "x", "y"), "depth").alias("at"))
    key = [F.coalesce(f"at.{c}", F.lit(0).cast("long")).alias(c) for c in ("depth", "x", "y")]
    ends = ids.join(last, "conv_id", "left").select(*key, "conv_id")
    by = ["depth", "x", "y"]
    pieces = ends.repartitionByRange(*by, "conv_id").sortWithinPartitions(*by, "conv_id").mapInArrow(
        ids_joined, "depth long, x long, y long, first long, ids string"
    )
    return pieces.repartition(*by).sortWithinPartitions(*by, "first").mapInArrow(
        ids_hashed, "depth long, x long, y long, ends_sha256 string"
    )


def prefix_trie(turns: DataFrame, order: list[str], ids: DataFrame) -> DataFrame:
    """One row per node of the trie of `turns` (conv_id, a, b, bytes, in `order`) of the conversations
    `ids`: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (bytes of shared turns' repeats, over the subtree), ends_sha256, and the positions of
    its arcs in the tour."""
    steps = stored(prefixes(turns, order), "prefixes")
    tree = stored(with_neighbours(nodes_of(steps, ids)), "tree")
    enters = F.col("code") % 2 == 0

    def apart(column: str) -> Column:
        return F.sum(F.when(enters, -F.col(column)).otherwise(F.col(column)))

    sums = (
        ranked(arcs_of(tree))
        .groupBy(F.col("conv").alias("conv_id"), F.floor(F.col("code") / 2).alias("depth"))
        .agg(
            apart("leaves").alias("n_leaves"),
            apart("saved").alias("saved_tokens"),
            F.max(F.when(enters, F.col("n"))).alias("enters_at"),
            F.max(F.when(~enters, F.col("n"))).alias("leaves_at"),
        )
    )
    return (
        tree.join(sums, ["conv_id", "depth"])
        .join(ends_hashed(steps, ids), ["depth", "x", "y"], "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            F.col("n_children").cast("long").alias("n_children"),
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
            "enters_at",
            "leaves_at",
        )
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they are."""
    turns = stored(fingerprints(conversations), "turns")
    ids = stored(turns.select("conv_id").distinct(), "ids")
    return prefix_trie(turns, ["turn", "a", "b", "row_no"], ids)


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations that share their starts, see `rebuilt`."""
    turns, ids = rebuilt(conversations)
    return prefix_trie(turns, ["part", "at"], ids)
