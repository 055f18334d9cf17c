"""The prefix trie of conversations, rolled up by pointer jumping.

Turns become narrow rows (conversation, place, digest, code points). Places and prefix digests are running
sums over range partitions, so a conversation with a third of all turns still spreads: the digest of a
prefix is the sum, in four lanes of 32 bits, of a hash of each (place, turn) in it. Equal digests
are one node, named by its depth and the least conversation in it; a digest less its last term is the
parent's, which gives the parent edges.

Leaf counts and savings go to all ancestors in about log2(depth) rounds. After round k a node holds the sums
of its descendants less than 2**k below and a pointer 2**k up; each round adds a node's sums to what
it points at and doubles the pointer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosodia.llm.shared import materialize, running_sums, shuffle_width

LANES = ("a", "b", "c", "e")
#: Bytes of ids that travel as one piece.
PIECE = 1 << 20


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest, chars of every turn with a conv_id, in order of turn (null first).

    Turns of equal number are in order of their digest, so that row order never matters; null role and
    text are empty. Repeated rows are turns of their own.
    """
    role, said = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role), F.lit(":"), role, said)))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(said).cast("long").alias("chars"), F.lit(1).cast("long").alias("one"))
    return materialize(running_sums(rows, ["conv_id", "turn", "digest"], {"pos": "one"}, group="conv_id").select("conv_id", "pos", "digest", "chars"), "turns")


def grafted(own: DataFrame, base: Column, head: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first ``head`` turns are those of conversation ``base``, as far as it has them.

    base, head: expressions of conv_id. Returns all conversations (conv_id, size), turnless ones too, and
    their turns (conv_id, pos, digest, chars, last). A base turn is copied once for each conversation that
    takes it.
    """
    known = materialize(own.groupBy("conv_id").agg(F.max("pos").alias("own")).withColumn("base", base.cast("long")).withColumn("head", head.cast("long")), "convs")
    sizes = known.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    taken = F.least("head", F.coalesce("there", F.lit(0)))
    plan = known.join(sizes, "base", "left").withColumn("taken", taken).withColumn("size", F.col("taken") + F.greatest(F.col("own") - F.col("head"), F.lit(0)))
    plan = materialize(plan.select("conv_id", "base", "head", "taken", "size"), "plan")
    tail = own.join(plan.select("conv_id", "head", "taken", "size"), "conv_id").filter(F.col("pos") > F.col("head")).withColumn("pos", F.col("pos") - F.col("head") + F.col("taken"))
    copies = plan.filter("taken > 0").select("conv_id", "base", "size", F.explode(F.sequence(F.lit(1), F.col("taken"))).alias("pos"))
    first = own.select(F.col("conv_id").alias("base"), "pos", "digest", "chars")
    front = copies.join(first, ["base", "pos"])
    columns = ["conv_id", "pos", "digest", "chars", (F.col("pos") == F.col("size")).alias("last")]
    return plan.select("conv_id", "size"), tail.select(*columns).unionByName(front.select(*columns))


def _key(lanes: list[Column]) -> tuple[Column, Column]:
    """Two longs of four lanes, each modulo 2**32."""
    low = [x.bitwiseAND(F.lit(0xFFFFFFFF)) for x in lanes]
    return F.shiftleft(low[0], 32).bitwiseOR(low[1]), F.shiftleft(low[2], 32).bitwiseOR(low[3])


def prefixes(rows: DataFrame) -> DataFrame:
    """Each turn with the digest of the prefix that it ends (k1, k2) and of the one before (p1, p2)."""
    word = F.md5(F.concat(F.col("pos").cast("string"), F.lit(":"), F.hex("digest")))
    terms = [F.conv(F.substring(word, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"x{x}") for i, x in enumerate(LANES)]
    summed = running_sums(rows.select("conv_id", "pos", "chars", "last", *terms), ["conv_id", "pos"], {x: f"x{x}" for x in LANES}, group="conv_id")
    k1, k2 = _key([F.col(x) for x in LANES])
    p1, p2 = _key([F.col(x) - F.col(f"x{x}") for x in LANES])
    return summed.select("conv_id", F.col("pos").alias("depth"), "chars", "last", k1.alias("k1"), k2.alias("k2"), p1.alias("p1"), p2.alias("p2"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (depth, k1, k2, conv_id) in order -> the ids of each node of this partition, comma-joined, in pieces."""
    from pyspark import TaskContext

    pid, now, ids, size, part, out = TaskContext.get().partitionId(), None, [], 0, 0, []

    def flush() -> None:
        nonlocal ids, size, part
        out.append((*now, pid, part, ",".join(ids)))
        ids, size, part = [], 0, part + 1

    def emit() -> pa.RecordBatch:
        kinds = [pa.int64()] * 3 + [pa.int32(), pa.int32(), pa.string()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["depth", "k1", "k2", "pid", "part", "ids"])
        out.clear()
        return batch

    for batch in batches:
        for *node, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if node != now:
                if ids:
                    flush()
                now, part = node, 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
            if size >= PIECE:
                flush()
                yield emit()
        if out:
            yield emit()
    if ids:
        flush()
    if out:
        yield emit()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of each node in order -> the SHA-256 of all its ids; only its running state is held."""
    now, state = None, None
    done: list[tuple] = []
    emit = lambda: pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["depth", "k1", "k2", "ends"])
    for batch in batches:
        done = []
        for depth, k1, k2, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 5)), strict=True):
            if (depth, k1, k2) != now:
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = (depth, k1, k2), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield emit()
    if now is not None:
        done = [(*now, state.hexdigest())]
        yield emit()


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, k1, k2, ends: SHA-256 of the ascending, comma-joined conv_ids of (depth, k1, k2, conv_id) rows.

    Ids are joined where range partitions hold them, so a node with a third of all rows is a row or
    few a partition to the task that digests it.
    """
    width = shuffle_width(ends.sparkSession)
    keys = ["depth", "k1", "k2", "conv_id"]
    parts = ends.select(*keys).repartitionByRange(width, *keys).sortWithinPartitions(*keys).mapInArrow(_pieces, "depth long, k1 long, k2 long, pid int, part int, ids string")
    sorted_ = parts.repartition(width, *keys[:3]).sortWithinPartitions(*keys[:3], "pid", "part")
    return sorted_.mapInArrow(_digests, "depth long, k1 long, k2 long, ends string")


def rolled_up(nodes: DataFrame, root: int, deepest: int) -> DataFrame:
    """conv, depth and the sums of ``leaves`` and ``saved`` over each node's subtree, itself included.

    nodes: conv, depth, up (the parent's conv; null at the root), leaves, saved.
    """
    now, step = nodes, 1
    while step <= deepest:
        given = now.filter("up is not null").select(F.col("up").alias("conv"), (F.col("depth") - step).alias("depth"), F.lit(None).cast("long").alias("up"), "leaves", "saved")
        summed = now.unionByName(given).groupBy("conv", "depth").agg(F.max("up").alias("up"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        if 2 * step > deepest:
            return summed.drop("up")
        # what points at the root or stands less deep needs no look-up
        deep = F.col("depth") > 2 * step
        target = summed.filter(F.col("depth") > step).select(F.col("conv").alias("up"), (F.col("depth") + step).alias("depth"), F.col("up").alias("next"))
        moved = summed.filter(deep).join(target, ["up", "depth"]).select("conv", "depth", F.col("next").alias("up"), "leaves", "saved")
        still = summed.filter(~deep).withColumn("up", F.when(F.col("depth") == 2 * step, F.lit(root)).cast("long"))
        now = materialize(moved.unionByName(still.select(*moved.columns)), "jumped")
        step *= 2
    return now.drop("up")


def trie(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """The nodes of all conversations (conv_id, size), with their turns (conv_id, pos, digest, chars, last).

    conv_id (the least member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves (of the
    subtree), saved_tokens (over the subtree, (n_convs - 1) times the code points of a node's last
    turn), ends_sha256 (of the ids that end there). Nodes with the same 128-bit digest are one. Without
    conversations there are no nodes, not even the root.
    """
    spark = convs.sparkSession
    whole = convs.agg(F.min("conv_id").alias("root"), F.max("size").alias("deepest")).first()
    if whole.root is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    zero = F.lit(0).cast("long")
    top = convs.select("conv_id", zero.alias("depth"), zero.alias("chars"), (F.col("size") == 0).alias("last"), zero.alias("k1"), zero.alias("k2"), zero.alias("p1"), zero.alias("p2"))
    members = materialize(prefixes(rows).unionByName(top), "members")
    found = members.groupBy("depth", "k1", "k2").agg(F.min("conv_id").alias("conv"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    found = materialize(found.join(end_digests(members.filter("last")), ["depth", "k1", "k2"], "left"), "nodes")
    parents = found.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("up"))
    below = found.filter("depth > 0").join(parents, ["depth", "p1", "p2"]).select("conv", "depth", "up", "n_convs", "chars", "ends")
    edges = materialize(below.unionByName(found.filter("depth = 0").select("conv", "depth", F.lit(None).cast("long").alias("up"), "n_convs", "chars", "ends")), "parents")
    nothing = [F.lit(None).cast(kind).alias(c) for c, kind in (("up", "long"), ("n_convs", "long"), ("chars", "long"), ("ends", "string"))]
    children = edges.filter("depth > 0").select(F.col("up").alias("conv"), (F.col("depth") - 1).alias("depth"), *nothing, F.lit(1).alias("child"))
    counted = edges.withColumn("child", F.lit(0)).unionByName(children).groupBy("conv", "depth").agg(*[F.max(c).alias(c) for c in ("up", "n_convs", "chars", "ends")], F.sum("child").alias("n_children"))
    counted = materialize(counted, "counted")
    start = counted.select("conv", "depth", "up", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    sums = rolled_up(start, whole.root, whole.deepest)
    out = counted.join(sums, ["conv", "depth"])
    ends = F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest()))
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), "n_convs", F.col("n_children").cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), ends.alias("ends_sha256"))
