"""Shards along a Hilbert curve over document metadata, for multidimensional file pruning.

Three dimensions (source, language, size) are quantised to a few bits each; rows are ordered by
their cell's index on the Hilbert curve and the order is cut into runs of equal row counts. Cells
that are near on the curve are near in every dimension, so a shard covers a compact box and a
predicate on any dimension prunes shards by the minima and maxima of ``shard_bounds``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosodia.llm.shared import running_sums

BITS = 5


def hilbert_index(coordinates: list[Column], bits: int = BITS) -> Column:
    """The index on a Hilbert curve of a cell with the given non-negative coordinates below 2**bits.

    Skilling's transform from axes to the transposed index, as folds over arrays inside the JVM.
    """
    d = len(coordinates)
    axes = F.array(*[c.cast("long") for c in coordinates])
    steps = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(d)])

    def undo(x: Column, s: Column) -> Column:
        p, at = s["q"] - 1, s["i"]
        own = F.get(x, at)
        swap = F.get(x, F.lit(0)).bitwiseXOR(own).bitwiseAND(p)
        hit = own.bitwiseAND(s["q"]) != 0
        flip = lambda v, k: F.when(k == 0, F.when(hit, v.bitwiseXOR(p)).otherwise(v.bitwiseXOR(swap))).when(k == at, F.when(hit, v).otherwise(v.bitwiseXOR(swap))).otherwise(v)
        return F.transform(x, flip)

    x = F.aggregate(steps, axes, undo)
    # Gray encode: each axis takes the exclusive or of itself and all before it
    x = F.aggregate(F.array(*[F.lit(i) for i in range(1, d)]), x, lambda a, i: F.transform(a, lambda v, k: F.when(k == i, v.bitwiseXOR(F.get(a, i - 1))).otherwise(v)))
    last = F.get(x, F.lit(d - 1))
    levels = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)])
    turn = F.aggregate(levels, F.lit(0).cast("long"), lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
    x = F.transform(x, lambda v: v.bitwiseXOR(turn))
    index = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            index = index * 2 + F.shiftright(F.get(x, F.lit(i)), b).bitwiseAND(F.lit(1).cast("long"))
    return index


def cells(docs: DataFrame, bits: int = BITS) -> list[Column]:
    """Source and language by hash bucket (null in bucket 0), size by powers of two."""
    top = (1 << bits) - 1
    bucket = lambda c: F.when(docs[c].isNull(), 0).otherwise(F.pmod(F.xxhash64(docs[c]), F.lit(top)) + 1)
    size = F.octet_length(F.coalesce(docs["text"], F.lit("")))
    return [bucket("source"), bucket("lang"), F.least(F.lit(top), F.floor(F.log2(size + 1)).cast("int"))]


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, hilbert and its three cells, shard, slot for every row of documents.

    ``rows`` law: shard counts differ by at most one. Order: curve index, text checksum, doc_id;
    equal rows are interchangeable. Null text has size 1 and checksum 0; an empty table gives no rows.
    Only this narrow projection is shuffled, never the text.
    """
    own = docs.select("doc_id", "text", "lang", "source")
    axes = cells(own)
    text = F.coalesce(own["text"], F.lit(""))
    narrow = own.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *[a.cast("int").alias(f"cell_{n}") for n, a in zip(("source", "lang", "size"), axes, strict=True)],
    )
    narrow = narrow.withColumn("hilbert", hilbert_index([F.col("cell_source"), F.col("cell_lang"), F.col("cell_size")])).withColumn("__one", F.lit(1).cast("long"))
    ranked = running_sums(narrow, ["hilbert", "text_crc32", "doc_id"], {"__rank": "__one"})
    total = narrow.agg(F.count("*").alias("__n"))
    placed = ranked.crossJoin(F.broadcast(total))  # one row by construction
    share, extra = F.floor(F.col("__n") / shards), F.col("__n") % shards
    at = F.col("__rank") - 1
    # the first `extra` shards hold one row more
    long_rows = extra * (share + 1)
    in_long = at < long_rows
    shard = F.when(in_long, F.floor(at / (share + 1))).otherwise(extra + F.floor((at - long_rows) / F.greatest(share, F.lit(1))))
    slot = F.when(in_long, at % (share + 1)).otherwise((at - long_rows) % F.greatest(share, F.lit(1)))
    return placed.select("doc_id", "size", "text_crc32", "hilbert", "cell_source", "cell_lang", "cell_size", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def shard_bounds(sharded: DataFrame) -> DataFrame:
    """Per shard: rows, bytes and the least and greatest cell of each dimension, for pruning; shards without rows are absent."""
    ends = [f(c).alias(f"{n}_{c}") for c in ("cell_source", "cell_lang", "cell_size") for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *ends)
