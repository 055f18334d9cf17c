"""Benchmark decontamination: SimHash over item-sized windows, Hamming blocks, exact verification.

Everything is DataFrame expressions. Windows have the sizes of the items. One that holds fewer benchmark n-grams
than any match of its size needs cannot match, whatever the item, so only the others get a 64-bit SimHash,
weighted by how often each n-gram occurs. Which item a window may match is found by fingerprints alone:
they are cut in ``BLOCKS`` blocks of ten or eleven bits, and two that differ in at most ``radius`` bits
differ in at most radius / BLOCKS of them in some block. Items are listed under every value that near
to theirs, so an equality join by (words, block, bits) finds all pairs within the radius. The exact weighted
Jaccard similarity of window and item then verifies each pair.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosodia.llm.shared import lower_ascii, materialize, words_column

#: Bits in which a match may differ. At similarity 0.8 a bit differs with chance 0.15: 10 of 64, deviation 3.
RADIUS = 20
#: Blocks of a fingerprint: six of 10 or 11 bits, looked up with up to three bits changed.
BLOCKS = 6
#: Benchmark n-grams, or candidate documents, up to which a side is broadcast; beyond it is shuffled.
BROADCAST_GRAMS, BROADCAST_DOCS = 1_000_000, 20_000


def word_hashes(text: Column) -> Column:
    return F.transform(words_column(lower_ascii(text)), lambda w: F.xxhash64(w))


def grams(hashes: Column, n: int) -> Column:
    """Fingerprints of all n-grams; none if there are fewer than n words."""
    at = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(n)])
    return F.when(F.size(hashes) >= n, F.transform(F.sequence(F.lit(0), F.size(hashes) - n), at)).otherwise(F.array().cast("array<bigint>"))


def simhash(gram_column: Column) -> Column:
    """Bit b is set if more than half of the n-grams, counted as often as they occur, have it.

    Four bits are counted at once in the 16-bit lanes of a long, which hold up to 16,383 n-grams; longer arrays
    are counted bit by bit.
    """
    lanes = 0x0001000100010001
    size = F.size(gram_column)
    # a lane reaches its bit 14 when its count passes half of the n-grams
    lift = F.lit(lanes) * (0x4000 - F.floor(size / 2) - 1)
    out = F.lit(0).cast("long")
    counted = lambda j: F.aggregate(gram_column, F.lit(0).cast("long"), lambda a, g: a + F.shiftright(g, j).bitwiseAND(F.lit(lanes)))
    for j in range(16):
        count = counted(j)
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned((count + lift).bitwiseAND(F.lit(lanes << 14)), 14), j))
    bit = lambda g, b: F.call_function("shiftright", g, b).bitwiseAND(F.lit(1).cast("long"))
    heavy = lambda b: F.aggregate(gram_column, F.lit(0).cast("long"), lambda a, g: a + bit(g, b)) * 2 > size
    slow = F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, b: F.when(heavy(b), a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(a))
    return F.when(size <= 16_383, out).otherwise(slow)


def _cut(fingerprint: Column) -> list[tuple[int, int, Column]]:
    """Number, width and bits of each block."""
    cuts = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
    return [(k, b - a, F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long"))) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def blocks(fingerprint: Column) -> Column:
    """The blocks of a fingerprint as structs of number and bits."""
    return F.array(*[F.struct(F.lit(k).alias("k"), bits.alias("bits")) for k, _, bits in _cut(fingerprint)])


def near_blocks(fingerprint: Column, radius: int) -> Column:
    """The same with every value that differs in at most radius // BLOCKS bits; one block of two fingerprints does."""
    ball = lambda width: F.filter(F.sequence(F.lit(0).cast("long"), F.lit((1 << width) - 1).cast("long")), lambda x: F.bit_count(x) <= radius // BLOCKS)
    near = lambda k, width, bits: F.transform(ball(width), lambda x: F.struct(F.lit(k).alias("k"), bits.bitwiseXOR(x).alias("bits")))
    return F.flatten(F.array(*[near(*c) for c in _cut(fingerprint)]))


def numbered(gram_column: Column) -> Column:
    """A multiset as a set: each n-gram hashed with how many equal ones come before it."""
    own = lambda s: F.transform(s, lambda g, i: F.xxhash64(g, i + 1 - F.call_function("array_position", s, g)))
    return F.get(F.transform(F.array(F.array_sort(gram_column)), own), F.lit(0))  # sorted once, as a lambda's argument


def starts(n: int, percent: int) -> Column:
    """Every start of ``words`` words whose window holds enough of the sorted ``places`` to match.

    A window and an item of m n-grams each match only if 100 * shared >= percent * (2 * m - shared),
    and no more can be shared than there are places in the window. The window that ends at the
    latest with places i to i + least - 1 begins at most at place i; starts up to place i - 1 belong
    to earlier i. A shorter document has one window.
    """
    m = f"(words - {n - 1})"
    least = f"((2 * {percent} * {m} + {99 + percent}) div {100 + percent})"
    low = f"greatest(get(places, cast(i + {least} - 1 as int)) - {m} + 1, if(i > 0, get(places, i - 1) + 1, 0))"
    run = f"if({low} <= get(places, i), sequence(cast({low} as int), get(places, i)), cast(array() as array<int>))"
    runs = f"flatten(transform(sequence(0, cast(size(places) - {least} as int)), i -> {run}))"
    return F.expr(f"case when size < words then array(0) when size(places) >= {least} then {runs} else cast(array() as array<int>) end")


def _hits(docs: DataFrame, index: DataFrame, n: int) -> DataFrame:
    """(doc_id, row, size, p, and the columns of index but gram): n-grams at p of a document of ``size`` words that ``index`` lists."""
    if index.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS:
        index = F.broadcast(index)
    own = docs.select("doc_id", "row", F.size("h").alias("size"), F.posexplode(grams(F.col("h"), n)).alias("p", "gram"))
    return own.join(index, "gram").drop("gram")


def windows(texts: DataFrame, items: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, row, words, start, g, print: every window of an item's size that holds enough benchmark n-grams to match.

    ``items``: words and grams. A window of w words is held against the n-grams of all items of w words.
    """
    hashed = texts.select("doc_id", "row", word_hashes(F.col("text")).alias("h"))
    index = materialize(items.select("words", F.explode("grams").alias("gram")).distinct(), "grams")
    hits = _hits(hashed, index, n)
    needed = F.ceil((F.col("words") - (n - 1)) * percent / 100)
    lined = hits.groupBy("doc_id", "row", "words", "size").agg(F.array_sort(F.collect_set("p")).alias("places")).filter(F.size("places") >= needed)
    filled = lined.select("doc_id", "row", "words", F.explode(starts(n, percent)).alias("s"))
    wanted = materialize(filled.groupBy("doc_id", "row").agg(F.collect_set(F.struct("words", "s")).alias("windows")), "windows")
    if wanted.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS:
        wanted = F.broadcast(wanted)
    chosen = texts.join(wanted.withColumnRenamed("doc_id", "__d").withColumnRenamed("row", "__r"), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("row") == F.col("__r"))).select("doc_id", "row", word_hashes(F.col("text")).alias("h"), "windows")
    chosen = chosen.select("doc_id", "row", F.size("h").alias("size"), grams(F.col("h"), n).alias("g"), F.explode("windows").alias("w"))
    start = F.greatest(F.lit(0), F.least(F.col("w.s"), F.col("size") - F.col("w.words")))
    chosen = chosen.select("doc_id", "row", F.col("w.words").alias("words"), start.alias("start"), "g").withColumn("g", F.expr(f"slice(g, start + 1, words - {n - 1})"))
    return chosen.dropDuplicates(["doc_id", "row", "words", "start"]).withColumn("print", simhash(F.col("g")))


def candidates(found: DataFrame, prints: DataFrame, radius: int) -> DataFrame:
    """doc_id, row, words, start, item_id: pairs of a window and an item of one size whose fingerprints are within the radius."""
    left = found.select("doc_id", "row", "words", "start", "print", F.explode(blocks(F.col("print"))).alias("b")).select("*", "b.k", "b.bits").drop("b")
    right = prints.select("item_id", "words", "iprint", F.explode(near_blocks(F.col("iprint"), radius)).alias("b")).select("*", "b.k", "b.bits").drop("b")
    near = left.join(right, ["words", "k", "bits"]).filter(F.bit_count(F.col("print").bitwiseXOR(F.col("iprint"))) <= radius)
    return near.select("doc_id", "row", "words", "start", "item_id").distinct()


def matches(docs: DataFrame, benchmark: DataFrame, n: int = 5, percent: int = 80, radius: int = RADIUS) -> DataFrame:
    """doc_id, row, item_id, start, similarity: the best window of each document and item that match.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A window has as many consecutive words as the
    item (or is the whole of a shorter document); it matches if 100 * shared >= percent * united
    n-grams, each counted as often as it occurs. Items of fewer than n words match where their whole
    sequence occurs; wordless items and texts match nothing, as do empty tables. ``row`` is a hash of the text:
    rows equal in doc_id and text give one row. Other columns are not read.
    """
    words = benchmark.filter("item_id is not null").select("item_id", word_hashes(F.col("text")).alias("h")).withColumn("words", F.size("h")).filter("words > 0")
    items = materialize(words.select("item_id", "words", F.when(F.col("words") >= n, grams(F.col("h"), n)).otherwise(F.array(F.xxhash64("h"))).alias("grams"), "h"), "items")
    texts = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    whole = items.filter(F.col("words") >= n)
    found = materialize(windows(texts, whole, n, percent), "prints")
    prints = materialize(whole.select("item_id", "words", numbered(F.col("grams")).alias("ig"), simhash(F.col("grams")).alias("iprint")), "itemprints")
    near = candidates(found, prints, radius)
    on = near["doc_id"].eqNullSafe(found["doc_id"]) & (near["row"] == found["row"]) & (near["words"] == found["words"]) & (near["start"] == found["start"])
    pairs = near.join(found, on).select(near["doc_id"], near["row"], near["start"], near["item_id"], "g").join(prints.select("item_id", "ig"), "item_id")
    both = pairs.withColumn("both", F.size(F.array_intersect(numbered(F.col("g")), F.col("ig")))).withColumn("all", F.size("g") + F.size("ig") - F.col("both"))
    good = both.filter(100 * F.col("both") >= percent * F.col("all")).select("doc_id", "row", "item_id", "start", (F.col("both") / F.col("all")).alias("similarity"))

    hashed = texts.select("doc_id", "row", word_hashes(F.col("text")).alias("h"))
    short = [r[0] for r in items.filter(F.col("words") < n).select("words").distinct().collect()]  # fewer than n values
    for size in sorted(short):
        exact = items.filter(F.col("words") == size).select("item_id", F.explode(grams(F.col("h"), size)).alias("gram"))
        own = _hits(hashed, exact, size)
        good = good.unionByName(own.select("doc_id", "row", "item_id", F.col("p").alias("start"), F.lit(1.0).alias("similarity")))
    best = good.groupBy("doc_id", "row", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("b"))
    return best.select("doc_id", "row", "item_id", (-F.col("b.s")).alias("start"), F.col("b.similarity").alias("similarity"))


def keep_untouched(docs: DataFrame, benchmark: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark item was found.

    Null and wordless texts stay; rows equal in doc_id and text stay or go together; columns of any name pass
    through; with an empty benchmark every row stays.
    """
    found = materialize(matches(docs, benchmark, n, percent).select(F.col("doc_id").alias("__d"), F.col("row").alias("__r")).distinct(), "found")
    if found.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS:
        found = F.broadcast(found)
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col("__d")) & (F.xxhash64(docs["text"]) == F.col("__r")), "left_anti")
