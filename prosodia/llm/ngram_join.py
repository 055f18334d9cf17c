"""N-gram Jaccard self-join: exact links by a prefix-tree join, and the components they form.

A document's set is its distinct word n-grams as 64-bit fingerprints in one global order: by a
frequency class from counts over the whole corpus, then by fingerprint. Documents with equal sets are one set
with one representative from here on. Two sets that link share a
token among the first ``n - ceil(t * n) + 1`` of each, and several if both show some more; a set that
shows too few tokens which others show too drops out. For each shared prefix token the least set
that has it is its hub; block h holds all sets that share with h a token whose hub is h, so every
pair that can link meets in a block and each set is sent once to each of its few hubs, first as a
bitmap of about a bit a token: sets whose bitmaps rule out every other set of the block go no further.

Inside a block all ordered sets are one trie. A set descends it, sharing partial overlaps along common
paths, leaving a subtree as soon as the tokens left could not reach the threshold, and passing over
sets that its component holds already or that size and map rule out, because more links to a
component would tell nothing new. A group of n near copies costs about n descents, not n * n pairs.
A block beyond a bound is cut into parts, each with the block's first set as an anchor. Whatever links
with the anchor's component needs no more; only the strays left go to the other parts too, so a large
group of near copies costs about a row a set, not a grid of parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosodia.llm.components import components
from prosodia.llm.shared import Words, materialize, mix, pieces, powers, sum_arrays

#: Buckets of the frequency table (4 MB of classes whatever the corpus), and rows it travels in.
TABLE_BITS, CHUNKS = 22, 16
#: Sets and tokens that a part of a block holds, about.
PART_SETS, PART_TOKENS = 4_096, 4_000_000
#: Sets that may link up to which their list is broadcast to the texts; beyond it the texts are shuffled.
BROADCAST_SETS = 100_000
#: Rows that aren't their set's representative up to which their names are broadcast (16 MB).
BROADCAST_COPIES = 1_000_000


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all word n-grams (A-Z lower-cased) and the text of each; a shorter text is one n-gram."""
    words = Words(texts, lower=True)
    count = np.diff(words.first)
    h = words.hash
    grams = np.zeros(len(h), dtype=np.uint64)
    for k in range(n):
        ahead = np.zeros_like(h)
        ahead[: max(0, len(h) - k)] = h[k:]
        grams = mix(grams * np.uint64(0x9E3779B97F4A7C15) + ahead)
    doc = np.repeat(np.arange(len(texts)), count)
    inside = np.arange(len(h)) + n <= words.first[1:][doc]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        for d in short:
            x = np.zeros(1, dtype=np.uint64)
            for w in h[words.first[d] : words.first[d + 1]]:
                x = mix(x * np.uint64(0x9E3779B97F4A7C15) + w)
            grams[words.first[d]] = mix(x + np.uint64(count[d]))
            inside[words.first[d]] = True
    return grams[inside], doc[inside]


def ordered_sets(grams: np.ndarray, doc: np.ndarray, texts: int, table: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of each text in global order, one after the other, and where each text begins."""
    keys = grams >> np.uint64(6)
    if table is not None:
        keys = keys | (table[(grams >> np.uint64(64 - TABLE_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(58))
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    keys, doc = keys[new], doc[new]
    return keys, np.searchsorted(doc, np.arange(texts + 1))


def set_ids(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set by its content; 0 for the empty set."""
    up, down = powers(len(keys) + 1)
    sums = np.zeros(len(keys) + 1, dtype=np.uint64)
    np.cumsum(mix(keys) * up[: len(keys)], out=sums[1:], dtype=np.uint64)
    size = np.diff(first).astype(np.uint64)
    names = mix((sums[first[1:]] - sums[first[:-1]]) * down[first[:-1]] + size) | np.uint64(1)
    return np.where(size > 0, names, np.uint64(0)).view(np.int64)


def _survey(n: int):
    """mapInArrow over (name, doc_id, text): a row a document (size and name of its set), then this task's n-gram counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << TABLE_BITS, dtype=np.int32)
        names = ["name", "doc_id", "n", "set_id", "chunk", "counts"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for piece in pieces(batches):
            grams, doc = shingles(piece.column(2), n)
            table += np.bincount((grams >> np.uint64(64 - TABLE_BITS)).astype(np.int64), minlength=len(table))
            keys, first = ordered_sets(grams, doc, piece.num_rows, None)
            m = piece.num_rows
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1).cast(pa.int64()), pa.array(np.diff(first)), pa.array(set_ids(keys, first)), pa.nulls(m, kinds[4]), pa.nulls(m, kinds[5])], names=names)
        # a byte a bucket; a task's larger counts only have to stay large
        parts = [c.astype("<u1").tobytes() for c in np.split(np.minimum(table, 255), CHUNKS)]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(CHUNKS, k) for k in kinds[:4]), pa.array(range(CHUNKS), kinds[4]), pa.array(parts, kinds[5])], names=names)

    return run


def _classes(survey: DataFrame) -> np.ndarray:
    """Frequency class of each bucket: 0 up to what chance explains, one more for each doubling of the excess.

    Buckets hold many tokens each, so counts spread by about the root of their mean; a token stands out by
    more than four of these. It only orders tokens; any table gives the same links.
    """
    rows = sum_arrays(survey.filter("chunk is not null").select("chunk", "counts"), "<u1", out="<f4")  # 16 MB by construction
    counts = np.concatenate([rows.pop(k) for k in range(CHUNKS)])
    mean = float(counts.mean())
    counts -= mean
    counts /= np.float32(4 * np.sqrt(mean) + 1)
    return np.where(counts > 1, np.minimum(np.log2(np.maximum(counts, 1)) + 1, 62), 0).astype(np.uint8)


def prefix_lengths(size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """How many first tokens a set of each size shows, and how many of them its partner must show too.

    Two linked sets share one token among the first s - ceil(t * s) + 1 of each, and l of them if both show
    l - 1 more. Sets show a quarter more; a partner may be smaller by the threshold and so owe fewer.
    """
    short = lambda s: np.where(s > 0, s - -(-percent * s // 100) + 1, 0)
    owed = lambda s: np.maximum(1, short(s) // 4)
    return np.where(size > 0, np.minimum(size, short(size) + owed(size) - 1), 0), owed(-(-percent * size // 100))


def _prefixes(n: int, percent: int, table, bits: int):
    """mapInArrow over (name, text): a row a document that has words, with its prefix tokens (``bits`` of each) and bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            grams, doc = shingles(piece.column(1), n)
            keys, first = ordered_sets(grams, doc, piece.num_rows, table.value)
            size = np.diff(first)
            length, need = prefix_lengths(size, percent)
            upto = np.concatenate([[0], np.cumsum(length)])
            flat = keys[np.repeat(first[:-1] - upto[:-1], length) + np.arange(upto[-1])]
            # a clash of shortened tokens only makes two sets candidates
            tokens = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array((mix(flat) >> np.uint64(64 - bits)).astype(np.int64)))
            maps = pa.array([bitmap(keys[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(size), pa.array(need), tokens, maps], names=["name", "n", "need", "tokens", "map"]).filter(pa.array(size > 0))

    return run


def _sets(n: int, table):
    """mapInArrow: (text, name, cells) -> one row a cell with the whole ordered set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            grams, doc = shingles(piece.column(0), n)
            keys, first = ordered_sets(grams, doc, piece.num_rows, table.value)
            rows = [keys[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            cells = piece.column(2)
            at = np.repeat(np.arange(piece.num_rows), np.asarray(cells.value_lengths()))
            cell = cells.flatten()
            # a set goes out cell by cell, so a batch stays near the size of its piece
            for k in range(0, len(at), 256):
                some = at[k : k + 256]
                yield pa.RecordBatch.from_arrays([cell.field("cell").slice(k, 256), cell.field("side").slice(k, 256), piece.column(1).take(pa.array(some)), pa.array([rows[i] for i in some], pa.binary())], names=["cell", "side", "name", "keys"])

    return run


def bitmap(keys: np.ndarray) -> bytes:
    """Parities of a set's tokens in about as many bits as it has tokens.

    Two maps differ in no more bits than their sets differ in tokens, so maps that differ more than the
    threshold allows rule a link out. A map folds to half its width by exclusive or.
    """
    width = 1 << min(16, max(6, int(len(keys) - 1).bit_length()))
    return np.packbits((np.bincount((keys & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def alive(sizes: np.ndarray, maps: list[bytes], sides: np.ndarray, percent: int) -> np.ndarray:
    """Which sets of a cell have another that size and map do not rule out (of another side, if there are two)."""
    cross = len(set(sides.tolist())) > 1
    live = np.zeros(len(sizes), dtype=bool)
    order = np.argsort(sizes, kind="stable")
    sizes, sides = sizes[order], sides[order]
    by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    widths = np.array([len(maps[i]) for i in order])
    for w in np.unique(widths).tolist():
        at = np.flatnonzero(widths == w)
        by_width[w] = at, np.frombuffer(b"".join(maps[order[i]] for i in at), dtype=np.uint64).reshape(len(at), -1)
    for w, (at, own) in by_width.items():
        for k, i in enumerate(at.tolist()):
            if live[i]:
                continue
            for v, (other, theirs) in by_width.items():
                a, b = np.searchsorted(sizes[other], [-(-percent * sizes[i] // 100), 100 * sizes[i] // percent + 1])
                if a >= b:
                    continue
                mine, those = own[k], theirs[a:b]
                while those.shape[1] > len(mine):
                    half = those.shape[1] // 2
                    those = those[:, :half] ^ those[:, half:]
                while len(mine) > those.shape[1]:
                    half = len(mine) // 2
                    mine = mine[:half] ^ mine[half:]
                apart = np.bitwise_count(those ^ mine).sum(axis=1, dtype=np.int64)
                near = other[a:b][(100 + percent) * apart <= (100 - percent) * (sizes[i] + sizes[other[a:b]])]
                near = near[(near != i) & ((sides[near] != sides[i]) | (not cross))]
                if len(near):
                    live[i] = live[near] = True
    out = np.empty_like(live)
    out[order] = live
    return out


def _live_cells(percent: int):
    """mapInArrow over (cell, side, name, n, map) sorted by cell: the sets of each cell that may link there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def close() -> None:
            if len(held) > 1:
                live = alive(np.array([h[3] for h in held]), [h[4] for h in held], np.array([h[1] for h in held]), percent)
                out.extend((h[0], h[1], h[2]) for h, x in zip(held, live.tolist(), strict=True) if x)

        def emit() -> pa.RecordBatch:
            columns = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64()), strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["cell", "side", "name"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if held and row[0] != held[0][0]:
                    close()
                    held = []
                held.append(row)
            if out:
                yield emit()
        close()
        if out:
            yield emit()

    return run


class Trie:
    """All ordered sets of a block along compressed paths: a node is a run of sets that share their first tokens.

    Sets are sorted by their tokens, so the sets below a node lie side by side. ``find`` walks the paths that hold
    candidates, counts the overlap of a path once for all sets below it, and leaves a subtree as soon as the
    tokens left could not reach the threshold with its smallest set.
    """

    def __init__(self, percent: int, sets: list[np.ndarray]):
        self.percent, self.sets = percent, sets
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        #: (tokens of the node's own part, sets from, to, of them those that end here, least and greatest size below, children)
        self.nodes: list[list] = []
        self.roots = self._split(0, len(sets), 0)
        waiting = [(n, end) for n, end in self.roots]
        self.roots = [n for n, _ in self.roots]
        while waiting:
            n, depth = waiting.pop()
            node = self.nodes[n]
            below = self._split(node[3], node[2], depth)
            node[6] = [c for c, _ in below]
            waiting += below

    def _split(self, low: int, high: int, depth: int) -> list[tuple[int, int]]:
        """Nodes of the sets low to high by their token at ``depth``, each with the depth at which it ends."""
        out, at = [], low
        while at < high:
            first, to = self.sets[at], at + 1
            token = first[depth]
            while to < high and self.sets[to][depth] == token:
                to += 1
            last = self.sets[to - 1]
            ahead = min(len(first), len(last))
            differ = np.flatnonzero(first[depth:ahead] != last[depth:ahead])
            end = depth + int(differ[0]) if len(differ) else ahead
            ends = at
            while ends < to and len(self.sets[ends]) == end:
                ends += 1
            sizes = self.sizes[at:to]
            self.nodes.append([first[depth:end], at, to, ends, int(sizes.min()), int(sizes.max()) - end, []])
            out.append((len(self.nodes) - 1, end))
            at = to
        return out

    def find(self, keys: np.ndarray, wanted: np.ndarray) -> int | None:
        """A candidate (``wanted``, by place) that links with the probe, or None; those found not to are no longer wanted."""
        size, percent = len(keys), self.percent
        stack = [(n, 0, 0) for n in self.roots]
        places = np.flatnonzero(wanted)
        while stack:
            n, got, used = stack.pop()
            seg, low, high, ends, least, rest, children = self.nodes[n]
            if np.searchsorted(places, low) == np.searchsorted(places, high):
                continue
            # needed of the smallest set below: inter >= p / (100 + p) * (size + its size)
            need = percent * (size + least)
            if (100 + percent) * (got + min(size - used, len(seg) + rest)) < need:
                wanted[low:high] = False
                continue
            at = np.searchsorted(keys, seg)
            hit = keys[np.minimum(at, size - 1)] == seg
            got += int(np.count_nonzero(hit))
            used = int(at[-1]) + int(hit[-1])
            for p in range(low, ends):
                if wanted[p] and 100 * got >= percent * (size + int(self.sizes[p]) - got):
                    return p
            wanted[low:ends] = False
            if children and (100 + percent) * (got + min(size - used, rest)) >= need:
                stack += [(c, got, used) for c in children]
            else:
                wanted[low:high] = False
        return None


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """Maps of all sets in one width, as ``bitmap``: that of the largest set, 4,096 bits at most."""
    width = 1 << min(12, max(6, int(max(map(len, sets)) - 1).bit_length()))
    out = np.zeros((len(sets), width // 64), dtype=np.uint64)
    for row, keys in zip(out, sets, strict=True):
        bits = np.bincount((keys & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
        row[:] = np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)
    return out


def link(sets: list[tuple[int, np.ndarray, int]], percent: int, cross: bool = False) -> list[tuple[int, int]]:
    """Links that connect every pair of linked sets; ``cross``: only sets of unlike sides are compared.

    All sets are in one trie. Each is a probe against those before it by (size, name), of components that it isn't in
    yet and that size and map don't rule out; each link found joins two components.
    """
    sets = sorted(sets, key=lambda s: s[1].astype(">u8").tobytes())
    names, keys, sides = [s[0] for s in sets], [s[1] for s in sets], np.array([s[2] for s in sets])
    if len(sets) < 2:
        return []
    trie, maps = Trie(percent, keys), parities(keys)
    order = sorted(range(len(sets)), key=lambda i: (len(keys[i]), names[i]))
    home, seen = np.arange(len(sets)), np.zeros(len(sets), dtype=bool)
    links: list[tuple[int, int]] = []
    for i in order:
        size = len(keys[i])
        wanted = seen & (100 * trie.sizes >= percent * size)
        if cross:
            wanted &= sides != sides[i]
        near = np.flatnonzero(wanted)
        if len(near):
            apart = np.bitwise_count(maps[near] ^ maps[i]).sum(axis=1, dtype=np.int64)
            wanted[near] = (100 + percent) * apart <= (100 - percent) * (size + trie.sizes[near])
        while wanted.any() and (other := trie.find(keys[i], wanted)) is not None:
            links.append((names[i], names[other]))
            home[home == home[i]] = home[other]
            wanted &= home != home[i]
        seen[i] = True
    return links


def _link_cells(percent: int):
    """mapInArrow over rows sorted by cell: the links of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cell, links = [], None, []

        def close() -> None:
            if len(held) > 1:
                links.extend(link(held, percent, cross=len({s for _, _, s in held}) > 1))

        for batch in batches:
            for c, side, name, keys in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if c != cell:
                    close()
                    held, cell = [], c
                held.append((name, np.frombuffer(keys, dtype=np.uint64), side))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], names=["a", "b"])
                links = []
        close()
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], names=["a", "b"])

    return run


def without_contained(live: DataFrame) -> DataFrame:
    """Rows (cell, side, name) without the cells whose sets are all in one larger cell, where they meet as well.

    A cell is held against the largest cell of its least set, by (sets, cell); as that order has no
    cycle, what is dropped is in a cell that stays. Cells of two sides all stay.
    """
    whole = live.groupBy("cell").agg(F.count("*").alias("size"), F.max("side").alias("sides"), F.min("name").alias("first")).filter("sides = 0")
    whole = materialize(whole.select("cell", "size", "first"), "cells")
    largest = live.join(whole, "cell").groupBy("name").agg(F.max(F.struct("size", "cell")).alias("most"))
    under = whole.join(largest, F.col("first") == F.col("name")).filter(F.col("most") > F.struct("size", "cell")).select("cell", "size", F.col("most.cell").alias("__in"))
    there = live.select(F.col("cell").alias("__in"), F.col("name").alias("__name"))
    both = live.join(under, "cell").withColumnRenamed("name", "__name").join(there, ["__in", "__name"])
    inside = both.groupBy("cell", "size").agg(F.count("*").alias("n")).filter("n = size").select("cell")
    return live.join(inside, "cell", "left_anti")


def _links(texts: DataFrame, celled: DataFrame, n: int, percent: int, table) -> DataFrame:
    """(a, b): links by name that connect what links in each cell; ``celled`` is (cell, side, name, n, map)."""
    live = celled.repartition("cell").sortWithinPartitions("cell", "name").mapInArrow(_live_cells(percent), "cell long, side int, name long")
    live = without_contained(materialize(live, "live"))
    wanted = materialize(live.groupBy(F.col("name").alias("__name")).agg(F.collect_list(F.struct("cell", "side")).alias("cells")), "wanted")
    if wanted.limit(BROADCAST_SETS + 1).count() <= BROADCAST_SETS:
        wanted = F.broadcast(wanted)
    own = texts.join(wanted, F.col("name") == F.col("__name")).select("text", "name", "cells")
    sets = own.mapInArrow(_sets(n, table), "cell long, side int, name long, keys binary")
    return sets.repartition("cell").sortWithinPartitions("cell", "name").mapInArrow(_link_cells(percent), "a long, b long")


def ngram_components(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, set_id, component_id for every row of ``docs`` (doc_id, text).

    Documents link when 100 * |A & B| >= percent * |A | B| over their distinct n-grams of words
    ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text of fewer words is one n-gram. Null and wordless
    texts have n_shingles 0 and are their own component. component_id is the least doc_id that links
    reach, or null if all of them are null. Rows that repeat a doc_id, or have none, are rows of their own; other
    columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ids = docs.agg(F.count("*").alias("rows"), F.count("doc_id").alias("ids"), F.countDistinct("doc_id").alias("different")).first()
    if not ids.rows:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_shingles"), F.lit(0).cast("long").alias("set_id"), F.col("doc_id").cast("long").alias("component_id"))
    # rows are named by doc_id, which packs better than a hash, unless ids repeat or are missing
    unique = ids.rows == ids.ids == ids.different
    own = docs.select((F.col("doc_id").cast("long") if unique else F.xxhash64("doc_id", "text")).alias("name"), "doc_id", "text")
    survey = materialize(own.mapInArrow(_survey(n), "name long, doc_id long, n long, set_id long, chunk int, counts binary"), "survey")
    members = survey.filter("chunk is null").select("name", "doc_id", "n", "set_id")
    table = spark.sparkContext.broadcast(_classes(survey))
    # one row stands for each set
    first = members.filter("n > 0").groupBy("set_id").agg(F.min("name").alias("rep"), F.count("*").alias("rows"))
    first = materialize(first, "sets")
    copies = materialize(members.join(first.filter("rows > 1"), "set_id").filter("name <> rep").select(F.col("name").alias("__copy")).distinct(), "copies")
    if copies.limit(BROADCAST_COPIES + 1).count() <= BROADCAST_COPIES:
        copies = F.broadcast(copies)

    total = members.agg(F.sum("n")).first()[0]
    bits = min(63, 15 + max(1, int(total)).bit_length())
    schema = "name long, n long, need long, tokens array<long>, map binary"
    prefixes = own.select("name", "text").mapInArrow(_prefixes(n, percent, table, bits), schema).join(copies, F.col("name") == F.col("__copy"), "left_anti")
    prefixes = materialize(prefixes if unique else prefixes.dropDuplicates(["name"]), "prefixes")
    rows = prefixes.select(F.explode("tokens").alias("t"), "name")
    shared = rows.groupBy("t").agg(F.min("name").alias("hub"), F.max("name").alias("last")).filter("hub <> last").select("t", "hub")
    seen = rows.join(shared, "t").groupBy("name").agg(F.count("*").alias("seen"), F.collect_set("hub").alias("hubs"))
    # a set that shows too few tokens which others show too has no partner
    blocks = seen.join(prefixes.select("name", "n", "need", "map"), "name").filter("seen >= need").select("name", "n", "map", F.explode("hubs").alias("hub"))
    blocks = materialize(blocks, "blocks")
    large = blocks.groupBy("hub").agg(F.ceil(F.greatest(F.count("*") / PART_SETS, F.sum("n") / PART_TOKENS)).cast("int").alias("parts"), F.min(F.struct("name", "n", "map")).alias("anchor")).filter("parts > 1")
    large = materialize(large, "large")
    placed = blocks.join(large.select("hub", "parts"), "hub", "left").withColumn("part", F.pmod(F.xxhash64("name"), F.coalesce("parts", F.lit(1))).cast("int"))
    cell = lambda part: F.xxhash64("hub", part).alias("cell")
    celled = placed.select(cell(F.col("part")), F.lit(0).alias("side"), "name", "n", "map")
    texts = own.select("name", "text") if unique else own.select("name", "text").dropDuplicates(["name"])
    if large.limit(1).count():
        anchors = large.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter(F.col("part") != F.pmod(F.xxhash64("anchor.name"), F.col("parts")))
        celled = celled.unionByName(anchors.select(cell(F.col("part")), F.lit(0).alias("side"), "anchor.*"))
        links = materialize(_links(texts, celled, n, percent, table), "links")
        links = links.unionByName(_stray_links(texts, placed, large, links, n, percent, table))
    else:
        links = _links(texts, celled, n, percent, table)
    roots = components(links)

    of = members.join(first.select(F.col("set_id").alias("__set"), "rep"), F.col("set_id") == F.col("__set"), "left")
    joined = materialize(of.join(roots, F.col("rep") == F.col("node"), "left").select("doc_id", "n", "set_id", F.coalesce("root", "rep").alias("root")), "roots")
    # written, so that the join below has two plain exchanges and a large component's can be split
    least = materialize(joined.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    out = joined.join(least.withColumnRenamed("root", "__root"), F.col("root") == F.col("__root"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "set_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _stray_links(texts: DataFrame, placed: DataFrame, large: DataFrame, links: DataFrame, n: int, percent: int, table) -> DataFrame:
    """Links between the parts of large blocks: sets that aren't in the anchor's component yet meet all other parts."""
    roots = materialize(components(links).select(F.col("node").alias("__node"), "root"), "roots")
    anchors = large.select("hub", F.col("anchor.name").alias("anchor")).join(roots, F.col("anchor") == F.col("__node"), "left").select("hub", F.coalesce("root", "anchor").alias("home"))
    inside = placed.filter("parts is not null").join(anchors, "hub").join(roots, F.col("name") == F.col("__node"), "left")
    strays = materialize(inside.filter(F.coalesce("root", "name") != F.col("home")).select("hub", "parts", "part", "name", "n", "map"), "strays")
    cell = lambda part: F.xxhash64("hub", part, F.lit(1)).alias("cell")
    away = strays.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("to <> part")
    away = away.select(cell(F.col("to")), F.lit(1).alias("side"), "name", "n", "map")
    home = placed.join(strays.select("hub").distinct(), "hub", "left_semi").select(cell(F.col("part")), F.lit(0).alias("side"), "name", "n", "map")
    return _links(texts, home.unionByName(away), n, percent, table)


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component: that of its least doc_id (nulls last), of those the least set; all columns.

    Every row without words stays. Rows of that doc_id with the same set are one. A row is told from others of
    its doc_id by its text, so a repeated doc_id loses no text that is the only one of its component. An
    empty table gives no rows.
    """
    unique = docs.agg(F.count("*") == F.countDistinct("doc_id")).first()[0]
    found = ngram_components(docs, n, percent) if unique else None
    if unique:
        gone = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__gone"))
        return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    # rows by their content: rows equal in id and text are one
    named = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    rows = materialize(named.select("__row", F.col("doc_id").alias("__id"), "text").dropDuplicates(["__row"]), "rows")
    found = ngram_components(rows.select(F.col("__row").alias("doc_id"), "text"), n, percent).select(F.col("doc_id").alias("__row"), "n_shingles", "set_id", F.col("component_id").alias("__of"))
    best = found.join(rows.select("__row", "__id"), "__row").filter("n_shingles > 0").groupBy("__of").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), "set_id", "__row")).alias("b"))
    stay = best.select(F.col("b.__row").alias("__stay"))
    words = found.filter("n_shingles > 0").select(F.col("__row").alias("__worded"))
    wordless = named.join(words, F.col("__row") == F.col("__worded"), "left_anti")
    kept = named.join(stay, F.col("__row") == F.col("__stay"), "left_semi").dropDuplicates(["__row"])
    return wordless.unionByName(kept).drop("__row")
