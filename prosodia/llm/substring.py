"""Removal of repeated word windows, found by recompression.

A text is a sequence of symbols, at first its words. Each round gives every maximal run of one
symbol a new name, then every adjacent pair whose first symbol is in a left and whose second is in a
right half of the alphabet, the halves drawn by a hash of the name and the round. Names are
fingerprints of what they stand for, so equal runs and pairs have equal names in all documents
without any exchange, and equal stretches of text get equal interior symbols. Each symbol carries
its context: the words that decided it. A window contains a symbol for certain if it covers that
context, wherever the window occurs.

Each window of ``width`` words picks as its anchor the certain symbol of the highest level with the
greatest fingerprint, so equal windows have equal anchors; about one word in eight is the context of an
anchor. Only anchors go through a shuffle to find those that occur again, and only windows with
such an anchor are then compared, by 64 bits of all their words beside those of the anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosodia.llm.shared import Words, materialize, mix, pieces, powers, rolling

ROUNDS = 3
#: Occurrences of one anchor that are compared in one place, about.
HOT = 20_000
_K = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 26) - 1)
_FAR = np.int64(1 << 40)


class Level:
    """Symbols in order: name, words start..end, and context lo..hi (far away where a text's end decided it)."""

    def __init__(self, name, start, end, lo, hi, doc):
        self.name, self.start, self.end, self.lo, self.hi, self.doc = name, start, end, lo, hi, doc

    def _beside(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether the next symbol is of the same text; the context's ends if the neighbours count too."""
        joined = np.zeros(len(self.name), dtype=bool)
        joined[:-1] = self.doc[1:] == self.doc[:-1]
        lo, hi = np.full(len(self.name), -_FAR), np.full(len(self.name), _FAR)
        lo[1:][joined[:-1]] = self.lo[:-1][joined[:-1]]
        hi[joined] = self.hi[1:][joined[:-1]]
        return joined, lo, hi

    def name_runs(self) -> Level:
        joined, lo, hi = self._beside()
        same = joined.copy()
        same[:-1] &= self.name[1:] == self.name[:-1]
        last = ~same
        first = np.ones(len(last), dtype=bool)
        first[1:] = last[:-1]
        a, b = np.flatnonzero(first), np.flatnonzero(last)
        long = (b - a + 1).astype(np.uint64)
        name = np.where(long > 1, mix(self.name[a] * _K + long), self.name[a])
        return Level(name, self.start[a], self.end[b], lo[a], hi[b], self.doc[a])

    def name_pairs(self, number: int) -> Level:
        joined, lo, hi = self._beside()
        salt = mix(np.array([number + 1], dtype=np.uint64) * _K)
        right = (mix(self.name + salt) >> np.uint64(63)).astype(bool)
        paired = joined & ~right
        paired[:-1] &= right[1:]
        second = np.zeros(len(paired), dtype=bool)
        second[1:] = paired[:-1]
        at = np.flatnonzero(~second)
        two = paired[at]
        end_at = at + two
        name = np.where(two, mix(mix(self.name[at] * _K) + self.name[np.minimum(at + 1, len(second) - 1)]), self.name[at])
        # a symbol left alone is so because of the neighbour on the side it would pair with
        new_lo = np.where(two | ~right[at], self.lo[at], lo[at])
        new_hi = np.where(two, self.hi[end_at], np.where(right[at], self.hi[at], hi[at]))
        return Level(name, self.start[at], self.end[end_at], new_lo, new_hi, self.doc[at])


def anchors(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of all texts: first word, text, and the key of its anchor; two arrays of anchors follow.

    Returns (window starts, anchor number of each window, key of each anchor).
    """
    n = len(words.hash)
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    at = np.arange(n)
    starts = np.flatnonzero(at + width <= words.first[1:][doc]) if n else at
    if not len(starts):
        return starts, starts, np.zeros(0, dtype=np.uint64)
    levels = [Level(words.hash, at, at + 1, at, at + 1, doc)]
    for r in range(ROUNDS):
        levels.append(levels[-1].name_runs().name_pairs(r))
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words.hash * up[:n], out=sums[1:], dtype=np.uint64)
    anchor = np.full(len(starts), -1)
    keys = []
    total = 0
    open_ = np.arange(len(starts))
    for number in range(ROUNDS, -1, -1):
        level = levels[number]
        fits = np.flatnonzero((level.hi - level.lo <= width) & (level.lo >= 0))
        if not len(fits) or not len(open_):
            continue
        lo, hi = level.lo[fits], level.hi[fits]
        key = mix((sums[hi] - sums[lo]) * down[lo] + ((hi - lo) * 4096 + (level.start[fits] - lo) * 64 + number).astype(np.uint64))
        s = starts[open_]
        # contexts rise with their symbols, so those inside a window are neighbours
        begins = np.concatenate([[0], np.cumsum(np.bincount(lo, minlength=n + 1))])
        ends = np.concatenate([[0], np.cumsum(np.bincount(hi, minlength=n + 2))])
        a, b = begins[s], ends[s + width + 1]
        some = b > a
        if not some.any():
            continue
        a, b, who = a[some], b[some], open_[some]
        rank = (key & ~_PLACE) | (np.arange(len(fits), dtype=np.uint64) & _PLACE)
        best = np.zeros(len(a), dtype=np.uint64)
        table, power = rank, 1
        while True:
            mine = (b - a >= power) & (b - a < 2 * power)
            if mine.any():
                best[mine] = np.maximum(table[a[mine]], table[b[mine] - power])
            if not (b - a >= 2 * power).any():
                break
            wider = table.copy()
            wider[: len(table) - power] = np.maximum(table[: len(table) - power], table[power:])
            table, power = wider, 2 * power
        used, which = np.unique((best & _PLACE).astype(np.int64), return_inverse=True)
        anchor[who] = total + which
        keys.append(key[used])
        total += len(used)
        open_ = open_[~some]
    return starts, anchor, np.concatenate(keys)


def _keys(width: int, bits: int):
    """mapInArrow: a row a document with the keys of its anchors, ``bits`` of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            words = Words(piece.column(2), lower=False)
            starts, anchor, keys = anchors(words, width)
            keys = keys >> np.uint64(64 - bits)
            first = np.zeros(len(keys), dtype=np.int64)
            first[anchor[::-1]] = starts[::-1]
            doc = np.searchsorted(words.first, first, side="right") - 1
            order = np.argsort(doc, kind="stable")
            upto = np.searchsorted(doc[order], np.arange(piece.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.ListArray.from_arrays(pa.array(upto), pa.array(keys[order].view(np.int64)))], names=["doc_id", "row", "keys"])

    return run


def _windows(width: int, bits: int):
    """mapInArrow: (doc_id, row, text, wanted) -> a row for each run of windows with one repeated anchor.

    ws: fingerprints of the windows that start at base, base + 1, ...
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            words = Words(piece.column(2), lower=False)
            starts, anchor, keys = anchors(words, width)
            keys = keys >> np.uint64(64 - bits)
            wanted = piece.column(3).flatten()
            if not len(starts) or not len(wanted):
                continue
            known, at = np.unique(wanted.field("key").to_numpy(zero_copy_only=False), return_index=True)
            known, salts = known.view(np.uint64), wanted.field("salts").to_numpy(zero_copy_only=False)[at]
            order = np.argsort(known)
            known, salts = known[order], salts[order]
            near = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            again = known[near] == keys
            hit = again[anchor]
            own, its = starts[hit], anchor[hit]
            if not len(own):
                continue
            new = np.ones(len(own), dtype=bool)
            new[1:] = (np.diff(own) != 1) | (np.diff(its) != 0)
            first = np.flatnonzero(new)
            doc = np.searchsorted(words.first, own[first], side="right") - 1
            upto = np.append(first, len(own)).astype(np.int32)
            prints = rolling(words.hash, width)[own].view(np.int64)
            ids = piece.column(0).to_numpy()[doc]
            salt = (mix(ids.view(np.uint64)) % salts[near[its[first]]].astype(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[its[first]].view(np.int64)), pa.array(salt), pa.array(salts[near[its[first]]] > 1), pa.array(ids), piece.column(1).take(pa.array(doc)), pa.array((own[first] - words.first[doc]).astype(np.int32)), pa.ListArray.from_arrays(pa.array(upto), pa.array(prints))],
                names=["key", "salt", "hot", "doc_id", "row", "base", "ws"],
            )

    return run


def _kept(width: int):
    """mapInArrow: (doc_id, text, starts) -> what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            out = {"doc_id": piece.column(0), "n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
            for text, starts in zip(piece.column(1).to_pylist(), piece.column(2).to_pylist(), strict=True):
                words = (text or "").encode().split()
                n = len(words)
                if starts:
                    cover = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, np.array(starts) + width, -1)
                    words = [w for w, c in zip(words, np.cumsum(cover[:-1]).tolist(), strict=True) if not c]
                kept = b" ".join(words)
                out["n_words"].append(n)
                out["n_removed"].append(n - len(words))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept.decode())
            yield pa.RecordBatch.from_arrays([out["doc_id"], pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_sha256"], pa.string()), pa.array(out["kept"], pa.string())], names=list(out))

    return run


def remove_repeats(docs: DataFrame, width: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the text left) for every row of ``docs``.

    Words ``[^\\x20\\x09-\\x0D]+`` are taken unchanged; null is a text without words. A word goes if a
    window of ``width`` consecutive words that covers it also starts earlier: in a smaller doc_id, or
    earlier in the same text. Rows that repeat a doc_id with another text count in order of the text's
    hash; rows equal in both are one document and get one answer each. Kept words are joined by a
    space. Null doc_ids come first; an empty table gives no rows.
    """
    ids = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), "text")
    repeated = bool(ids.groupBy("doc_id").count().filter("count > 1").limit(1).count())
    # a hash of the text tells rows of one doc_id apart, where there are any
    own = ids.select("doc_id", F.xxhash64("text").alias("row") if repeated else F.lit(0).cast("long").alias("row"), "text")
    # a clash of shortened keys only makes windows candidates; there is at most an anchor a word of two bytes
    size = ids.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    bits = min(63, 16 + int(size // 16).bit_length())
    found = materialize(own.mapInArrow(_keys(width, bits), "doc_id long, row long, keys array<long>"), "anchors")
    rows = found.select("doc_id", "row", F.explode("keys").alias("key"))
    again = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", F.ceil(F.col("n") / HOT).cast("int").alias("salts"))
    # written, so that the join has two plain exchanges and a frequent key's can be split
    again = materialize(again, "again")
    wanted = rows.join(again, "key").groupBy("doc_id", "row").agg(F.collect_set(F.struct("key", "salts")).alias("wanted"))
    wanted = materialize(wanted, "wanted")
    one = own.dropDuplicates(["doc_id", "row"]) if repeated else own
    # this join and the last one read the same exchange of the texts
    runs = one.join(wanted, ["doc_id", "row"]).select("doc_id", "row", "text", "wanted").mapInArrow(_windows(width, bits), "key long, salt int, hot boolean, doc_id long, row long, base int, ws array<long>")
    # equal windows have equal anchors, so they meet where their anchor's occurrences do; an anchor with
    # very many is dealt into salts, and what is first in its salt is compared once more
    dealt = runs.repartition("key", "salt")
    each = dealt.select("key", "salt", "hot", "doc_id", "row", F.posexplode("ws").alias("i", "w"), "base").select("key", "salt", "hot", "doc_id", "row", "w", (F.col("base") + F.col("i")).alias("start"))
    order = ["doc_id", "row", "start"]
    each = each.withColumn("nth", F.row_number().over(Window.partitionBy("key", "salt", "w").orderBy(*order)))
    first = each.filter("nth = 1 and hot")
    first = first.withColumn("nth", F.row_number().over(Window.partitionBy("key", "w").orderBy(*order)))
    later = each.filter("nth > 1").select(*order).unionByName(first.filter("nth > 1").select(*order))
    starts = later.groupBy("doc_id", "row").agg(F.collect_list("start").alias("starts"))
    left = own.join(starts, ["doc_id", "row"], "left").select("doc_id", "text", "starts")
    out = left.mapInArrow(_kept(width), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != -(2**63), F.col("doc_id")))
