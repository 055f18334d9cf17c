"""Hard negatives by a vector-approximation file.

Vectors become integers, are range-partitioned by (length, label) and packed into bins: a bin holds the
exact integers of its vectors and, dimension by dimension, the cell of each in a grid of ``CELLS``
equal cells between the bin's own least and greatest value. Anchors are packed into blocks, and each
block goes once to each bin. There a table of an anchor's products with the cells' edges gives, by look-up and
addition, a lower bound of its score with every vector; the cells' widths give the upper one.
Only vectors whose bounds let them be among the best (positives) or inside a window and among its best
(negatives) are scored exactly. Two passes: positives among vectors of the anchor's label, then, with
the windows that their scores open, negatives among all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosodia.llm.shared import materialize, shuffle_width

#: Cells a dimension; bytes of a bin and anchors of a block, about; anchors bounded together.
CELLS, BIN_BYTES, BLOCK, TOGETHER = 64, 8 << 20, 256, 64
#: Scores stay within this by the inequality of Cauchy and Schwarz.
MOST = float(1 << 62)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v of the rows with a label and a vector without null or non-finite components."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return v.filter(F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(F.forall("v", fine), F.lit(False)))


def integers(v: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of vectors of one length, and which of them have scores that fit 64 bits."""
    x = np.floor(v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) * float(scale))
    with np.errstate(over="ignore"):
        fits = (x**2).sum(axis=1) < MOST
    return np.where(fits[:, None], x, 0).astype(np.int64), fits


def narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type that holds them."""
    most = int(np.abs(x).max(initial=0))
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


BIN = "pid int, k int, d int, size int, labels binary, ids binary, known binary, wide int, exact binary, low binary, step binary, cells binary"


def _pack(scale: int):
    """mapInArrow over (d, label, vec_id, v) sorted by (d, label): bins of vectors of one length."""
    names = [c.split()[0] for c in BIN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, k, held, d = TaskContext.get().partitionId(), 0, [], None

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal k, held
            label, ids, known, x = (np.concatenate(c) for c in zip(*held, strict=True))
            held = []
            if not len(x):
                return
            low = x.min(axis=0)
            step = (x.max(axis=0) - low) // CELLS + 1
            small = narrow(x)
            cells = np.ascontiguousarray(((x - low) // step).astype(np.uint8).T)
            row = [pid, k, x.shape[1], len(x), *(c.tobytes() for c in (label, ids, known)), small.itemsize, *(c.tobytes() for c in (small, low, step, cells))]
            k += 1
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary() if isinstance(c, bytes) else pa.int32()) for c in row], names=names)

        for batch in batches:
            lengths = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(lengths)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and lengths[a] != d:
                    yield from close()
                d = int(lengths[a]) if a < b else d
                room = max(64, BIN_BYTES // (3 * d)) if d else 0
                while a < b:
                    take = min(b - a, room - sum(len(h[0]) for h in held))
                    part = batch.slice(a, take)
                    x, fits = integers(part.column(3), scale)
                    ids = part.column(2)
                    held.append((part.column(1).to_numpy()[fits], ids.fill_null(0).to_numpy()[fits], ids.is_valid().to_numpy(zero_copy_only=False)[fits], x[fits]))
                    a += take
                    if sum(len(h[0]) for h in held) >= room:
                        yield from close()
        if held:
            yield from close()

    return run


def _blocks(scale: int):
    """applyInArrow: the anchors of one (d, block) as one row."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("vec_id", "ascending"), ("label", "ascending")])
        x, fits = integers(group["v"].combine_chunks(), scale)
        ids, labels = (group[c].to_numpy()[fits].astype(np.int64) for c in ("vec_id", "label"))
        return pa.table({"d": pa.array([x.shape[1]], pa.int32()), "block": group["block"].slice(0, 1), "names": [ids.tolist()], "ids": [ids.tobytes()], "labels": [labels.tobytes()], "exact": [x[fits].tobytes()]})

    return run


class Bin:
    """One bin's vectors and their cells."""

    def __init__(self, row: dict):
        n, d = row["size"], row["d"]
        self.d, self.labels, self.ids, self.known = d, np.frombuffer(row["labels"], np.int64), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], np.bool_)
        self.x = np.frombuffer(row["exact"], np.dtype(f"i{row['wide']}")).reshape(n, d)
        self.low, self.step, self.cells = np.frombuffer(row["low"], np.int64), np.frombuffer(row["step"], np.int64), np.frombuffer(row["cells"], np.uint8).reshape(d, n)
        self.reach = np.maximum(np.abs(self.low), np.abs(self.low + self.step * CELLS))

    def bounds(self, anchors: np.ndarray, part: slice) -> tuple[np.ndarray, np.ndarray]:
        """Lower bounds (anchors x vectors of ``part``) and what to add to them for upper ones (by anchor)."""
        most = float((np.abs(anchors).max(axis=0).astype(np.float64) * self.reach).sum())
        if most >= MOST:
            return np.stack([self.exact(a, np.arange(part.start, part.stop)) for a in anchors]), np.zeros(len(anchors), dtype=np.int64)
        kind = np.int32 if most < 1 << 31 else np.int64
        edges = self.low[:, None] + self.step[:, None] * np.arange(CELLS)
        out = np.zeros((part.stop - part.start, len(anchors)), dtype=kind)
        look = np.empty_like(out)
        for j in range(self.d):
            table = np.minimum(edges[j][:, None] * anchors[:, j], (edges[j] + self.step[j] - 1)[:, None] * anchors[:, j]).astype(kind)
            np.take(table, self.cells[j, part], axis=0, out=look, mode="clip")
            out += look
        return np.ascontiguousarray(out.T), np.abs(anchors) @ (self.step - 1)

    def exact(self, anchor: np.ndarray, at: np.ndarray) -> np.ndarray:
        x = self.x[at]
        if float(np.abs(anchor).astype(np.float64) @ self.reach) < 1 << 53:
            return (x.astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64)
        return (x.astype(np.int64) * anchor).sum(axis=1)

    def best(self, score: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Of the vectors ``at`` the n of greatest score; of equal ones the least id, those without one last."""
        return np.lexsort((self.ids[at], ~self.known[at], -score))[:n]


def kth(values: np.ndarray, k: int):
    """The k-th greatest value, or None if there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else None


def positives_of(bin_: Bin, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, n: int) -> Iterator[tuple[int, int, int | None]]:
    """(anchor's place, score, id) of the n best of each anchor's label in the bin."""
    for label in np.unique(labels):
        at = np.flatnonzero(bin_.labels == label)  # vectors of a label lie side by side
        if not len(at):
            continue
        part = slice(int(at[0]), int(at[-1]) + 1)
        own = np.flatnonzero(labels == label)
        for s in range(0, len(own), TOGETHER):
            some = own[s : s + TOGETHER]
            lower, width = bin_.bounds(x[some], part)
            for i, low, w in zip(some.tolist(), lower, width.tolist(), strict=True):
                other = ~bin_.known[part] | (bin_.ids[part] != ids[i])
                floor = kth(low[other], n)
                left = np.flatnonzero(other if floor is None else other & (low >= floor - w)) + part.start
                score = bin_.exact(x[i], left)
                for b in bin_.best(score, left, n).tolist():
                    yield i, int(score[b]), int(bin_.ids[left[b]]) if bin_.known[left[b]] else None


def negatives_of(bin_: Bin, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, windows: dict[int, list[tuple[int, int, int]]], n: int) -> Iterator[tuple[int, int, int, int | None]]:
    """(anchor's place, window, score, id) of the n best inside each window (its number, least and greatest score)."""
    whole, own = slice(0, len(bin_.ids)), np.array(sorted(windows), dtype=np.int64)
    for s in range(0, len(own), TOGETHER):
        some = own[s : s + TOGETHER]
        lower, width = bin_.bounds(x[some], whole)
        for i, low, w in zip(some.tolist(), lower, width.tolist(), strict=True):
            spans = windows[i]
            other = (bin_.labels != labels[i]) & (~bin_.known | (bin_.ids != ids[i]))
            at = np.flatnonzero(other & (low >= min(a for _, a, _ in spans) - w) & (low <= max(b for _, _, b in spans)))
            low, chosen = low[at].astype(np.int64), []
            for _, a, b in spans:
                inside = (low >= a - w) & (low <= b)
                floor = kth(low[(low >= a) & (low <= b - w)], n)  # these are inside for certain
                chosen.append(np.flatnonzero(inside if floor is None else inside & (low >= floor - w)))
            wanted = np.unique(np.concatenate(chosen))
            score = bin_.exact(x[i], at[wanted])
            for k, a, b in spans:
                fits = np.flatnonzero((score >= a) & (score <= b))
                for c in fits[bin_.best(score[fits], at[wanted[fits]], n)].tolist():
                    v = at[wanted[c]]
                    yield i, k, int(score[c]), int(bin_.ids[v]) if bin_.known[v] else None


def _meet(find, fields: list[str]):
    """mapInArrow over rows sorted by (bin, kind): the bin (kind 0), then blocks of anchors that meet it."""
    schema = pa.schema([("block", pa.int64()), *((f, pa.int32() if f in ("place", "window") else pa.int64()) for f in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bin_ = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if row["kind"] == 0:
                    now, bin_ = row["bin"], Bin(row)
                elif row["bin"] == now and row["d"] == bin_.d:
                    found = list(find(bin_, row))
                    if found:
                        columns = list(zip(*found, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(found), pa.int64()), *(pa.array(c, schema.field(f).type) for f, c in zip(fields, columns, strict=True))], schema=schema)

    return run


def _of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), np.frombuffer(row["exact"], np.int64).reshape(-1, row["d"])


def mine(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from (vec_id, label, embedding).

    Anchors are the rows whose vec_id is divisible by ``every``; their positives the first ``positives``
    rows of the same label and another vec_id; for each, the first ``negatives`` rows of another label and vec_id with
    least * positive_score <= 100 * negative_score <= most * positive_score. Scores are inner products of
    floor(scale * x); higher ones come first, of equal ones the smaller vec_id, a null one last. A negative
    positive_score opens no window.

    Rows take no part if the label or vector is null, the vector is empty or has a null or non-finite component,
    or its squared length as integers reaches 2**62, so that scores would not fit. Vectors of
    unlike lengths don't meet. Rows without a vec_id are candidates and never anchors. A repeated row
    is a candidate each time and one anchor. Other columns are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    width = shuffle_width(spark)
    rows = usable(vectors).select(F.size("v").alias("d"), "label", "vec_id", "v")
    own = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    count = own.count()
    if not count:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    spread = F.xxhash64("vec_id", "v")
    bins = rows.repartitionByRange(width, "d", "label", spread).sortWithinPartitions("d", "label").mapInArrow(_pack(scale), BIN)
    bins = materialize(bins, "bins")
    # as many rows as range partitions
    per = {r.pid: r.n for r in bins.groupBy("pid").agg(F.count("*").alias("n")).collect()}
    upto = np.concatenate([[0], np.cumsum([per.get(p, 0) for p in range(max(per, default=0) + 1)])]).tolist()
    number = (F.element_at(F.lit(upto), F.col("pid") + 1) + F.col("k")).cast("long").alias("bin")

    blocks = own.dropDuplicates(["vec_id", "label", "v"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(-(-count // BLOCK))))
    blocks = materialize(blocks.select("d", "block", "vec_id", "label", "v").groupBy("d", "block").applyInArrow(_blocks(scale), "d int, block long, names array<long>, ids binary, labels binary, exact binary"), "blocks")
    blocks = blocks.withColumn("block", F.col("block") * F.lit(1 << 32) + F.col("d"))
    fields = ["kind", "bin", "d", "size", "labels", "ids", "known", "wide", "exact", "low", "step", "cells", "block", "windows"]
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    spans = "array<struct<place:int,window:int,a:long,b:long>>"
    packed = bins.select(F.lit(0).alias("kind"), number, "d", "size", "labels", "ids", "known", "wide", "exact", "low", "step", "cells", none("block", "long"), none("windows", spans)).select(*fields)
    visit = lambda df: df.select(F.lit(1).alias("kind"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(upto[-1] - 1).cast("long"))).alias("bin"), "d", none("size", "int"), "labels", "ids", none("known", "binary"), none("wide", "int"), "exact", *(none(c, "binary") for c in ("low", "step", "cells")), "block", "windows").select(*fields)
    if not upto[-1]:
        packed = packed.limit(0)
    together = lambda df: packed.unionByName(visit(df)).repartition(width, "bin").sortWithinPartitions("bin", "kind")

    near = together(blocks.select("*", none("windows", spans))).mapInArrow(_meet(lambda b, r: positives_of(b, *_of(r), positives), ["place", "score", "id"]), "block long, place int, score long, id long")
    order = lambda by, s, i: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(s), F.asc_nulls_last(i)))
    chosen = materialize(near.withColumn("window", order(["block", "place"], "score", "id")).filter(F.col("window") <= positives), "positives")

    # least * p <= 100 * n <= most * p, as bounds of n
    lower, upper = F.ceil(F.col("score").cast("decimal(30,0)") * least / 100).cast("long"), F.floor(F.col("score").cast("decimal(30,0)") * most / 100).cast("long")
    opened = chosen.filter("score >= 0").groupBy("block").agg(F.collect_list(F.struct("place", "window", lower.alias("a"), upper.alias("b"))).alias("windows"))
    asked = blocks.join(opened, "block")

    def inside(b: Bin, row: dict) -> Iterator[tuple]:
        windows: dict[int, list[tuple[int, int, int]]] = {}
        for w in row["windows"]:
            windows.setdefault(w["place"], []).append((w["window"], w["a"], w["b"]))
        return negatives_of(b, *_of(row), windows, negatives)

    far = together(asked).mapInArrow(_meet(inside, ["place", "window", "score", "id"]), "block long, place int, window int, score long, id long")
    far = far.withColumn("rank", order(["block", "place", "window"], "score", "id")).filter(F.col("rank") <= negatives)
    names = blocks.select("block", F.posexplode("names").alias("place", "anchor_id"))
    pairs = chosen.select("block", "place", "window", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(names, ["block", "place"])
    out = far.select("block", "place", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["block", "place", "window"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

