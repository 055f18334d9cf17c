"""Approximate nearest neighbours by inner product: an inverted multi-index.

Each vector is cut in two halves, each quantised by its own codebook of K centroids, so K * K cells
cost only 2 * K centroids. A query scores both codebooks and walks the pairs of centroids in order
of their summed inner product with a heap until the cells it has met hold enough vectors; those
are reranked with the exact measure in double precision.

Every vector is indexed. Exact copies are one entry with the smallest ids of the group, so a vector
that a third of all rows share costs no more than another. Cells are packed into bins (large cells cut
into several). The index is dealt to its bins once, and each query to the bins of the cells it visits; within
a bin the index comes first and queries stream past it, so a task holds one bin and one batch of queries.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosodia.llm.shared import materialize, sample_rows, shuffle_width

#: Vectors that the codebooks are fitted on, and of them those that give each query a floor, at most.
SAMPLE, FLOORS = 20_000, 8_192
#: Centroids a half at most, and vectors a centroid below that.
CENTROIDS, PER_CENTROID = 256, 4
#: Share of the distinct vectors whose cells a query visits. Vectors without structure need so many for a
#: recall of 0.9; clustered ones a tenth.
SHARE = 0.36
#: Vectors in a bin, about.
BIN = 2_048


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector without null or non-finite components that isn't all zero."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return v.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(F.forall("v", fine), F.lit(False)) & F.exists("v", lambda x: x != 0))


def distinct_vectors(vectors: DataFrame, keep: int) -> DataFrame:
    """uid (the smallest id), v, ids (the ``keep`` smallest, ascending): one row a distinct vector."""
    salted = vectors.withColumn("__salt", F.pmod(F.xxhash64("vec_id"), F.lit(1024)))
    for by in (["v", "__salt"], ["v"]):
        salted = salted.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).filter(F.col("__n") <= keep)
    return salted.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.element_at("ids", 1).alias("uid"), "v", "ids")


def kmeans(points: np.ndarray, k: int, rounds: int = 20, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), size=min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(points @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
        for j in range(len(centres)):
            own = points[near == j]
            centres[j] = own.mean(axis=0) if len(own) else points[rng.integers(len(points))]
    return centres


def walk(first: np.ndarray, second: np.ndarray, cells: np.ndarray, held: np.ndarray, enough: int) -> float:
    """The sum first[i] + second[j] down to which cells hold ``enough`` vectors, or minus infinity.

    ``cells`` are the occupied ones (i * K + j, ascending), ``held`` their vectors. Those of one i in falling order of
    second[j] are a row; a heap over the rows' heads gives all pairs by falling sum.
    """
    i, j = cells // len(second), cells % len(second)
    order = np.lexsort((-second[j], i))
    sums, held = (first[i] + second[j])[order].tolist(), held[order].tolist()
    begin = np.flatnonzero(np.append(True, np.diff(i) != 0))
    ends = np.append(begin[1:], len(i)).tolist()
    heap = [(-sums[at], at, end) for at, end in zip(begin.tolist(), ends, strict=True)]
    heapq.heapify(heap)
    got = 0
    while heap:
        s, at, end = heap[0]
        got += held[at]
        if got >= enough:
            return -s
        if at + 1 < end:
            heapq.heapreplace(heap, (-sums[at + 1], at + 1, end))
        else:
            heapq.heappop(heap)
    return -math.inf


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _scores(q: np.ndarray, left: np.ndarray, right: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray]:
    return q[:, :cut] @ left.T, q[:, cut:] @ right.T


def _best(q: np.ndarray, qids: list[int], least: np.ndarray, floors: np.ndarray, index: tuple, books: tuple, cut: int, k: int, out: dict[str, list]) -> None:
    """Queries against one bin of the index: each one's best entries in cells it visits until they hold k ids."""
    v, cell, uid, ids = index
    left, right = books
    s1, s2 = _scores(q, left, right, cut)
    # sums and single precision are off by no more
    slack = 1e-7 * q.shape[1] * np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1).max()
    rough = q.astype(np.float32) @ v.astype(np.float32).T
    fine = (s1[:, cell // len(right)] + s2[:, cell % len(right)] >= (least - 1e-9)[:, None]) & (rough >= (floors - slack)[:, None])
    for r in np.flatnonzero(fine.any(axis=1)).tolist():
        own = np.flatnonzero(fine[r])
        if len(own) > 3 * k:
            own = own[rough[r, own] >= np.partition(rough[r, own], -3 * k)[-3 * k] - slack[r]]
        exact = (v[own] * q[r]).sum(axis=1)
        held: set[int] = set()
        for i in np.lexsort((uid[own], -exact)):
            out["query_id"].append(qids[r])
            out["score"].append(float(exact[i]))
            out["ids"].append(ids[own[i]])
            held.update(ids[own[i]])
            if len(held) >= k:
                break


def _rerank(shared, cut: int, k: int):
    """mapInArrow over rows sorted by (bin, kind): a bin's index (kind 0), then the queries that visit it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, index = None, [], None
        for b in batches:
            bins, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(bins) != 0) | (np.diff(kinds) != 0)) + 1
            out: dict[str, list] = {"query_id": [], "score": [], "ids": []}
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if start == stop:
                    continue
                part = b.slice(start, stop - start)
                if bins[start] != now:
                    now, parts, index = bins[start], [], None
                if kinds[start] == 0:
                    parts.append(part)
                    continue
                if parts:
                    t = pa.Table.from_batches(parts)
                    index, parts = (_matrix(t["v"]), t["cell"].to_numpy(), t["id"].to_numpy(), t["ids"].to_pylist()), []
                for at in range(0, part.num_rows if index is not None else 0, 512):
                    some = part.slice(at, 512)
                    _best(_matrix(some.column(3)), some.column(2).to_pylist(), some.column(5).to_numpy(), some.column(6).to_numpy(), index, shared.value, cut, k, out)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("query_id", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))]))

    return run


def search(vectors: DataFrame, k: int = 20, every: int = 20, share: float = SHARE, centroids: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best for each row whose vec_id is divisible by ``every``.

    A query visits cells until they hold ``share`` of the distinct vectors and 2 * k + 2 at least; measured recall is in the
    README. A sampled vector of a visited cell is a candidate itself, so the (k + 1)th best of those
    bounds what can be among the k best; worse candidates don't leave their task. Vectors that are null,
    zero, of another length than the most common one or with null or non-finite components take no
    part. Ties go to the smaller vec_id. Rows that repeat a vec_id are one candidate, and as queries one
    query, with the best score of any of their vectors. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    good = usable(vectors)
    length = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return spark.createDataFrame([], schema)
    good = good.filter(F.size("v") == length.d).dropDuplicates(["vec_id", "v"])
    unique = materialize(distinct_vectors(good, k + 1), "vectors")
    n = unique.count()
    cut = length.d // 2 or 1
    # at most SAMPLE rows
    sample = np.array([r.v for r in sample_rows(unique.select("uid", "v"), SAMPLE).orderBy("uid", "v").select("v").collect()], dtype=np.float32)
    many = centroids or min(CENTROIDS, max(16, n // PER_CENTROID))
    books = spark.sparkContext.broadcast((kmeans(sample[:, :cut], many), kmeans(sample[:, cut:], many) if length.d > 1 else np.zeros((1, 0), dtype=np.float32)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = books.value
        near = lambda x, c: np.argmax(x @ c.T - 0.5 * (c**2).sum(axis=1), axis=1)
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column(1)).astype(np.float32)
                cell = near(v[:, :cut], left) * len(right) + near(v[:, cut:], right)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], names=["uid", "v", "ids", "cell"])

    index = materialize(unique.select("uid", "v", "ids").mapInArrow(assign, "uid long, v array<double>, ids array<long>, cell int"), "index")
    # at most CENTROIDS ** 2 rows
    sizes = sorted((r["cell"], r["count"]) for r in index.groupBy("cell").count().collect())
    cells, held = (np.array(x, dtype=np.int64) for x in zip(*sizes, strict=True))
    first_bin, cuts = np.zeros(len(cells), dtype=np.int64), -(-held // BIN)
    at, room = 0, BIN
    for c, size in enumerate(held.tolist()):
        if size > room and room < BIN:
            at, room = at + 1, BIN
        first_bin[c] = at
        if cuts[c] > 1:
            at, room = at + int(cuts[c]), BIN
        else:
            room -= size
    enough = max(2 * k + 2, math.ceil(share * n))
    few = np.unique(sample[:FLOORS], axis=0)
    near = lambda x, c: np.argmax(x @ c.T - 0.5 * (c**2).sum(axis=1), axis=1)
    few_cells = np.stack([near(few[:, :cut], books.value[0]), near(few[:, cut:], books.value[1])])
    plan = spark.sparkContext.broadcast((cells, held, first_bin, cuts, few, few_cells))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = books.value
        cells, held, first_bin, cuts, few, few_cells = plan.value
        wide = np.flatnonzero(cuts > 1)
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                q = _matrix(part.column(1))
                s1, s2 = _scores(q, left, right, cut)
                rough = q.astype(np.float32) @ few.T
                row, bins, least, floors = [], [], np.empty(len(q)), np.full(len(q), -math.inf)
                for r in range(len(q)):
                    least[r] = walk(s1[r], s2[r], cells, held, enough)
                    met = s1[r][cells // len(right)] + s2[r][cells % len(right)] >= least[r] - 1e-9
                    own = [first_bin[met], *(first_bin[c] + np.arange(1, cuts[c]) for c in wide[met[wide]])]
                    bins.append(np.unique(np.concatenate(own)))
                    row.append(np.full(len(bins[-1]), r))
                    mine = rough[r, s1[r][few_cells[0]] + s2[r][few_cells[1]] >= least[r] + 1e-9]
                    if len(mine) > k:
                        floors[r] = np.partition(mine, -k - 1)[-k - 1]
                row = np.concatenate(row)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(bins)), part.column(0).take(take), part.column(1).take(take), pa.array(least[row]), pa.array(floors[row])], names=["bin", "id", "v", "least", "floor"])

    queries = good.filter(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "v").repartition(shuffle_width(spark), F.xxhash64("vec_id"))
    asked = queries.mapInArrow(visit, "bin long, id long, v array<double>, least double, floor double")
    asked = asked.select("bin", F.lit(1).alias("kind"), "id", "v", F.lit(None).cast("int").alias("cell"), "least", "floor", F.lit(None).cast("array<long>").alias("ids"))
    # a row an occupied cell, CENTROIDS ** 2 at most
    place = spark.createDataFrame(list(zip(cells.tolist(), first_bin.tolist(), cuts.tolist(), strict=True)), "cell int, bin0 long, cuts long")
    dealt = index.join(F.broadcast(place), "cell").select((F.col("bin0") + F.pmod(F.xxhash64("uid", "v"), F.col("cuts"))).alias("bin"), F.lit(0).alias("kind"), F.col("uid").alias("id"), "v", "cell", F.lit(None).cast("double").alias("least"), F.lit(None).cast("double").alias("floor"), "ids")
    met = dealt.unionByName(asked).repartition(shuffle_width(spark), "bin").sortWithinPartitions("bin", "kind")
    found = met.mapInArrow(_rerank(books, cut, k + 1), "query_id long, score double, ids array<long>")
    best = found.select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
