"""Grids, folds and choices: cross joins of parameters, leave-one-out, rank by several keys."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def grid(spark: SparkSession, **axes: list) -> DataFrame:
    """All combinations of literal values, with grid_idx in order of the first axis, then the next."""
    rows = [(i, *values) for i, values in enumerate(product(*axes.values()))]
    return spark.createDataFrame(rows, ["grid_idx", *axes])


# The axes of the searches (contour settings, gates, segmentations).
CONTOUR_AXES = {
    "dip_db": [2.0, 3.0, 4.0, 5.0, 6.0, 7.0],
    "distance_s": [0.06, 0.08, 0.10, 0.12, 0.14],
    "gain_db": [0.0, 2.0, 4.0, 6.0, 8.0],
    "floor_db": [20.0, 25.0, 30.0, 35.0, 40.0],
}
GATE_AXES = {
    "periodicity": [0.0, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50],
    "strength": [0.0, 0.25, 0.30, 0.35, 0.40, 0.45],
    "vowel": [0.30, 0.35, 0.40, 0.45, 0.50, 0.55],
}
SEGMENT_AXES = {
    "norm": [2.2, 2.3, 2.4, 2.5, 2.6, 2.7, 2.8, 2.9, 3.0],
    "merge": [0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90],
}
VOTE_NORMS = [2.2, 2.3, 2.4, 2.5, 2.6, 2.7, 2.8, 2.9, 3.0, 3.1]
VOTE_MERGES = [0.65, 0.70, 0.75, 0.80, 0.85, 0.90]


def gate(candidates: DataFrame, settings: DataFrame) -> DataFrame:
    """Candidates that pass each setting; weak recoveries always do. Settings are a small literal table."""
    ok = F.col("weak_recovery") | ((F.col("c.periodicity") >= F.col("g.periodicity")) & (F.col("c.strength") >= F.col("g.strength")) & (F.col("c.vowel_likeness") >= F.col("g.vowel")))
    return candidates.alias("c").join(F.broadcast(settings.alias("g")), ok).select("g.grid_idx", "c.*")


def leave_one_out(df: DataFrame, key: str) -> DataFrame:
    """Each row once for every other recording as the one held out: fold, role (train or test)."""
    folds = df.select(F.col(key).alias("fold")).distinct()
    return df.crossJoin(F.broadcast(folds)).withColumn("role", F.when(F.col(key) == F.col("fold"), "test").otherwise("train"))


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_per(df: DataFrame, by: list[str], n: int, *order: Column) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")


class Nearest:
    """The ``most`` nearest by cosine of some vectors, kept while other vectors stream past.

    Products in single precision rule out what lies below a row's last place by more than their error; the rest
    is scored in double precision. An undefined cosine is the greatest, as in SQL's order; of equal ones the least id wins.
    """

    ROWS, COLUMNS = 512, 4096

    def __init__(self, own: np.ndarray, barred: np.ndarray, x: np.ndarray, most: int):
        """``barred`` tells which rows may not find their ``own`` id."""
        self.own, self.barred, self.x, self.most = own, barred, x, most
        self.norm, self.unit = self.units(x)
        self.key = np.full((len(x), most), -np.inf)
        self.id = np.full((len(x), most), np.iinfo(np.int64).max)

    @staticmethod
    def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = x.astype(np.float64)
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        fit = np.isfinite(norm)
        unit = np.zeros(x.shape, np.float32)
        unit[fit] = x[fit] / np.where(norm[fit] > 0, norm[fit], 1)[:, None]
        return norm, unit

    @staticmethod
    def keys(products: np.ndarray, norms: np.ndarray) -> np.ndarray:
        cosine = np.round(products / (norms + 1e-8), 12)
        return np.where(np.isnan(cosine), np.inf, cosine)

    def meet(self, ids: np.ndarray, y: np.ndarray) -> None:
        with np.errstate(all="ignore"):
            for c in range(0, len(ids), self.COLUMNS):
                self._meet(ids[c : c + self.COLUMNS], y[c : c + self.COLUMNS])

    def _meet(self, ids: np.ndarray, y: np.ndarray) -> None:
        norm, unit = self.units(y)
        odd = ~np.isfinite(norm)
        least = norm[(norm > 0) & ~odd].min(initial=np.inf)
        for s in range(0, len(self.x), self.ROWS):
            at = slice(s, s + self.ROWS)
            last = self.key[at, -1]
            near = None
            if np.isfinite(last).all() and np.isfinite(self.norm[at]).all():
                # sums of single products err by a part in 2^23 a dimension, the 1e-8 below the fraction by 1e-8 over both lengths
                slack = 1.2e-7 * y.shape[1] + 2e-6 + 1e-8 / (np.where(self.norm[at] > 0, self.norm[at], np.inf) * least)
                near = self.unit[at] @ unit.T >= (last - slack).astype(np.float32)[:, None]
                near[:, odd] = True
                r, c = self._true(near)
            if near is None or len(r) * 16 > near.size:
                r, c, key = self._all(at, ids, y, norm)
            else:
                key = np.concatenate([np.empty(0), *(self._some(s + r[i : i + 8192], c[i : i + 8192], y, norm) for i in range(0, len(r), 8192))])
            use = (key >= last[r]) & ~(self.barred[s + r] & (ids[c] == self.own[s + r])) if len(r) else np.zeros(0, bool)
            if use.any():
                self._merge(s + r[use], key[use], ids[c[use]])

    @staticmethod
    def _true(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat = near.ravel()
        if flat.size % 8:
            return np.nonzero(near)
        # true cells are rare: eight at a time
        eight = np.flatnonzero(flat.view(np.uint64))
        where = (eight[:, None] * 8 + np.arange(8)).ravel()
        return np.divmod(where[flat[where]], near.shape[1])

    def _some(self, r: np.ndarray, c: np.ndarray, y: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return self.keys(np.einsum("ij,ij->i", self.x[r].astype(np.float64), y[c].astype(np.float64)), self.norm[r] * norm[c])

    def _all(self, at: slice, ids: np.ndarray, y: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key = self.keys(self.x[at].astype(np.float64) @ y.astype(np.float64).T, self.norm[at][:, None] * norm[None, :])
        key[(ids[None, :] == self.own[at][:, None]) & self.barred[at][:, None]] = -np.inf
        from_ = np.full(len(key), -np.inf) if len(ids) <= self.most else np.partition(key, len(ids) - self.most, axis=1)[:, len(ids) - self.most]
        r, c = np.nonzero((key >= from_[:, None]) & (key > -np.inf))
        return r, c, key[r, c]

    def _merge(self, r: np.ndarray, key: np.ndarray, ids: np.ndarray) -> None:
        rows = np.unique(r)
        all_r = np.concatenate([np.repeat(rows, self.most), r])
        all_key, all_id = np.concatenate([self.key[rows].ravel(), key]), np.concatenate([self.id[rows].ravel(), ids])
        order = np.lexsort((all_id, -all_key, all_r))
        first = np.searchsorted(all_r[order], rows)
        keep = order[(first[:, None] + np.arange(self.most)).ravel()]
        self.key[rows], self.id[rows] = all_key[keep].reshape(-1, self.most), all_id[keep].reshape(-1, self.most)

    def found(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of the kept rows, ids and cosines, a piece at a time."""
        for s in range(0, len(self.x), 1024):
            r, k = np.nonzero(self.key[s : s + 1024] > -np.inf)
            key = self.key[s + r, k]
            yield s + r, self.id[s + r, k], np.where(np.isinf(key), np.nan, key)


def cosine_neighbours(df: DataFrame, n: int, block: int = 65536, part: int = 1 << 19) -> DataFrame:
    """a, b, cosine: for every row of (vec_id, v) the n others nearest by cosine; of equal ones the least id.

    Equal vectors are met once: of them the n + 1 least ids can be anyone's neighbours, and one search serves them all.
    Distinct vectors meet each other in cells of at most about ``block`` rows, held by a task, and ``part`` rows that stream past
    it. Vectors have one length; rows without an id or a vector are left out. Cosines are equal if they are so at 12 decimals.
    """
    width = 3 * df.sparkSession.sparkContext.defaultParallelism
    single = df.schema["v"].dataType.simpleString() == "array<float>"
    known = df.filter("vec_id is not null and v is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v") if single else F.col("v").cast("array<double>").alias("v"))
    # an id of several rows is no neighbour of any of them: these rows search for themselves
    again = known.groupBy("vec_id").count().filter("count > 1").select("vec_id", F.col("vec_id").alias("own"))
    copies = Window.partitionBy("v").orderBy(F.col("own").isNotNull(), "vec_id")
    rows = known.join(again, "vec_id", "left").withColumn("lead", F.first("vec_id").over(copies)).withColumn("nth", F.row_number().over(copies))
    left, right = F.col("own").isNotNull() | (F.col("nth") == 1), F.col("own").isNotNull() | (F.col("nth") <= n + 1)
    n_left, n_right = rows.agg(F.count_if(left), F.count_if(right)).first()
    lefts, rights = max(-(-n_left // block), min(width, -(-n_left // 1024)), 1), -(-n_right // part) or 1
    deal = lambda most: F.pmod(F.xxhash64("vec_id", "v"), F.lit(most)).cast("int")
    every = lambda most: F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    held = rows.filter(left).select(deal(lefts).alias("i"), every(rights).alias("j"), F.lit(0).alias("side"), "vec_id", "own", "v")
    passing = rows.filter(right).select(every(lefts).alias("i"), deal(rights).alias("j"), F.lit(1).alias("side"), "vec_id", "own", "v")
    cells = held.unionByName(passing).select((F.col("i") * rights + F.col("j")).alias("cell"), "side", "vec_id", "own", "v")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, nearest = None, [], None

        def found():
            for r, b, cosine in nearest.found() if nearest else ():
                yield pa.RecordBatch.from_arrays([pa.array(nearest.own[r]), pa.array(b), pa.array(cosine, from_pandas=False)], ["a", "b", "cosine"])

        for batch in batches:
            at, side, ids = (batch.column(c).to_numpy() for c in ("cell", "side", "vec_id"))
            cuts = [0, *(np.flatnonzero(np.diff(at) | np.diff(side)) + 1).tolist(), len(ids)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s == e:
                    continue
                if at[s] != cell:
                    yield from found()
                    cell, held, nearest = at[s], [], None
                x = batch.column("v").slice(s, e - s).flatten().to_numpy(zero_copy_only=False).reshape(e - s, -1)
                if side[s] == 0:
                    own = batch.column("own").slice(s, e - s)
                    held.append((ids[s:e], own.is_valid().to_numpy(zero_copy_only=False), x))
                elif held:
                    nearest = nearest or Nearest(*(np.concatenate([h[i] for h in held]) for i in range(3)), n + 1)
                    nearest.meet(ids[s:e], x)
        yield from found()

    met = cells.repartitionById(lefts * rights, "cell").sortWithinPartitions("cell", "side").mapInArrow(search, "a long, b long, cosine double")
    best = top_per(met, ["a"], n + 1, F.desc("cosine"), F.col("b")) if rights > 1 else met
    served = rows.select(F.col("vec_id").alias("to"), F.when(F.col("own").isNull(), F.col("lead")).otherwise(F.col("vec_id")).alias("a")).distinct()
    found = served.join(best, "a").filter("to <> b").select(F.col("to").alias("a"), "b", "cosine")
    return top_per(found, ["a"], n, F.desc("cosine"), F.col("b"))


def first_best(df: DataFrame, by: list[str], keys: list[Column], index: str = "grid_idx") -> DataFrame:
    """Per group the row with the greatest keys; of equal rows the least grid index."""
    return df.groupBy(*by).agg(F.max(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], (-F.col(index)).alias("neg"))).alias("b")).select(*by, (-F.col("b.neg")).alias(index), *[F.col(f"b.k{i}") for i in range(len(keys))])


def eligible_best(df: DataFrame, eligible: Column, *order: Column) -> DataFrame:
    """The best row among the eligible ones, or among all if none is."""
    return df.orderBy((~eligible).cast("int"), *order).limit(1)


def export_limit(df: DataFrame, order: list[str], most: int | None) -> DataFrame:
    """Rows numbered from 1 in order, up to ``most``."""
    out = df if most is None else df.orderBy(*order).limit(most)
    return out.withColumn("number", F.row_number().over(Window.orderBy(*order)))


def quantile_grid(values: list[float], levels: list[float]) -> list[float]:
    import numpy as np

    return sorted(set(np.quantile(np.asarray(values), levels).tolist())) if len(values) else []
