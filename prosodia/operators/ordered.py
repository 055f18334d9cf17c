"""Order-dependent values over a whole table, or over keys of any size, without one task for all rows.

Rows are range-partitioned on all ordering columns and written once; each partition's totals (a row a
partition and key) give what comes before or after it, and windows run inside one partition's part of
a key. A key with a third of all rows spreads over many tasks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; a local master without that setting gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='prosodia-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a scratch table: nothing is computed twice, and a lost executor loses nothing of it."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ranges(df: DataFrame, order: list[Column | str]) -> DataFrame:
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    return written(df.repartitionByRange(n, *order).withColumn("__pid", F.spark_partition_id()), "ranges")


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], inclusive: bool = True) -> DataFrame:
    """Add, for each ``name: column``, its sum over all rows up to this one (or before it) in ``order``.

    ``order`` must tell all rows apart, or equal rows share an arbitrary order. Null terms count as 0.
    """
    terms = {f"__v_{k}": F.coalesce(c, F.lit(0)) for k, c in sums.items()}
    parted = _ranges(df.withColumns(terms), list(order))
    totals = parted.groupBy("__pid").agg(*[F.sum(t).alias(t) for t in terms])
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    bases = totals.select(F.col("__pid").alias("__p"), *[F.coalesce(F.sum(t).over(before), F.lit(0)).alias(f"__b{t}") for t in terms])
    inside = Window.partitionBy("__pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    out = parted.join(F.broadcast(bases), F.col("__pid") == F.col("__p"))
    for k in sums:
        out = out.withColumn(k, F.col(f"__b__v_{k}") + F.coalesce(F.sum(f"__v_{k}").over(inside), F.lit(0)))
    return out.select(*df.columns, *[k for k in sums if k not in df.columns])


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Rows numbered from 1 in ``order``."""
    return running(df, order, {name: F.lit(1).cast("long")})


def carried(df: DataFrame, key: str, order: list[str], before: dict[str, Column], after: dict[str, Column] | None = None) -> DataFrame:
    """Add the greatest of each ``before`` over earlier rows of the key and the least of each ``after`` over this and later ones.

    Ascending in ``order``; nulls are passed over; null without such a row. Rows without a key are left out.
    """
    after = after or {}
    values = {f"__v_{k}": c for k, c in {**before, **after}.items()}
    parted = _ranges(df.filter(F.col(key).isNotNull()).withColumns(values), [key, *order])
    edges = parted.groupBy("__pid", key).agg(*[(F.max if k in before else F.min)(f"__v_{k}").alias(f"__e_{k}") for k in {**before, **after}])
    up = Window.partitionBy(key).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(key).orderBy(F.desc("__pid")).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(
        F.col("__pid").alias("__p"),
        F.col(key).alias("__k"),
        *[(F.max(f"__e_{k}").over(up) if k in before else F.min(f"__e_{k}").over(down)).alias(f"__e_{k}") for k in {**before, **after}],
    )
    out = parted.join(edges, (F.col("__pid") == F.col("__p")) & (F.col(key) == F.col("__k")))
    rows = Window.partitionBy("__pid", key)
    inside = rows.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    later = rows.orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for k in before:
        out = out.withColumn(k, F.greatest(f"__e_{k}", F.max(f"__v_{k}").over(inside)))
    for k in after:
        out = out.withColumn(k, F.least(f"__e_{k}", F.min(f"__v_{k}").over(later)))
    return out.select(*df.columns, *before, *after)


def runs(df: DataFrame, key: str, t: str, order: list[str], cut: Column, name: str = "run") -> DataFrame:
    """Name each row by the time ``t`` of the row that begins its run: the last row up to it where ``cut`` holds.

    Runs that begin at the same time share a name; the first row of a key must be a cut.
    """
    out = carried(df.withColumn("__at", F.when(cut, F.col(t))), key, order, {"__begun": F.col("__at")})
    return out.withColumn(name, F.coalesce("__at", "__begun")).drop("__at", "__begun")


def gap_runs(df: DataFrame, key: str, t: str, order: list[str], gap: float) -> DataFrame:
    """Add run: rows of a key whose neighbours in time are at most ``gap`` apart share one."""
    out = carried(df, key, order, {"__last": F.col(t)})
    return runs(out, key, t, order, F.coalesce(F.col(t) - F.col("__last") > gap, F.lit(True))).drop("__last")
