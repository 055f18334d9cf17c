"""What the corpus operators share: scratch tables, distributed prefix sums, word fingerprints.

Scratch tables go below ``spark.checkpoint.dir``, the one folder that the driver and
every executor can see. A table written there cuts lineage without tying the rest of a
job to one executor's disk.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space; every other byte belongs to a word.
WHITESPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: The same characters for Spark's translate().
WHITESPACE_TEXT = "\t\n\x0b\x0c\r"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder; a local master without that setting gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='prosodia-')}"
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path in whichever file system holds it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to a scratch table and read it back: no recomputation, no local blocks."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def running_sums(df: DataFrame, order: list[str], sums: dict[str, str], group: str | None = None) -> DataFrame:
    """Add, for each ``new name -> long column``, the inclusive running sum in ``order``.

    With ``group`` the sums restart in each group, and ``order`` must begin with it. Rows are range
    partitioned on all ordering columns, so one group with a third of the rows still spreads over
    many tasks; each partition's base is the prefix sum of the partitions' totals. No task ever
    sorts more than one range, and only the totals (one row a partition and group) are summed in
    one place.
    """
    n = shuffle_width(df.sparkSession)
    keys = ["__pid"] + ([group] if group else [])
    parted = materialize(df.repartitionByRange(n, *order).withColumn("__pid", F.spark_partition_id()), "ranges")
    totals = parted.groupBy(*keys).agg(*[F.sum(c).alias(f"__t_{k}") for k, c in sums.items()])
    before = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        *[F.col(c).alias(f"__k_{c}") for c in keys],
        *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in sums],
    )
    on = [parted[c].eqNullSafe(bases[f"__k_{c}"]) for c in keys]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = parted.join(bases, on)
    for k, c in sums.items():
        out = out.withColumn(k, F.col(f"__b_{k}") + F.sum(c).over(inside))
    return out.drop("__pid", *[f"__k_{c}" for c in keys], *[f"__b_{k}" for k in sums])


def words_column(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` as an array; null text gives no words."""
    spaced = F.translate(F.coalesce(text, F.lit("")), WHITESPACE_TEXT, " " * len(WHITESPACE_TEXT))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- fingerprints in numpy -------------------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(WHITESPACE)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(int(_BASE), -1, 2**64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        up, down = np.full(size, _BASE), np.full(size, _UNBASE)
        up[0] = down[0] = 1
        _POWERS.clear()
        _POWERS[size] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POWERS[size]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolling(values: np.ndarray, n: int) -> np.ndarray:
    """64-bit fingerprints of all runs of n consecutive values, in one pass of prefix sums."""
    if len(values) < n:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(len(values))
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:], dtype=np.uint64)
    return mix((sums[n:] - sums[:-n]) * down[: len(values) - n + 1])


class Words:
    """The words of a run of texts: ``hash`` per word, and ``first[d]:first[d+1]`` those of text d."""

    def __init__(self, texts: pa.Array, lower: bool, apart: np.ndarray = _SPACE):
        """apart: of each byte, whether it parts words."""
        data, ends = text_bytes(texts)
        n = len(data)
        if lower:
            data = _LOWER[data]
        word = ~apart[data]
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        bounds = ends[:-1][ends[:-1] < n]
        begin[bounds] = word[bounds]
        end = word.copy()
        end[:-1] &= ~word[1:]
        last = ends[1:][ends[1:] > 0] - 1
        end[last] = word[last]
        self.begin, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.begin, ends)
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * up[:n], out=sums[1:], dtype=np.uint64)
        self.hash = mix((sums[self.end] - sums[self.begin]) * down[self.begin])
        self._sums, self._down = sums, down

    def prefixes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The words of n bytes or more, by number, and fingerprints of their first n bytes."""
        at = np.flatnonzero(self.end - self.begin >= n)
        b = self.begin[at]
        return at, mix((self._sums[b + n] - self._sums[b]) * self._down[b] + np.uint64(n))


def ascii_letters_apart() -> np.ndarray:
    """A table for Words: every ASCII byte but letters and digits parts words."""
    apart = np.arange(256) < 128
    apart[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
    return apart


def letters_table() -> np.ndarray:
    """A table for Words: every ASCII byte but letters parts words."""
    apart = np.arange(256) < 128
    apart[[*range(65, 91), *range(97, 123)]] = False
    return apart


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and the n + 1 offsets between them; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    buffers = texts.buffers()
    ends = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] else np.zeros(0, dtype=np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece has about ``most`` bytes of text or one row: whole rows, bounded memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = text_bytes(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def sum_arrays(parts: DataFrame, dtype: str, out: str | None = None) -> dict[int, np.ndarray]:
    """Element-wise sums of (chunk int, counts binary) rows of one dtype, per chunk, on the driver (as ``out``).

    Rows are added in two levels, by 64 tasks and then all, so no task holds more than a fixed number
    of arrays at once; what comes to the driver has a size fixed by the caller's arrays.
    """
    wide = "<i8" if np.dtype(dtype).kind in "iu" else "<f8"

    def add(group: pa.Table) -> pa.Table:
        total = None
        for c in group["counts"]:
            own = np.frombuffer(c.as_buffer(), dtype=wide if group["wide"][0].as_py() else dtype).astype(wide)
            total = own if total is None else total + own
        return pa.table({"chunk": group["chunk"].slice(0, 1), "counts": [total.tobytes()], "wide": [True]})

    schema = "chunk int, counts binary, wide boolean"
    def last(group: pa.Table) -> pa.Table:
        whole = add(group)
        return pa.table({"chunk": whole["chunk"], "counts": [np.frombuffer(whole["counts"][0].as_buffer(), dtype=wide).astype(out or wide).tobytes()]})

    once = parts.select("chunk", "counts", F.lit(False).alias("wide"), F.floor(F.spark_partition_id() / 64).alias("at")).groupBy("chunk", "at").applyInArrow(add, schema)
    return {r.chunk: np.frombuffer(r.counts, dtype=out or wide) for r in once.groupBy("chunk").applyInArrow(last, "chunk int, counts binary").collect()}


def word_counts(texts: DataFrame, apart: np.ndarray = _SPACE, shortest: int = 1, longest: int = 1 << 30) -> DataFrame:
    """word (fingerprint, A-Z lower-cased), n: exact counts of the words of (text) rows with so many bytes.

    Each piece of a task counts its own words before Spark adds them up, so a word that a third of all tokens
    share is one row a piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text="text"):
            words = Words(piece.column(0), lower=True, apart=apart)
            size = words.end - words.begin
            name, n = np.unique(words.hash[(size >= shortest) & (size <= longest)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    return texts.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The words (ascending) and counts of all that reach the least level of counts at which no more than ``most`` do.

    Levels are eighths of a doubling, so the choice depends on exact counts alone, however rows lie.
    """
    counts = materialize(counts.select("word", "n"), "words")
    level = F.floor(F.log2("n") * 8)
    levels = sorted(((r["level"], r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)  # a few hundred rows
    reach = [v for (v, _), upto in zip(levels, np.cumsum([c for _, c in levels]), strict=True) if upto <= most]
    top = sorted((r.word % (1 << 64), r.n) for r in counts.filter(level >= reach[-1]).collect()) if reach else []  # ``most`` rows
    return np.array([w for w, _ in top], dtype=np.uint64), np.array([n for _, n in top], dtype=np.int64)


def sample_rows(df: DataFrame, n: int, by: str | None = None) -> DataFrame:
    """At most ``n`` rows, those with the least hash of ``by`` (of all columns by default); all rows if there are no more.

    The bound is read off a table of counts by the first 16 bits of the hash, so no task gathers
    candidates of others and any run gives the same rows. Rows of equal hash stay or go together; only if all
    share one hash, so that none would be left, are ``n`` of these equal rows taken.
    """
    hashed = df.withColumn("__h", F.pmod(F.xxhash64(*([by] if by else df.columns)), F.lit(1 << 32)))
    # 65,536 rows at most
    counts = sorted((r["b"], r["count"]) for r in hashed.groupBy(F.shiftright("__h", 16).alias("b")).count().collect())
    upto = np.cumsum([c for _, c in counts])
    if not len(upto) or upto[-1] <= n:
        return df
    whole = int(np.searchsorted(upto, n, side="right"))
    bound = counts[whole][0] << 16
    room = n - (int(upto[whole - 1]) if whole else 0)
    # the bucket that the bound cuts is looked at by whole hashes
    inside = sorted((r["__h"], r["count"]) for r in hashed.filter(F.shiftright("__h", 16) == counts[whole][0]).groupBy("__h").count().orderBy("__h").limit(n).collect())
    for h, c in inside:
        if c > room:
            bound = h
            break
        room -= c
    some = hashed.filter(F.col("__h") < bound)
    if not whole and bound == inside[0][0]:
        some = hashed.filter(F.col("__h") == bound).limit(n)
    return some.drop("__h")
