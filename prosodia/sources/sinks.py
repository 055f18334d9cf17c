"""Outputs: records, tables with a byte order mark, reports, clips, grids, manifests."""

from __future__ import annotations

import codecs
import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from prosodia.sources.files import RATE, encode_wave
from prosodia.sources.grids import GridSource, render
from prosodia.sources.stores import StagedWriter, store


def write_records(records: DataFrame, path: str, single: bool = False) -> None:
    """Nested records as JSON, a line a recording."""
    (records.coalesce(1) if single else records).write.json(path)


class MarkedCsvWriter(StagedWriter):
    """A part a task, each with a byte order mark and the header; nulls are empty."""

    def __init__(self, path: str, overwrite: bool, columns: list[str], name: str | None):
        super().__init__(path, overwrite)
        self.columns, self.name = columns, name

    def parts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[bytes]]]:
        from pyspark import TaskContext

        yield self.name or f"part-{TaskContext.get().partitionId():05d}.csv", self.lines(batches)

    def lines(self, batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        def rendered(rows: list[list]) -> bytes:
            out = io.StringIO()
            csv.writer(out, lineterminator="\n").writerows(rows)
            return out.getvalue().encode()

        yield codecs.BOM_UTF8 + rendered([self.columns])
        for batch in batches:
            yield rendered([["" if v is None else v for v in row] for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)])


class MarkedCsv(DataSource):
    """``df.write.format("marked_csv").save(folder)``; with the option ``name`` the one file of one partition."""

    @classmethod
    def name(cls) -> str:
        return "marked_csv"

    def writer(self, schema, overwrite):
        return MarkedCsvWriter(self.options["path"], overwrite, schema.names, self.options.get("name"))


def write_csv_with_mark(df: DataFrame, path: str) -> None:
    """UTF-8 CSV with a byte order mark: a folder of parts, or, of a path that ends in .csv, one file by one task."""
    df.sparkSession.dataSource.register(MarkedCsv)
    if path.endswith(".csv"):
        folder, _, name = path.rpartition("/")
        df.coalesce(1).write.format("marked_csv").mode("append").option("name", name).save(folder or ".")
    else:
        df.write.format("marked_csv").mode("append").save(path)


def markdown(df: DataFrame, order: list[str], formats: dict[str, str] | None = None) -> DataFrame:
    """A table as lines of Markdown (line, in order): nulls are dashes."""
    formats = formats or {}
    cell = lambda c: F.coalesce(F.format_string(formats[c], F.col(c)) if c in formats else F.col(c).cast("string"), F.lit("—"))
    body = df.select(F.lit(2).alias("part"), F.struct(*order).alias("k"), F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in df.columns]), F.lit(" |")).alias("line"))
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(df.columns) + " |"), (1, "|" + "---|" * len(df.columns))], "part int, line string")
    return head.select("part", F.lit(None).cast(body.schema["k"].dataType).alias("k"), "line").unionByName(body).orderBy("part", "k").select("line")


def write_markdown(df: DataFrame, path: str, order: list[str], formats: dict[str, str] | None = None) -> None:
    markdown(df, order, formats).coalesce(1).write.text(path)


def write_grids(rows: DataFrame, folder: str) -> None:
    """A TextGrid file a recording from rows of the grid schema (and tier_order); invalid tiers and existing files are errors.

    All files appear when the last task is done, or none.
    """
    spark = rows.sparkSession
    spark.dataSource.register(GridSource)
    own = rows if "tier_order" in rows.columns else rows.withColumn("tier_order", F.lit(0))
    own = own.select("recording_id", "tier", "kind", "start", "end", "text", F.col("xmin").cast("double").alias("xmin"), F.col("xmax").cast("double").alias("xmax"), "tier_order")
    own.repartition("recording_id").sortWithinPartitions("recording_id", "tier_order", "tier", "start", "end").write.format("textgrid").mode("append").save(folder)


def blank_grid(xmin: float, xmax: float, tier: str, path: str) -> None:
    """An empty point tier for annotation without hints; an existing file is an error."""
    files, at = store(path)
    if files.get_file_info(at).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    with files.open_output_stream(at) as f:
        f.write(render(xmin, xmax, [{"name": tier, "kind": "point", "rows": []}]).encode())


#: Seconds of a chunk of a waveform, and intervals up to which their table is sent to the chunks.
CHUNK, BROADCAST = 10.0, 1_000_000


def chunks(waveforms: DataFrame, seconds: float = CHUNK) -> DataFrame:
    """recording_id, chunk, samples: waveforms (recording_id, samples) in pieces of so many seconds."""
    size = int(seconds * RATE)
    last = F.floor((F.size("samples") - 1) / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("samples", i * size + 1, F.lit(size)))
    return waveforms.filter(F.size("samples") > 0).select("recording_id", F.posexplode(cut).alias("chunk", "samples"))


def clips(waveforms: DataFrame, intervals: DataFrame, most: int | None = None, least_bytes: int = 100, seconds: float = CHUNK) -> DataFrame:
    """recording_id, number, label, wav: a clip an interval in order, up to ``most`` each; tiny ones go.

    waveforms: whole ones (recording_id, samples), or already ``chunks`` of so many seconds. An interval meets only the
    chunks that it touches, by number, and what it takes of each is cut before the parts come together, so the last shuffle is
    as large as the clips. Up to ``BROADCAST`` intervals go to the chunks, and the chunks then stay where they are.
    """
    from pyspark.sql import Window

    size = int(seconds * RATE)
    pieces = waveforms if "chunk" in waveforms.columns else chunks(waveforms, seconds)
    n = F.row_number().over(Window.partitionBy("recording_id").orderBy("start", "end"))
    own = intervals.withColumn("number", n)
    own = own if most is None else own.filter(F.col("number") <= most)
    a, b = F.greatest(F.floor(F.col("start") * RATE), F.lit(0)).cast("long"), F.ceil(F.col("end") * RATE).cast("long")
    own = own.select("recording_id", "number", F.col("text").alias("label"), a.alias("a"), b.alias("b")).filter("b > a")
    own = own.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("a") / size).cast("int"), F.floor((F.col("b") - 1) / size).cast("int"))))
    if own.limit(BROADCAST + 1).count() <= BROADCAST:
        own = F.broadcast(own)
    begin = F.greatest(F.col("a") - F.col("chunk") * F.lit(size), F.lit(0))
    part = F.slice("samples", (begin + 1).cast("int"), (F.least(F.col("b") - F.col("chunk") * F.lit(size), F.lit(size)) - begin).cast("int"))
    met = pieces.join(own, ["recording_id", "chunk"]).select("recording_id", "number", "label", F.struct("chunk", part.alias("part")).alias("p"))
    whole = met.groupBy("recording_id", "number", "label").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"])).alias("samples"))

    def run(batches):
        for pdf in batches:
            pdf["wav"] = [encode_wave(np.asarray(s, dtype=np.float32)) for s in pdf["samples"]]
            yield pdf.drop(columns="samples")[lambda x: x["wav"].map(len) >= least_bytes]

    return whole.mapInPandas(run, "recording_id string, number int, label string, wav binary")


def as_json(df: DataFrame, *columns: str | Column) -> DataFrame:
    return df.select(F.to_json(F.struct(*columns)).alias("value"))


def write_candidates(candidates: DataFrame, diagnostics: DataFrame, path: str) -> None:
    """Candidates and a manifest of their diagnostics, side by side."""
    candidates.write.json(f"{path.rstrip('/')}/candidates")
    diagnostics.coalesce(1).write.json(f"{path.rstrip('/')}/manifest")


def review_chunk(grids: DataFrame, lo: float, hi: float) -> DataFrame:
    """Grid rows cut to a chunk and rebased to its start."""
    from prosodia.operators.intervals import clip_rebase

    spans = clip_rebase(grids.filter("kind = 'interval'"), "start", "end", lo, hi)
    points = grids.filter((F.col("kind") == "point") & F.col("start").between(lo, hi)).withColumn("start", F.col("start") - lo).withColumn("end", F.col("start"))
    return spans.unionByName(points).withColumn("xmin", F.lit(0.0)).withColumn("xmax", F.lit(hi - lo))
