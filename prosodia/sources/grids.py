"""Annotation grids (TextGrid): parsing, a Spark data source, and writing with validation."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from prosodia.sources.stores import StagedWriter, listed, store

SCHEMA = "recording_id string, tier string, kind string, idx int, start double, end double, text string, xmin double, xmax double"


def decode(content: bytes) -> str:
    """UTF-8 with or without a mark, else UTF-16."""
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return content.decode("utf-16")
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("utf-16")


_TOKEN = re.compile(r'"((?:[^"]|"")*)"|(?<![\w"])(-?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?)(?![\w"\]])|<exists>|<absent>')


#: The head of a tier in the long layout; no label can hold it, for quotes inside labels are doubled.
_TIER = re.compile(r'class\s*=\s*"(IntervalTier|TextTier)"\s*name\s*=\s*"((?:[^"]|"")*)"')

Wanted = Callable[[str, str], bool]


def _values(body: str) -> Iterator[str | float]:
    body = re.sub(r"\[\s*\d*\s*\]", "", body)
    return iter([m[1].replace('""', '"') if m[1] is not None else float(m[2]) for m in _TOKEN.finditer(body) if m[1] is not None or m[2] is not None])


def _tier(values: Iterator[str | float]) -> dict:
    kind, name = next(values), next(values)
    next(values), next(values)
    rows = []
    for _ in range(int(next(values))):
        if kind == "IntervalTier":
            rows.append((next(values), next(values), next(values)))
        else:
            t = next(values)
            rows.append((t, t, next(values)))
    return {"name": name, "kind": KINDS[kind], "rows": rows}


KINDS = {"IntervalTier": "interval", "TextTier": "point"}


def parse(text: str, wanted: Wanted | None = None) -> tuple[float, float, list[dict]]:
    """xmin, xmax and tiers of a grid: name, kind (interval or point) and rows (start, end, text).

    Only the values count, as in both of the format's layouts: quoted strings and free-standing numbers in order. Tiers
    that ``wanted`` (name, kind) refuses are passed over; in the long layout their rows aren't read.
    """
    body = text.partition('"TextGrid"')[2]
    if not body:
        raise ValueError("not a TextGrid")
    starts = list(_TIER.finditer(body)) if wanted else []
    values = _values(body[: starts[0].start()] if starts else body)
    xmin, xmax = next(values), next(values)
    size = int(next(values, 0))
    if starts and len(starts) == size:
        ends = [*(m.start() for m in starts[1:]), len(body)]
        return xmin, xmax, [_tier(_values(body[m.start() : e])) for m, e in zip(starts, ends, strict=True) if wanted(m[2].replace('""', '"'), KINDS[m[1]])]
    if starts:
        raise ValueError(f"{len(starts)} tiers where {size} are announced")
    tiers = [_tier(values) for _ in range(size)]
    return xmin, xmax, [t for t in tiers if wanted is None or wanted(t["name"], t["kind"])]


def tier_rows(recording: str, content: bytes, wanted: Wanted | None = None) -> Iterator[tuple]:
    xmin, xmax, tiers = parse(decode(content), wanted)
    for tier in tiers:
        for i, (a, b, label) in enumerate(tier["rows"]):
            yield recording, tier["name"], tier["kind"], i, a, b, label, xmin, xmax


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class GridReader(DataSourceReader):
    """Files packed into partitions by bytes; filters on recording_id, tier and kind skip files and tiers unread."""

    def __init__(self, options: dict):
        self.path, self.bytes = options["path"], int(options.get("partitionBytes", 16 << 20))
        self.allowed: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in ("recording_id", "tier", "kind"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                known = self.allowed.get(f.attribute[0])
                self.allowed[f.attribute[0]] = values if known is None else known & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        packed, size = [], 0
        names = self.allowed.get("recording_id")
        for path, n in listed(self.path, "*.TextGrid"):
            if names is not None and recording_of(path) not in names:
                continue
            if not packed or size + n > self.bytes:
                packed.append([])
                size = 0
            packed[-1].append(path)
            size += n
        return [_Files(p) for p in packed] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        tiers, kinds = self.allowed.get("tier"), self.allowed.get("kind")
        wanted = (lambda name, kind: (tiers is None or name in tiers) and (kinds is None or kind in kinds)) if tiers is not None or kinds is not None else None
        files, _ = store(self.path)
        for path in partition.paths:
            with files.open_input_stream(path) as f:
                yield from tier_rows(recording_of(path), f.read(), wanted)


def recording_of(path: str) -> str:
    return path.rpartition("/")[2].rpartition(".")[0]


class GridWriter(StagedWriter):
    """A file a recording; rows of a recording must share a partition and follow each other."""

    def __init__(self, path: str, overwrite: bool, schema: StructType):
        super().__init__(path, overwrite)
        self.ordered = "tier_order" in schema.names

    def parts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        name, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if rows and row["recording_id"] != name:
                    yield f"{name}.TextGrid", self.content(rows)
                    rows = []
                name = row["recording_id"]
                rows.append(row)
        if rows:
            yield f"{name}.TextGrid", self.content(rows)

    def content(self, rows: list[dict]) -> bytes:
        tiers: dict[str, dict] = {}
        for r in sorted(rows, key=lambda r: r["tier_order"]) if self.ordered else rows:
            tiers.setdefault(r["tier"], {"name": r["tier"], "kind": r["kind"], "rows": []})["rows"].append((r["start"], r["end"], r["text"]))
        return render(float(rows[0]["xmin"]), float(rows[0]["xmax"]), list(tiers.values())).encode()


class GridSource(DataSource):
    """``spark.read.format("textgrid").load(folder, file or pattern)``: one row an interval or point; and its writer."""

    @classmethod
    def name(cls) -> str:
        return "textgrid"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return GridReader(self.options)

    def writer(self, schema, overwrite):
        return GridWriter(self.options["path"], overwrite, schema)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GridSource)


def read_grids(spark: SparkSession, path: str) -> DataFrame:
    """The same rows from any file system, a file a row of Spark's binary reader."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.TextGrid").load(path)
    files = files.select(F.regexp_extract("path", r"([^/]+)\.TextGrid$", 1).alias("recording_id"), "content")

    def run(batches):
        for pdf in batches:
            rows = [r for rec, content in zip(pdf["recording_id"], pdf["content"], strict=True) for r in tier_rows(rec, content)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.mapInPandas(run, SCHEMA)


def points(grids: DataFrame, tier: str) -> DataFrame:
    """recording_id, t, mark of a point tier; an interval tier of that name is an error."""
    own = grids.filter(F.col("tier") == tier)
    t = F.when(F.col("kind") == "point", F.col("start")).otherwise(F.raise_error(F.lit(f"tier {tier} holds intervals")).cast("double"))
    return own.select("recording_id", t.alias("t"), F.col("text").alias("mark"))


def intervals(grids: DataFrame, tier: str, include_empty: bool = False) -> DataFrame:
    """recording_id, start, end, text of an interval tier, without blank labels unless they are asked for."""
    own = grids.filter((F.col("tier") == tier) & (F.col("kind") == "interval")).select("recording_id", "start", "end", "text")
    return own if include_empty else own.filter(F.trim("text") != "")


def flat_intervals(grids: DataFrame, longest: float = 5.0) -> DataFrame:
    """Labelled intervals shorter than ``longest`` of all tiers, each with its tier."""
    return grids.filter((F.col("kind") == "interval") & (F.trim("text") != "") & (F.col("end") - F.col("start") < longest)).select("recording_id", "tier", "start", "end", "text")


def bounds(grids: DataFrame) -> DataFrame:
    return grids.groupBy("recording_id").agg(F.min("xmin").alias("xmin"), F.max("xmax").alias("xmax"))


def render(xmin: float, xmax: float, tiers: list[dict]) -> str:
    """A grid in the long layout. Points are sorted and must lie in bounds; intervals must part the bounds without a gap."""
    quote = lambda s: '"' + re.sub(r"\r\n|\r|\n", " ", s or "").replace('"', '""') + '"'
    names = [t["name"] for t in tiers]
    if len(set(names)) < len(names):
        raise ValueError("tier names repeat")
    out = ['File type = "ooTextFile"', 'Object class = "TextGrid"', "", f"xmin = {xmin:.9g}", f"xmax = {xmax:.9g}", "tiers? <exists>", f"size = {len(tiers)}", "item []:"]
    for k, t in enumerate(tiers, 1):
        rows = sorted(t["rows"])
        point = t["kind"] == "point"
        if point and any(not xmin <= a <= xmax for a, *_ in rows):
            raise ValueError(f"a point of {t['name']} is out of bounds")
        if not point:
            edges = [(xmin, rows[0][0]), *((a[1], b[0]) for a, b in zip(rows, rows[1:], strict=False)), (rows[-1][1], xmax)] if rows else [(xmin, xmax)]
            if any(abs(a - b) > 1e-7 for a, b in edges) or any(b <= a for a, b, _ in rows):
                raise ValueError(f"{t['name']} is no gapless partition")
        kind, unit = ("TextTier", "points") if point else ("IntervalTier", "intervals")
        out += [f"    item [{k}]:", f'        class = "{kind}"', f"        name = {quote(t['name'])}", f"        xmin = {xmin:.9g}", f"        xmax = {xmax:.9g}", f"        {unit}: size = {len(rows)}"]
        for i, (a, b, label) in enumerate(rows, 1):
            out.append(f"        {unit} [{i}]:")
            out += [f"            number = {a:.9g}", f"            mark = {quote(label)}"] if point else [f"            xmin = {a:.9g}", f"            xmax = {b:.9g}", f"            text = {quote(label)}"]
    return "\n".join(out) + "\n"


def to_grids(rows: DataFrame) -> DataFrame:
    """recording_id, content: the grid of each recording from rows of the read schema; invalid tiers raise."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tiers = [{"name": n, "kind": g["kind"].iloc[0], "rows": list(zip(g["start"], g["end"], g["text"], strict=True))} for n, g in pdf.sort_values("tier_order").groupby("tier", sort=False)]
        return pd.DataFrame({"recording_id": [pdf["recording_id"].iloc[0]], "content": [render(float(pdf["xmin"].iloc[0]), float(pdf["xmax"].iloc[0]), tiers)]})

    if "tier_order" not in rows.columns:
        rows = rows.withColumn("tier_order", F.lit(0))
    return rows.groupBy("recording_id").applyInPandas(run, "recording_id string, content string")
