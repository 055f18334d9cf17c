"""Token-ID files: flat unsigned integers, 64-bit document offsets, memory-mapped readers.

Layout of a store: ``files/kind=tokens/part-N*`` holds the ids of shard N as little-endian unsigned
16- or 32-bit integers with no header; ``offsets/shard=N/part-*`` holds for each document of that
shard the global position of its first id as a little-endian 64-bit integer;
``files/kind=docs/part-N*`` holds "doc_id length" records in the same order, each ended by the end
id. Shards follow each other in ascending doc_id; their bases are the prefix sums of file lengths.

Spark's own text writer makes the files. It ends each record with a separator of any bytes, so
the end-of-document id *is* the separator of a token file, and the highest byte of an offset
(always 0, as offsets stay below 2**56) is that of an offset file. Files therefore go through
Spark's commit protocol on every Hadoop file system: a lost executor or a repeated task leaves
neither half-written nor doubled shards.
"""

from __future__ import annotations

import gc
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosodia.llm.shared import Words, pieces, scratch_path, shuffle_width, text_bytes

#: The shard number in the name of a file of Spark's writers.
PART = r"/part-(\d+)"

#: Distinct words whose ids one Python worker keeps; beyond that it starts anew.
CACHE_WORDS = 600_000
#: Bytes of text that are encoded at once.
PIECE = 1 << 21
#: One run of letters that lower() maps one to one, then one run of signs: two pre-tokens at most.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?$%*|]*)")
_ENCODERS: dict[tuple[str, int], Encoder] = {}


def id_type(vocabulary: int, end_id: int) -> np.dtype:
    return np.dtype("<u2") if max(vocabulary - 1, end_id) < 1 << 16 else np.dtype("<u4")


class Encoder:
    """Ids of whole texts, each distinct word encoded once as long as it stays in the bounded cache.

    Holds for tokenizers that never join text over white space: a text's ids are then those of its
    words in a row. Words are looked up by 64-bit fingerprint and assembled with numpy.
    """

    def __init__(self, path: str, width: int):
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.width, self.known, self.stems = width, {}, {}
        # for single pre-tokens in normal form, the same model without normalising and splitting
        self.bare = Tokenizer(self.full.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.full.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        suffix = getattr(self.full.model, "end_of_word_suffix", None)
        self.last[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        probe = ["caf\u00e9", "word", ".,", "\u00ff\u00df\u00f8"]
        self.splits = bool(suffix) and self._runs(probe) == self._bytes(probe)

    def _bytes(self, batch: list[str]) -> list[bytes]:
        kind = "H" if self.width == 2 else "I"
        return [array(kind, e.ids).tobytes() for e in self.full.encode_batch_fast(batch, add_special_tokens=False)]

    def _runs(self, batch: list[str]) -> list[bytes]:
        """The same for plain runs, all in one string; an id that ends a word ends a run."""
        if not batch:
            return []
        ids = np.array(self.bare.encode_batch_fast([" ".join(batch)], add_special_tokens=False)[0].ids, dtype=f"<u{self.width}")
        ends = (np.flatnonzero(self.last[ids]) + 1) * self.width
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def learn(self, prints: list[int], words: list[str]) -> None:
        found = list(map(_PLAIN.fullmatch if self.splits else lambda w: None, words))
        odd = [i for i, m in enumerate(found) if m is None]
        self.known.update(zip([prints[i] for i in odd], self._bytes([words[i] for i in odd]), strict=True))
        plain = [h for h, m in zip(prints, found, strict=True) if m]
        letters, signs = [m[1].lower() for m in found if m], [m[2] for m in found if m]
        fresh = list(({*letters, *signs} - {""}) - self.stems.keys())
        self.stems.update(zip(fresh, self._runs(fresh), strict=True))
        self.stems[""] = b""
        get = self.stems.__getitem__
        self.known.update(zip(plain, map(bytes.__add__, map(get, letters), map(get, signs)), strict=True))

    def encode(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The little-endian ids of each text, and their number."""
        data, _ = text_bytes(texts)
        words = Words(texts, lower=False)
        if len(self.known) > CACHE_WORDS or len(self.stems) > CACHE_WORDS:
            self.known, self.stems = {}, {}
        distinct, at, which = np.unique(words.hash, return_index=True, return_inverse=True)
        prints = distinct.tolist()
        found = list(map(self.known.get, prints))
        unseen = [i for i, x in enumerate(found) if x is None]
        if unseen:
            raw = data.tobytes()
            self.learn([prints[i] for i in unseen], [raw[b:e].decode() for b, e in zip(words.begin[at[unseen]].tolist(), words.end[at[unseen]].tolist(), strict=True)])
            for i in unseen:
                found[i] = self.known[prints[i]]
        kind = f"<u{self.width}"
        flat = np.frombuffer(b"".join(found), dtype=kind)
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // self.width
        begin = np.cumsum(sizes) - sizes
        per_word = sizes[which]
        upto = np.concatenate([[0], np.cumsum(per_word)])
        ids = flat[np.repeat(begin[which] - upto[:-1], per_word) + np.arange(upto[-1])]
        ends = upto[words.first]
        rows = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((ends * self.width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])
        return rows, np.diff(ends)


def _encode(path: str, end_id: int, width: int):
    """mapInArrow over sorted (doc_id, text): token records, then one record a document with its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from prosodia.llm import token_ids as own  # the worker's module, so that its cache outlives the task

        encoder = own._ENCODERS.get((path, width)) or own._ENCODERS.setdefault((path, width), own.Encoder(path, width))
        record = lambda kind, rows: pa.RecordBatch.from_arrays([rows, pa.array([kind] * len(rows))], names=["value", "kind"])
        gc.disable()  # nothing here is cyclic, and millions of small objects make its passes long
        lengths = []
        for piece in pieces(batches, most=own.PIECE):
            rows, counts = encoder.encode(piece.column(1))
            lengths.append((piece.column(0).to_pylist(), counts + 1))
            yield record("tokens", rows)
        for ids, counts in lengths:
            yield record("docs", pa.array([f"{'' if i is None else i} {n}".encode() for i, n in zip(ids, counts.tolist(), strict=True)], pa.binary()))

    return run


def _files(spark: SparkSession, folder: str, number: str, *columns: str) -> DataFrame:
    """One row a shard file, with its shard number; Spark reads ``content`` only where it is asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_extract("path", number, 1).cast("int").alias("shard"), *columns)


def _offsets(end: bytes):
    """mapInArrow over (shard, base, records): each shard's offsets but for the last byte, which is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, bases, records = (batch.column(i).to_pylist() for i in range(3))
            out = []
            for base, content in zip(bases, records, strict=True):
                counts = np.array([int(r.partition(b" ")[2]) for r in content.split(end)[:-1]], dtype="<i8")
                out.append((base + np.cumsum(counts) - counts).astype("<i8").tobytes()[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(shards, pa.int32())], names=["value", "shard"])

    return run


def write_tokens(docs: DataFrame, out: str, tokenizer_json: str, end_id: int, shards: int | None = None) -> dict:
    """Encode (doc_id, text) with a tokenizers JSON file and write a store; returns its description.

    Null text is empty and gives the end id alone; an empty table gives a store without shards. Rows
    with equal doc_id stay, ordered by text. Other columns are ignored. The tokenizer must not join
    ids over white space (word-level pre-tokenisation, as in the public word BPE files).
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    vocabulary = Tokenizer.from_file(tokenizer_json).get_vocab_size(with_added_tokens=True)
    kind = id_type(vocabulary, end_id)
    end = np.array([end_id], dtype=kind).tobytes()
    encoded = (
        docs.select("doc_id", "text")
        .repartitionByRange(shards or shuffle_width(spark), "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(_encode(tokenizer_json, end_id, kind.itemsize), "value binary, kind string")
    )
    # two open files a task instead of a sort by kind: records keep their order
    writers = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(writers)
    spark.conf.set(writers, "2")
    try:
        encoded.select(F.col("value").cast("string").alias("value"), "kind").write.partitionBy("kind").option("lineSep", end.decode("latin-1")).option("encoding", "ISO-8859-1").text(f"{out}/files")
    finally:
        spark.conf.set(writers, before)
    # one row a shard comes to the driver, as many as there are files
    lengths = dict(_files(spark, f"{out}/files/kind=tokens", PART, "length").collect()) if _exists(spark, f"{out}/files/kind=tokens") else {}
    order = sorted(lengths)
    bases = list(accumulate((lengths[s] // kind.itemsize for s in order), initial=0))
    if order:
        base = spark.createDataFrame(list(zip(order, bases, strict=False)), "shard int, base long")
        records = _files(spark, f"{out}/files/kind=docs", PART, "content").join(F.broadcast(base), "shard").select("shard", "base", "content")
        starts = records.mapInArrow(_offsets(end), "value binary, shard int")
        starts.select(F.col("value").cast("string").alias("value"), "shard").write.partitionBy("shard").option("lineSep", "\0").text(f"{out}/offsets")
    return {"path": out, "dtype": kind.str, "end_id": end_id, "tokens": bases[-1], "shards": len(order)}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _digest(kind: str, end: bytes, mapped: bool):
    """mapInArrow over shards: one row a document, from the files alone."""

    def rows(tokens: np.ndarray, starts: np.ndarray, ids: list[bytes]) -> pa.RecordBatch:
        base = int(starts[0])
        stops = np.append(starts[1:], base + len(tokens))
        sums = [zlib.crc32(np.asarray(tokens[a - base : b - base], dtype="<u4").tobytes()) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array([int(x) if x else None for x in ids], pa.int64()), pa.array(starts, pa.int64()), pa.array(stops - starts, pa.int64()), pa.array(sums, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tokens, offsets, docs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if mapped:
                    tokens, offsets, docs = (unquote(urlparse(p).path) for p in (tokens, offsets, docs))
                    with open(docs, "rb") as f:
                        docs = f.read()
                    ids, starts = np.memmap(tokens, dtype=kind, mode="r"), np.array(np.memmap(offsets, dtype="<i8", mode="r"))
                else:
                    ids, starts = np.frombuffer(tokens, dtype=kind), np.frombuffer(offsets, dtype="<i8")
                yield rows(ids, starts, [r.partition(b" ")[0] for r in docs.split(end)[:-1]])

    return run


def read_digests(spark: SparkSession, store: dict) -> DataFrame:
    """Per document of a store: doc_id, start, n_tokens, ids_crc32, read back from the files.

    Files in a shared ``file:`` folder are memory-mapped where they lie; in other file systems Spark
    fetches each shard's bytes.
    """
    mapped = urlparse(store["path"]).scheme in ("", "file")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not store["shards"]:
        return spark.createDataFrame([], schema)
    what = "path" if mapped else "content"
    path, end = store["path"], np.array([store["end_id"]], dtype=store["dtype"]).tobytes()
    tokens = _files(spark, f"{path}/files/kind=tokens", PART, what).withColumnRenamed(what, "tokens")
    offsets = _files(spark, f"{path}/offsets", r"/shard=(\d+)/", what).withColumnRenamed(what, "offsets")
    docs = _files(spark, f"{path}/files/kind=docs", PART, what).withColumnRenamed(what, "docs")
    parts = tokens.join(offsets, "shard").join(docs, "shard").select("tokens", "offsets", "docs")
    return parts.repartition(min(store["shards"], shuffle_width(spark))).mapInArrow(_digest(store["dtype"], end, mapped), schema)


class TokenStore:
    """Random access to the shards of a store in a local folder through memory maps."""

    def __init__(self, folder: str, dtype: str):
        import glob

        number = lambda p: int(re.search(r"part-(\d+)", p)[1])
        tokens = sorted(glob.glob(f"{folder}/files/kind=tokens/part-*"), key=number)
        offsets = [glob.glob(f"{folder}/offsets/shard={number(t)}/part-*")[0] for t in tokens]
        self.shards = [(np.memmap(t, dtype=dtype, mode="r"), np.memmap(o, dtype="<i8", mode="r")) for t, o in zip(tokens, offsets, strict=True)]
        self.first = np.cumsum([0] + [len(o) for _, o in self.shards])

    def __len__(self) -> int:
        return int(self.first[-1])

    def __getitem__(self, i: int) -> np.ndarray:
        """The ids of the i-th document, its end id included."""
        shard = int(np.searchsorted(self.first, i, side="right")) - 1
        tokens, starts = self.shards[shard]
        k = i - int(self.first[shard])
        base = int(starts[0])
        stop = int(starts[k + 1]) - base if k + 1 < len(starts) else len(tokens)
        return tokens[int(starts[k]) - base : stop]


def token_table(docs: DataFrame, tokenizer_json: str, end_id: int) -> DataFrame:
    """Write ``docs`` to a fresh store in the shared folder and return what the files hold.

    What ``write_tokens`` says of null, empty and repeated rows holds; an empty table gives no rows.
    """
    spark = docs.sparkSession
    return read_digests(spark, write_tokens(docs, scratch_path(spark, "tokens"), tokenizer_json, end_id))
