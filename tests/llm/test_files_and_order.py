"""Token files, shards and mixing against plain Python on small tables with awkward rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosodia.llm import hilbert, mixing, token_ids
from prosodia.llm.queries import tokenizer_file
from prosodia.llm.shared import running_sums, scratch_path

ROWS = [
    (5, "Hello, WORLD's end", "en", "b"), (1, None, "en", "a"), (2, "", None, None), (3, "x\x1cy   z q \t\n", "fr", "a"),
    (4, "café <|endoftext|> a<|startoftext|>b 'll don't 12345 ΣΣ", None, "b"), (7, "same same", "en", "c"), (7, "same same", "en", "c"),
    (-3, "é combining " + "long " * 30000, "de", "hot"), (9, "one", "xx", "hot"), (10, "two words", "xx", "hot"),
]


@pytest.fixture(scope="module")
def docs(spark):
    extra = [(100 + i, "word " * (i % 7) + "end", "en", "hot" if i % 3 else f"s{i % 5}") for i in range(120)]
    return spark.createDataFrame(ROWS + extra, "doc_id long, text string, lang string, source string").withColumn("shard", F.lit("clash")).withColumn("size", F.lit("clash")).withColumn("start", F.lit(1))


def test_token_files_round_trip(spark, docs):
    from tokenizers import Tokenizer

    store = token_ids.write_tokens(docs, scratch_path(spark, "store"), tokenizer_file(), end_id=2, shards=5)
    got = sorted(map(tuple, token_ids.read_digests(spark, store).collect()))
    rows = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()))
    tok, start, want, ids = Tokenizer.from_file(tokenizer_file()), 0, [], []
    for doc_id, text in rows:
        ids.append([*tok.encode(text, add_special_tokens=False).ids, 2])
        want.append((doc_id, start, len(ids[-1]), zlib.crc32(np.array(ids[-1], "<u4").tobytes())))
        start += len(ids[-1])
    assert got == sorted(want)
    mapped = token_ids.TokenStore(store["path"].removeprefix("file://"), store["dtype"])
    assert [mapped[i].tolist() for i in range(len(mapped))] == ids


def test_token_files_of_other_stores_and_wide_ids(spark, docs):
    store = token_ids.write_tokens(docs, scratch_path(spark, "wide"), tokenizer_file(), end_id=49407, shards=3)
    small = token_ids.write_tokens(docs, scratch_path(spark, "wide"), tokenizer_file(), end_id=70000, shards=3)
    assert (store["dtype"], small["dtype"]) == ("<u2", "<u4")
    assert small["tokens"] == store["tokens"]
    assert token_ids.read_digests(spark, small).count() == docs.count()


def test_token_files_of_no_rows(spark, docs):
    assert token_ids.token_table(docs.filter("doc_id is null and text = 'x'"), tokenizer_file(), 2).collect() == []


def test_hilbert_neighbours():
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    n = 8
    cube = spark.range(n**3).select(*[(F.floor(F.col("id") / n**k) % n).alias(c) for k, c in enumerate("xyz")])
    rows = sorted(cube.select(hilbert.hilbert_index([F.col(c) for c in "xyz"], bits=3).alias("h"), "x", "y", "z").collect())
    assert [r.h for r in rows] == list(range(n**3))
    assert all(sum(abs(a[c] - b[c]) for c in "xyz") == 1 for a, b in zip(rows, rows[1:], strict=False))


def test_shards_by_rows(docs):
    out = hilbert.shard_documents(docs, shards=8)
    rows = out.collect()
    sizes = [sum(r.shard == s for r in rows) for s in range(8)]
    assert sum(sizes) == docs.count() and max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s])) for s in range(8))
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.hilbert for r in order] == sorted(r.hilbert for r in rows)
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.select("doc_id", "text").collect()}
    assert {r.shard for r in hilbert.shard_bounds(out).collect()} == set(range(8))
    few = hilbert.shard_documents(docs.limit(3), shards=8).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(0, 0), (1, 0), (2, 0)]
    assert hilbert.shard_documents(docs.filter("doc_id = 424242")).collect() == []


def filled(sizes, weights, most):
    """Raise targets step by step until none is above its stop."""
    budget, stopped = float(sum(sizes)), set()
    while True:
        open_ = [i for i in range(len(sizes)) if i not in stopped]
        level = (budget - sum(most * sizes[i] for i in stopped)) / sum(weights[i] for i in open_) if open_ else 0
        above = {i for i in open_ if level * weights[i] > most * sizes[i]}
        if not above:
            return [most * s if i in stopped else level * weights[i] for i, s in enumerate(sizes)]
        stopped |= above


def test_mixing_targets_and_takes(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    names = sorted({r.source for r in rows if r.source is not None}) + [None]
    size = {s: sum(r.size for r in rows if r.source == s) for s in names}
    want = filled([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 3)
    for s, goal in zip(names, want, strict=True):
        own = [r for r in rows if r.source == s]
        assert all(abs(r.target - goal) < 1e-6 and r.source_size == size[s] and 0 <= r.taken <= 3 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - goal) <= max(r.size for r in own) + 1
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)
    assert mixing.mix(docs.filter("doc_id = 424242")).collect() == []
    assert {r.taken for r in mixing.mix(docs.filter("doc_id in (1, 2)")).collect()} == {0}


def test_running_sums_with_ties(spark):
    rows = [("a", i % 3, 1) for i in range(50)] + [("b", i % 2, 2) for i in range(20)]
    out = running_sums(spark.createDataFrame(rows, "g string, k int, v long"), ["g", "k"], {"s": "v"}, group="g").collect()
    assert sorted(r.s for r in out if r.g == "a") == list(range(1, 51))
    assert sorted(r.s for r in out if r.g == "b") == list(range(2, 41, 2))
