"""Hard negatives against a plain double loop, with nulls, ties, repeats and unlike lengths."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prosodia.llm import va_file

SCHEMA = "vec_id long, label int, embedding array<double>, score string, block int, d double"


def plain(rows, every=50, positives=5, negatives=3, least=50, most=95):
    known = []
    for i, label, v in rows:
        if label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        known.append((i, label, [math.floor(256 * x) for x in v]))
    out, done = [], set()
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    for i, label, v in known:
        if i is None or i % every or (i, label, tuple(v)) in done:
            continue
        done.add((i, label, tuple(v)))
        scored = [(sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, other, w in known if len(w) == len(v) and (j is None or j != i)]
        for ps, p, _ in sorted((s for s in scored if s[2] == label), key=order)[:positives]:
            fits = sorted((s for s in scored if s[2] != label and least * ps <= 100 * s[0] <= most * ps), key=order)[:negatives]
            out += [(i, p, k + 1, n, ps, ns) for k, (ns, n, _) in enumerate(fits)]
    return sorted(out, key=str)


def found(df, **kw):
    return sorted(((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in va_file.mine(df, **kw).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    centres = [[rng.gauss(0, 0.5) for _ in range(8)] for _ in range(4)]
    out = [(i, i % 4, [c + rng.gauss(0, 0.3) for c in centres[i % 4]]) for i in range(400)]
    out += [(1000 + i, 9, out[4][2]) for i in range(60)]  # a common vector under another label: ties
    out += [(2000 + i, i % 3, [0.0] * 8) for i in range(9)]
    out += [(50, 3, out[50][2]), (7, 3, out[7][2]), (7, 3, out[7][2]), (100, 2, [9.0] * 8)]  # repeated ids
    out += [(None, 1, out[1][2]), (None, 1, out[1][2]), (None, 2, out[0][2])]
    out += [(3000, None, out[0][2]), (3050, 1, None), (3100, 1, [None] * 8), (3150, 1, [math.nan] * 8), (3200, 1, [math.inf] * 8), (3250, 1, [])]
    out += [(4000 + i, i % 2, [rng.gauss(0, 1) for _ in range(3)]) for i in range(120)]
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2.0) for r in rows], SCHEMA)


def test_same_as_a_double_loop(spark, rows):
    df = table(spark, rows)
    want = plain(rows)
    assert len(want) > 60
    assert found(df) == want
    assert found(df.repartition(7, "label"), least=0, most=100, positives=2, negatives=40) == plain(rows, least=0, most=100, positives=2, negatives=40)


def test_small_bins(spark, rows, monkeypatch):
    monkeypatch.setattr(va_file, "BIN_BYTES", 1)
    assert found(table(spark, rows), every=10) == plain(rows, every=10)


def test_large_numbers_and_empty_tables(spark, rows):
    rng = random.Random(5)
    big = [(i, i % 2, [rng.gauss(0, 1) * 10.0 ** (i % 7) for _ in range(5)]) for i in range(120)]
    df = table(spark, [*big, (500, 0, [1e300] * 5), (550, 1, [2.0**21, -(2.0**21), 0.0, 1.5, 2.0**20])])
    got = found(df, every=4)
    whole = [*big, (550, 1, [2.0**21, -(2.0**21), 0.0, 1.5, 2.0**20])]
    assert got == [r for r in plain(whole, every=4)]
    assert found(df.limit(0)) == [] and found(df.filter("vec_id % 50 <> 0")) == []
    assert found(df.withColumn("label", F.lit(None).cast("int"))) == []


def test_bounds_hold_and_few_vectors_are_scored():
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.normal(0, 0.125, (3000, 64))).astype(np.int64)
    label = np.arange(3000) % 10
    order = np.argsort(label, kind="stable")
    batch = pa.RecordBatch.from_arrays([pa.array(np.full(3000, 64, np.int32)), pa.array(label[order].astype(np.int64)), pa.array(order.astype(np.int64)), pa.array((x[order] / 256).tolist(), pa.list_(pa.float64()))], names=["d", "label", "vec_id", "v"])

    class Context:
        @staticmethod
        def get():
            return type("T", (), {"partitionId": staticmethod(lambda: 0)})

    import pyspark

    was, pyspark.TaskContext = pyspark.TaskContext, Context
    try:
        (row,) = [b.to_pylist()[0] for b in va_file._pack(256)(iter([batch]))]
    finally:
        pyspark.TaskContext = was
    b = va_file.Bin(row)
    anchors = x[:20]
    lower, width = b.bounds(anchors, slice(0, 3000))
    true = anchors @ b.x.astype(np.int64).T
    assert (lower <= true).all() and (true <= lower + width[:, None]).all()
    scored = []
    exact = b.exact
    b.exact = lambda a, at: scored.append(len(at)) or exact(a, at)
    for i in range(20):
        list(va_file.negatives_of(b, np.full(20, -1), np.full(20, -1), anchors, {i: [(1, 12_000, 24_000)]}, 3))
    assert sum(scored) < 0.05 * 20 * 3000
