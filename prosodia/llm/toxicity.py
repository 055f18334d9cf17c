"""Toxicity by cumulative-link ordinal regression over sparse hashed text features.

A feature says that a document holds a word, or words that begin with the same 4 or 5 bytes, at least
once, twice or four times; words and beginnings are hashed to ``1 << BITS`` buckets. Features that
toxic documents hold far more often than others are used: by the ratio of the shares, which does not
depend on the number of labels, or, for rarer ones, by a two-proportion z score.

Labels say only whether a document is toxic, so severity grades come from cross-fitting: a binary model
that saw neither a document nor its fold when features were chosen scores it, and toxic documents are
graded 1 to 3 by the thirds of these scores; all others are grade 0. One weight vector is then shared by
the ordered thresholds: P(grade >= k) = sigmoid(w.x - theta_k), and the expected severity is the
sum of these over k. The cut above which a document counts as toxic is the one with the best F1 on
predictions for folds that the predicting model did not see.

The fit uses a bounded sample of labelled documents (``SAMPLE`` rows, the smallest by hash of their
id); scoring reads every word of every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosodia.llm.shared import Words, ascii_letters_apart, materialize, pieces, sample_rows

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 12_000
#: Buckets of words and beginnings (as bits), bytes of a beginning, and the counts that a feature asks for.
BITS, BEGINNINGS, LEAST_COUNTS = 18, (4, 5), (1, 2, 4)
#: Features at most, and what they must reach: a z score, so many toxic documents, so many times the share of clean ones.
FEATURES, LEAST_Z, LEAST_TOXIC, LEAST_RATIO = 1024, 8.0, 8, 3.0
#: Or, whatever the number of labels: so many times the share of clean documents, both shares raised by
#: RAISE so that chance words of few documents fall short, and so many toxic documents.
TIMES, RAISE, FEW_TOXIC = 10.0, 0.01, 3
GRADES, FOLDS = 3, 3
#: The cut on P(grade >= 1) stays between these.
CUTS = 0.05, 0.5
_APART = ascii_letters_apart()


def _features(texts: pa.Array, maybe: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The features of all texts as (text, name) pairs; a name is bucket * len(LEAST_COUNTS) + level.

    ``maybe``: of each bucket, whether it matters.
    """
    words = Words(texts, lower=True, apart=_APART)
    of = np.repeat(np.arange(len(texts)), np.diff(words.first))
    parts = [(np.arange(len(of)), words.hash), *map(words.prefixes, BEGINNINGS)]
    doc, bucket = np.concatenate([of[at] for at, _ in parts]), np.concatenate([(h >> np.uint64(64 - BITS)).astype(np.int64) for _, h in parts])
    if maybe is not None:
        hit = maybe[bucket]
        doc, bucket = doc[hit], bucket[hit]
    key, count = np.unique(doc << BITS | bucket, return_counts=True)
    doc, bucket = key >> BITS, key & ((1 << BITS) - 1)
    levels = [np.flatnonzero(count >= least) for least in LEAST_COUNTS]
    return np.concatenate([doc[x] for x in levels]), np.concatenate([bucket[x] * len(LEAST_COUNTS) + k for k, x in enumerate(levels)])


def _learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (doc_id, toxic, fold, text): the names of each text's features."""
    for piece in pieces(batches):
        doc, name = _features(piece.column(3))
        order = np.argsort(doc, kind="stable")
        upto = np.searchsorted(doc[order], np.arange(piece.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*piece.columns[:3], pa.ListArray.from_arrays(pa.array(upto), pa.array(name[order].astype(np.int32)))], names=["doc_id", "toxic", "fold", "names"])


class Model:
    """Features (sorted names), their weights, the ordered thresholds, and the cut on P(grade >= 1)."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, thresholds: np.ndarray, cut: float = 0.5):
        self.features, self.weights, self.thresholds, self.cut = features, weights, thresholds, cut
        self.maybe = np.zeros(1 << BITS, dtype=bool)
        self.maybe[features // len(LEAST_COUNTS)] = True

    def parts(self):
        return self.features, self.weights, self.thresholds, self.cut

    def at_least(self, texts: pa.Array) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...: one row a text."""
        eta = np.zeros(len(texts))
        if len(self.features):
            doc, name = _features(texts, self.maybe)
            at = np.minimum(np.searchsorted(self.features, name), len(self.features) - 1)
            same = self.features[at] == name
            eta += np.bincount(doc[same], weights=self.weights[at[same]], minlength=len(texts))
        return _above(eta, self.thresholds)


def _above(eta: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(thresholds[None, :] - eta[:, None], -40, 40)))


def fit_ordinal(x: np.ndarray, grade: np.ndarray, grades: int = GRADES, rounds: int = 300, penalty: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the proportional-odds model, by Adam on the whole sample.

    Thresholds are a first one and positive steps, so they stay in order. Rows without any feature are
    one row a grade with their number as its weight.
    """
    total, m = x.shape
    some = x.any(axis=1)
    none = np.bincount(grade[~some], minlength=grades + 1)
    x, weight = np.concatenate([x[some].astype(np.float64), np.zeros((grades + 1, m))]), np.concatenate([np.ones(some.sum()), none])
    share = np.array([np.clip((grade >= k).mean(), 1e-3, 1 - 1e-3) for k in range(1, grades + 1)])
    grade = np.concatenate([grade[some], np.arange(grades + 1)])
    n = len(x)
    start = -np.log(share / (1 - share))
    p = np.concatenate([np.zeros(m), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    mean, square = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        steps = np.exp(p[m + 1 :])
        theta = p[m] + np.concatenate([[0], np.cumsum(steps)])
        above = 1 / (1 + np.exp(np.clip(theta[None, :] - (x @ p[:m])[:, None], -40, 40)))
        full = np.hstack([np.ones((n, 1)), above, np.zeros((n, 1))])
        a, b = full[np.arange(n), grade], full[np.arange(n), grade + 1]
        chance = np.maximum(a - b, 1e-12)
        g_theta = np.zeros((n, grades + 2))
        g_theta[np.arange(n), grade] += a * (1 - a) / chance
        g_theta[np.arange(n), grade + 1] -= b * (1 - b) / chance
        g_theta = weight @ g_theta[:, 1:-1] / total
        later = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([-(x.T @ (weight * (1 - a - b))) / total + penalty * p[:m], later[:1], later[1:] * steps])
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        p -= 0.1 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-9)
    return p[:m], p[m] + np.concatenate([[0], np.cumsum(np.exp(p[m + 1 :]))])


def _chosen(c1: np.ndarray, c0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Which features set toxic documents apart, by their numbers of toxic and clean ones; the best FEATURES."""
    n1, n0 = max(n1, 1), max(n0, 1)
    pooled = (c1 + c0) / (n1 + n0)
    z = (c1 / n1 - c0 / n0) / np.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0) + 1e-12)
    sure = (z >= LEAST_Z) & (c1 >= min(LEAST_TOXIC, max(2, n1 // 4))) & (c1 / n1 >= LEAST_RATIO * c0 / n0)
    often = (c1 / n1 + RAISE >= TIMES * (c0 / n0 + RAISE)) & (c1 >= FEW_TOXIC)
    good = np.flatnonzero(sure | often)
    return np.sort(good[np.argsort(-z[good], kind="stable")][:FEATURES])


def best_cut(p: np.ndarray, toxic: np.ndarray) -> float:
    """The cut on p with the best F1 within CUTS, half way between two scores; the largest of equals."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + max(1, toxic.sum()))
    scores = p[order]
    ends = np.append(scores[1:] < scores[:-1], True)  # a cut parts unequal scores only
    best = int(np.argmax(np.where(ends, f1, -1.0)))
    low = scores[best + 1] if best + 1 < len(scores) else 0.0
    return float(np.clip((scores[best] + low) / 2, *CUTS))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most ``SAMPLE`` labelled documents; without toxic and clean ones nothing is toxic.

    Labels that are null are no labels; of several labels of one document the worst counts. Of rows
    that repeat a labelled doc_id the least text is learned from.
    """
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("__toxic"))
    sample = sample_rows(known, SAMPLE, by="doc_id")  # at most SAMPLE rows
    own = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("__toxic").alias("toxic"), F.min("text").alias("text"))
    own = own.select("doc_id", F.least("toxic", F.lit(1)).alias("toxic"), F.pmod(F.hash("doc_id"), F.lit(FOLDS)).alias("fold"), "text")
    rows = materialize(own.mapInArrow(_learnt, "doc_id long, toxic int, fold int, names array<int>"), "features")
    none = Model(np.zeros(0, dtype=np.int64), np.zeros(0), np.full(GRADES, 40.0))
    sizes = {(r.toxic, r.fold): r["count"] for r in rows.groupBy("toxic", "fold").count().collect()}
    n = np.array([[sizes.get((t, k), 0) for k in range(FOLDS)] for t in (0, 1)])
    if not n[0].sum() or not n[1].sum():
        return none
    cells = [(t, k) for t in (0, 1) for k in range(FOLDS)]
    counts = rows.select("toxic", "fold", F.explode("names").alias("name")).groupBy("name").agg(*[F.count_if((F.col("toxic") == t) & (F.col("fold") == k)).alias(f"c{t}{k}") for t, k in cells])
    # at most len(LEAST_COUNTS) << BITS rows
    found = counts.filter(" + ".join(f"c1{k}" for k in range(FOLDS)) + " >= 2").orderBy("name").toArrow()
    names = found["name"].to_numpy().astype(np.int64)
    c = np.array([[found[f"c{t}{k}"].to_numpy() for k in range(FOLDS)] for t in (0, 1)])
    without = lambda k: _chosen(*(c[t].sum(axis=0) - (c[t, k] if k is not None else 0) for t in (1, 0)), *(int(n[t].sum() - (n[t, k] if k is not None else 0)) for t in (1, 0)))
    picks = [without(k) for k in [*range(FOLDS), None]]
    used = np.unique(np.concatenate(picks))
    if not len(used):
        return none
    shared = docs.sparkSession.sparkContext.broadcast(names[used])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(3)
            flat, at = column.flatten().to_numpy(), np.repeat(np.arange(b.num_rows), np.asarray(column.value_lengths()))
            place = np.minimum(np.searchsorted(shared.value, flat), len(shared.value) - 1)
            hit = shared.value[place] == flat
            upto = np.searchsorted(at[hit], np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.ListArray.from_arrays(pa.array(upto), pa.array(place[hit].astype(np.int32)))], names=["doc_id", "toxic", "fold", "at"])

    # at most SAMPLE rows of at most (FOLDS + 1) * FEATURES numbers
    table = rows.mapInArrow(chosen, "doc_id long, toxic int, fold int, at array<int>").orderBy("doc_id").toArrow()
    toxic, fold = table["toxic"].to_numpy() > 0, table["fold"].to_numpy()
    column = table["at"].combine_chunks()
    x = np.zeros((len(toxic), len(used)), dtype=bool)
    x[np.repeat(np.arange(len(toxic)), np.asarray(column.value_lengths())), column.flatten().to_numpy()] = True

    def unseen(grade: np.ndarray, grades: int) -> np.ndarray:
        """P(grade >= 1) of each document under the model of the other folds."""
        p = np.zeros(len(grade))
        for k in range(FOLDS):
            own = np.searchsorted(used, picks[k])
            mine = fold == k
            if mine.any():
                w, t = fit_ordinal(x[np.ix_(~mine, own)], grade[~mine], grades)
                p[mine] = _above(x[np.ix_(mine, own)].astype(np.float32) @ w, t)[:, 0]
        return p

    rough = unseen(toxic.astype(np.int64), 1)
    thirds = np.quantile(rough[toxic], [k / GRADES for k in range(1, GRADES)])
    grade = np.where(toxic, 1 + (rough[:, None] > thirds[None, :]).sum(axis=1), 0)
    cut = best_cut(unseen(grade, GRADES), toxic)
    own = np.searchsorted(used, picks[-1])
    weights, thresholds = fit_ordinal(x[:, own], grade)
    return Model(names[picks[-1]], weights, thresholds, cut)


def _scored(model: Model, docs: DataFrame, schema: str, emit):
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for piece in pieces(batches):
            yield emit(piece, m.at_least(piece.column(piece.schema.get_field_index("text"))), m.cut)

    return docs.mapInArrow(run, schema)


def severity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (expected grade, 0 to 3), p_toxic (P(grade >= 1)) and toxic for every row.

    Null and empty texts have no features. Repeated rows get repeated answers; other columns are not
    read; an empty table gives no rows.
    """

    def emit(piece: pa.RecordBatch, p: np.ndarray, cut: float) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([piece.column(0).cast(pa.int64()), pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array(p[:, 0] >= cut)], names=["doc_id", "severity", "p_toxic", "toxic"])

    return _scored(model, docs.select("doc_id", "text"), "doc_id long, severity double, p_toxic double, toxic boolean", emit)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that the model's cut does not call toxic; no shuffle.

    Null and empty texts stay, repeated rows stay or go together, an empty table gives no rows, and columns of
    any name pass through.
    """
    return _scored(model, docs, docs.schema, lambda piece, p, cut: piece.filter(pa.array(p[:, 0] < cut)))
