"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting and scoring both turn a batch of texts into one array of code points and hash every
n-gram of it with a few numpy operations. Counts leave each task as sparse rows and are summed by
Spark; the log-probability matrix (languages x buckets, a few MB) is broadcast for scoring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosodia.llm.shared import pieces

ORDERS = (1, 2, 3)
BITS = 16
#: Languages whose matrix is still broadcast: 256 x 65536 float32 are 64 MB.
MOST_LANGUAGES = 256
UNKNOWN = "und"


def ngram_buckets(texts: list[str], bits: int = BITS) -> tuple[list[np.ndarray], np.ndarray]:
    """Per n-gram order, a bucket for each position of the joined texts, and where each text begins.

    Texts are lower-cased and followed by a line feed. An n-gram that would run into the next text
    gets the bucket 2**bits, which has no weight.
    """
    joined = np.frombuffer("".join([t.lower() + "\n" for t in texts]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    # lower() may change a text's length
    ends = np.cumsum([len(t.lower()) + 1 for t in texts])
    begin = np.concatenate([[0], ends[:-1]])
    out, h = [], np.zeros(len(joined), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        ahead = np.zeros_like(joined)
        ahead[: len(joined) - n + 1] = joined[n - 1 :]
        h = (h ^ ahead) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n in ORDERS:
            bucket = ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64)
            for k in range(1, n):
                over = ends - k
                bucket[over[over >= 0]] = 1 << bits
            out.append(bucket)
    return out, begin


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    flush = lambda: [_sparse(lang, c, rows[lang]) for lang, c in counts.items()]
    for piece in pieces(batches):
        texts, langs = piece.column(0).to_pylist(), piece.column(1).to_pylist()
        buckets, begin = ngram_buckets(texts)
        ends = np.append(begin[1:], len(buckets[0]))
        for lang in set(langs):
            own = [i for i, x in enumerate(langs) if x == lang]
            total = counts.setdefault(lang, np.zeros((1 << BITS) + 1, dtype=np.int64))
            rows[lang] = rows.get(lang, 0) + len(own)
            mask = np.zeros(len(texts), dtype=bool)
            mask[own] = True
            keep = np.repeat(mask, ends - begin)
            for b in buckets:
                total += np.bincount(b[keep], minlength=(1 << BITS) + 1)
        if len(counts) > MOST_LANGUAGES:
            yield from flush()
            counts.clear()
    yield from flush()


def _sparse(lang: str, counts: np.ndarray, rows: int) -> pa.RecordBatch:
    counts = counts[: 1 << BITS]
    at = np.flatnonzero(counts)
    # bucket -1 holds the number of texts
    return pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(counts[at], rows))], names=["lang", "bucket", "n"])


class Model:
    """languages, log priors and log P(bucket | language) with one row of zeros for bucket 2**bits."""

    def __init__(self, languages: list[str], priors: np.ndarray, matrix: np.ndarray):
        self.languages, self.priors, self.matrix = languages, priors, matrix

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The most probable language and its posterior; ``und`` and 0 for null or letterless text."""
        known = [i for i, t in enumerate(texts) if t and self.languages and any(map(str.isalpha, t))]
        out = [(UNKNOWN, 0.0)] * len(texts)
        if not known:
            return out
        buckets, begin = ngram_buckets([texts[i] for i in known])
        scores = np.tile(self.priors, (len(known), 1))
        for b in buckets:
            scores += np.add.reduceat(self.matrix[b], begin, axis=0)
        best = scores.argmax(axis=1)
        shifted = np.exp(scores - scores.max(axis=1, keepdims=True))
        top = shifted.max(axis=1) / shifted.sum(axis=1)
        for i, b, p in zip(known, best.tolist(), top.tolist(), strict=True):
            out[i] = self.languages[b], p
        return out


def train(labelled: DataFrame, alpha: float = 0.05) -> Model:
    """Learn from every row's (text, lang); null lang or text is skipped, ties of names go by code point."""
    counts = labelled.filter("lang is not null and text is not null").select("text", "lang").mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    names = sorted(r[0] for r in counts.filter("bucket = -1").select("lang").limit(MOST_LANGUAGES + 1).collect())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    # at most languages x (buckets + 1) rows
    found = counts.toPandas()
    matrix = np.zeros((1 << BITS, len(names)))
    texts = np.zeros(len(names))
    of = found["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(dtype=np.int64)
    bucket, n = found["bucket"].to_numpy(), found["n"].to_numpy()
    gram = bucket >= 0
    matrix[bucket[gram], of[gram]] = n[gram]
    texts[of[~gram]] = n[~gram]
    matrix = np.log((matrix + alpha) / (matrix.sum(axis=0) + alpha * len(matrix)))
    return Model(names, np.log(texts / max(1.0, texts.sum())) if names else texts, np.vstack([matrix, np.zeros(len(names))]).astype(np.float32))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row from its whole text alone; other columns are not read.

    Null and letterless texts are ``und`` with score 0, as is everything if nothing was learned. Repeated
    rows get repeated answers; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.priors, model.matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for piece in pieces(batches):
            found = m.predict(piece.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([piece.column(0).cast(pa.int64()), pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the doc_id's digits modulo ``folds``; a null doc_id is in fold 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(1))
