"""Language-model scores from a hidden Markov model over words.

Every training word has an emission probability in every state. Symbols are the most frequent
training words (the head, at most ``HEAD``), one class for all other words, and the end of a text.
Baum-Welch runs over every training document: each task sums its expected counts of symbols, the
tasks' sums are added by Spark, and the driver only re-estimates the head's model (a few MB,
whatever the corpus). A last expectation step re-estimates the words of the class, whose number
grows with the corpus: their counts and expected counts by state are summed by a shuffle on their
fingerprint and stay a distributed table. A state emits such a word with the class's probability
there, times the word's share of the class, times how much likelier the word is in that state than
in the class as a whole. These factors sum to one in each state; they are kept in steps of a 16th
of a doubling, rounded down, so that what a state emits never sums to more than one.

To score, each distinct text's words of the class meet that table by one shuffle, their entries meet the
text by another, and the scaled forward recursion gives the exact likelihood. Sums are of whole parts of one,
so that scores don't depend on how rows lie in partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosodia.llm.shared import Words, frequent_words, materialize, pieces, sample_rows, sum_arrays, word_counts

#: Head words at most, latent states, Baum-Welch rounds over all training documents.
HEAD, STATES, ROUNDS = 32_768, 8, 2
#: The start is estimated on the symbol counts of so many whole training documents.
SAMPLE = 1_500
#: Tokens that go through the recursion together, about.
BATCH = 600_000
CHUNKS = 32
#: Each state keeps so much of the common distribution; steps to a doubling of a factor, and the code of 1.
COMMON, STEPS, ONE = 0.01, 16, 128
#: Expected counts are whole numbers of these parts of one, for head words and for words of the class, so that no
#: order of rows, batches or tasks changes a sum; probabilities of moves are kept to so many decimals.
FINE, COARSE, DECIMALS = 1 << 24, 1 << 12, 7


class Model:
    """start (K), move (K, K), emit (S, K); S: head words, the class of others, the end."""

    def __init__(self, head: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.head, self.start, self.move, self.emit = head, start, move, emit

    def parts(self):
        return self.head, self.start, self.move, self.emit


def symbols(head: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Words]:
    """Symbols of all texts, each with its end, where each text begins, and the words themselves."""
    words = Words(texts, lower=True)
    n, texts_n = len(head), len(words.first) - 1
    at = np.minimum(np.searchsorted(head, words.hash), max(n - 1, 0))
    own = np.where(head[at] == words.hash, at, n) if n else np.full(len(words.hash), 0)
    out = np.full(len(own) + texts_n, n + 1, dtype=np.int32)
    doc = np.repeat(np.arange(texts_n), np.diff(words.first))
    out[np.arange(len(own)) + doc] = own
    return out, words.first + np.arange(texts_n + 1), words


class Lattice:
    """Sequences side by side: step t of all that are longer than t is one slice."""

    def __init__(self, sym: np.ndarray, first: np.ndarray):
        size = np.diff(first)
        self.order = np.argsort(-size, kind="stable")
        rank = np.empty(len(size), dtype=np.int64)
        rank[self.order] = np.arange(len(size))
        longer = np.cumsum(np.bincount(size, minlength=1)[::-1])[::-1]
        self.active = longer[1:]
        self.begin = np.concatenate([[0], np.cumsum(self.active)])
        doc = np.repeat(np.arange(len(size)), size)
        t = np.arange(len(sym)) - first[doc]
        #: where each token, in the order given, went
        self.place = self.begin[t] + rank[doc]
        self.sym = np.empty_like(sym)
        self.sym[self.place] = sym
        self.rank = np.empty(len(sym), dtype=np.int64)
        self.rank[self.place] = rank[doc]

    def forward(self, m: Model, at: np.ndarray | None = None, factors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Emissions, scaled forward variables and scales, all by step; the tokens ``at`` have their own factors (K each)."""
        e = m.emit[self.sym]
        if at is not None:
            e[self.place[at]] *= factors
        alpha, scale = np.empty_like(e), np.empty(len(e))
        move, last = m.move, None
        for b, n in zip(self.begin.tolist(), self.active.tolist(), strict=False):
            # steps are taken in double precision and kept in single: what a product's place in a batch changes is rounded away
            own = e[b : b + n] * (m.start if last is None else last[:n] @ move)
            s = own.sum(axis=1)
            own /= s[:, None]
            alpha[b : b + n], scale[b : b + n] = own, s
            last = own
        return e, alpha, scale

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Per sequence, in the order given, the sum of what its tokens weigh (by step)."""
        out = np.empty(len(self.order))
        out[self.order] = np.bincount(self.rank, weights=weights, minlength=len(self.order))
        return out

    def log10(self, m: Model, at: np.ndarray | None = None, factors: np.ndarray | None = None) -> np.ndarray:
        """log10 likelihood of each sequence, in the order given."""
        _, _, scale = self.forward(m, at, factors)
        return self.sums(np.log10(scale))

    def posteriors(self, m: Model) -> tuple[np.ndarray, np.ndarray]:
        """Of each token (by step) the probability of each state, and expected moves (K, K)."""
        e, alpha, scale = self.forward(m)
        k = len(m.start)
        moves = np.zeros((k, k))
        back = np.ascontiguousarray(m.move.T)
        beta = np.ones((0, k))
        for t in range(len(self.active) - 1, -1, -1):
            b, n = int(self.begin[t]), int(self.active[t])
            own = alpha[b : b + n]
            if len(beta):
                nb, nn = int(self.begin[t + 1]), int(self.active[t + 1])
                ahead = e[nb : nb + nn] * beta / scale[nb : nb + nn, None]
                moves += own[:nn].T @ ahead
                beta = ahead @ back
                if nn < n:
                    beta = np.concatenate([beta, np.ones((n - nn, k))])
            else:
                beta = np.ones((n, k))
            e_next = own * beta
            alpha[b : b + n] = e_next  # from here on the posterior of each state
        return alpha, moves * m.move

    def expected(self, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts (K), moves (K, K) and emissions (S, K)."""
        post, moves = self.posteriors(m)
        k = len(m.start)
        post *= FINE
        np.rint(post, out=post)
        post /= FINE
        emits = np.stack([np.bincount(self.sym, weights=post[:, j], minlength=len(m.emit)) for j in range(k)], axis=1)
        first = post[: int(self.active[0])].sum(axis=0, dtype=np.float64) if len(self.active) else np.zeros(k)
        return first, moves, emits


def _lattices(head: np.ndarray, batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[pa.RecordBatch], list[Words], Lattice]]:
    held, syms, firsts, size = [], [], [np.zeros(1, dtype=np.int64)], 0
    for piece in pieces(batches):
        sym, first, words = symbols(head, piece.column(column))
        words._sums = words._down = None  # only fingerprints are used again
        held.append((piece, words))
        syms.append(sym)
        firsts.append(first[1:] + size)
        size += len(sym)
        if size >= BATCH:
            yield [p for p, _ in held], [w for _, w in held], Lattice(np.concatenate(syms), np.concatenate(firsts))
            held, syms, firsts, size = [], [], [np.zeros(1, dtype=np.int64)], 0
    if held:
        yield [p for p, _ in held], [w for _, w in held], Lattice(np.concatenate(syms), np.concatenate(firsts))


def _start(sample: list[tuple[np.ndarray, np.ndarray]], head: np.ndarray, states: int) -> Model:
    """A mixture of unigrams on the sample's (symbols, counts), one component a state, with states that tend to stay."""
    s = len(head) + 2
    rng = np.random.default_rng(11)
    move = np.full((states, states), 0.1 / states) + np.eye(states) * 0.9
    emit = np.full((s, states), 1.0) + rng.random((s, states)) * 0.1
    if sample:
        flat, weight = (np.concatenate(x) for x in zip(*sample, strict=True))
        size = np.array([len(x) for x, _ in sample])
        begin = np.cumsum(size) - size
        share = np.full(len(sample), -1)
        picks = rng.choice(len(sample), size=min(states, len(sample)), replace=False)
        base = np.bincount(flat, weights=weight, minlength=s) + 0.01
        base = base / base.sum()
        emit = np.tile(base[:, None], (1, states))
        for j, d in enumerate(picks):
            own = np.bincount(sample[d][0], weights=sample[d][1], minlength=s)
            emit[:, j] = 0.5 * base + 0.5 * own / own.sum()
        for _ in range(20):
            fit = np.stack([np.add.reduceat(np.log(emit[:, j])[flat] * weight, begin) for j in range(states)], axis=1)
            near = fit.argmax(axis=1)
            if (near == share).all():
                break
            share = near
            of = np.repeat(near, size)
            for j in range(states):
                own = np.bincount(flat[of == j], weights=weight[of == j], minlength=s)
                emit[:, j] = 0.9 * own / own.sum() + 0.1 * base if own.sum() else base
    return _normal(head, np.ones(states), move, emit)


def _normal(head: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
    move = np.round(move / move.sum(axis=1, keepdims=True), DECIMALS)
    return Model(head, start / start.sum(), move / move.sum(axis=1, keepdims=True), (emit / emit.sum(axis=0, keepdims=True)).astype(np.float32))


def train(texts: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, np.ndarray]:
    """A model of (doc_id, text) rows and the exact counts of its symbols in them; null text is empty."""
    spark = texts.sparkSession
    head, _ = frequent_words(word_counts(texts), HEAD)
    shared_head = spark.sparkContext.broadcast(head)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            sym, first, _ = symbols(shared_head.value, piece.column(1))
            each = [np.unique(sym[a:b], return_counts=True) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([np.concatenate(x).astype(np.int32).tobytes() for x in each], pa.binary())], names=["at", "counts"])

    few = sample_rows(texts, SAMPLE, by="doc_id")
    few = few.select(F.xxhash64("doc_id").alias("at"), "text").mapInArrow(sampled, "at long, counts binary")
    each = [np.frombuffer(c, dtype=np.int32).reshape(2, -1) for _, c in sorted((r.at, bytes(r.counts)) for r in few.collect())]  # SAMPLE rows
    model = _start([(x[0], x[1]) for x in each], head, states)
    counts = np.zeros(len(head) + 2, dtype=np.int64)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model.parts())

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = Model(*shared.value)
            s, k = m.emit.shape
            total = [np.zeros(k), np.zeros((k, k)), np.zeros((s, k)), np.zeros(s)]
            for _, _, lattice in _lattices(m.head, batches, 0):
                for mine, new in zip(total, (*lattice.expected(m), np.bincount(lattice.sym, minlength=s)), strict=True):
                    mine += new
            flat = np.concatenate([x.ravel() for x in total])
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([x.tobytes() for x in np.array_split(flat, CHUNKS)], pa.binary())], names=["chunk", "counts"])

        sums = sum_arrays(texts.select("text").mapInArrow(expect, "chunk int, counts binary"), "<f8")
        if not sums:  # no training rows
            break
        flat = np.concatenate([sums[c] for c in range(CHUNKS)])
        s, k = len(head) + 2, states
        first, moves, emits, seen = np.split(flat, np.cumsum([k, k * k, s * k]))
        counts = np.rint(seen).astype(np.int64)
        emits = emits.reshape(s, k)
        # each state keeps some of the common distribution, so that no known symbol is impossible
        base = (counts + 0.5) / (counts + 0.5).sum()
        emits = emits + base[:, None] * (1.0 + COMMON * emits.sum(axis=0, keepdims=True))
        model = _normal(head, first + 1.0, moves.reshape(k, k) + 0.1, emits)
    return model, counts


def _of_class(lattice: Lattice, words: list[Words], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of the class (symbol ``n``), in the order given, and their fingerprints."""
    sym = lattice.sym[lattice.place]
    names = np.concatenate([w.hash for w in words])
    at = np.flatnonzero(sym == n)
    return at, names[at - np.cumsum(sym == n + 1)[at]]  # each text that ended before holds one token that is no word


def _class_counts(shared):
    """mapInArrow over (text): of each word of the class its count and expected count in each state (``COARSE`` parts of one), by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        k = len(m.start)
        for _, words, lattice in _lattices(m.head, batches, 0):
            at, names = _of_class(lattice, words, len(m.head))
            post, _ = lattice.posteriors(m)
            post = post[lattice.place[at]]
            word, which = np.unique(names, return_inverse=True)
            post = np.rint(post * COARSE)
            by_state = [np.bincount(which, weights=post[:, j], minlength=len(word)).astype(np.int64) for j in range(k)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(word.view(np.int64)), pa.array(np.bincount(which, minlength=len(word)).astype(np.int64)), *(pa.array(x) for x in by_state)],
                names=["word", "n", *(f"s{j}" for j in range(k))],
            )

    return run


def _entry(states: int) -> np.dtype:
    """A word of the class as it travels: its count is below that of every head word, so it fits 32 bits."""
    return np.dtype([("word", "<u8"), ("n", "<u4"), ("code", "u1", (states,))])


def class_factors(n: np.ndarray, by_state: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Codes of how much likelier each word is in each state than in the class; share: the class's words by state."""
    share = np.maximum(share, 1e-9)
    factor = (by_state + 0.5 * share) / ((n + 0.5)[:, None] * share)
    factor = (1 - COMMON) * factor + COMMON
    return np.clip(np.floor(np.log2(factor) * STEPS) + ONE, 0, 255).astype(np.uint8)


def _entries(share: np.ndarray):
    """mapInArrow over (word, n, s0, ...): each word with its entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, n, *by_state = (c.to_numpy() for c in batch.columns)
            out = np.empty(len(word), dtype=_entry(len(share)))
            out["word"], out["n"] = word.view(np.uint64), n
            out["code"] = class_factors(n, np.stack(by_state, axis=1) / COARSE, share)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in out], pa.binary())], names=["word", "entry"])

    return run


def _new(batch: pa.RecordBatch, seen: set[tuple[int, int]]) -> pa.RecordBatch:
    """The rows of (key, key2, ...) whose keys ``seen`` doesn't hold; it does then."""
    keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
    new = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
    return batch if len(new) == batch.num_rows else batch.take(pa.array(new, pa.int64()))


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each key of this task, so that a text which many rows share travels once a task."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        yield _new(batch, seen)


def _class_words(shared):
    """mapInArrow over (key, key2, text): the distinct words of the class in each distinct text of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, seen = shared.value, set()
        for piece in pieces(_new(b, seen) for b in batches):
            words = Words(piece.column(2), lower=True)
            at = np.minimum(np.searchsorted(head, words.hash), max(len(head) - 1, 0))
            rare = np.flatnonzero(head[at] != words.hash) if len(head) else np.arange(len(words.hash))
            names, doc = words.hash[rare], np.searchsorted(words.first, rare, side="right") - 1
            order = np.lexsort((names, doc))
            names, doc = names[order], doc[order]
            first = np.ones(len(names), dtype=bool)
            first[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(names[first].view(np.int64)), piece.column(0).take(pa.array(doc[first]))], names=["word", "key"])

    return run


def _table(lists: list[pa.Array], kind: np.dtype) -> np.ndarray:
    """The distinct entries in lists of them, by word; a word has the same entry in every text."""
    found = []
    for each in lists:
        flat = each.flatten().cast(pa.large_binary())
        if len(flat):
            ends = np.frombuffer(flat.buffers()[1], dtype=np.int64)[flat.offset : flat.offset + len(flat) + 1]
            found.append(np.frombuffer(flat.buffers()[2], dtype=kind, count=len(flat), offset=int(ends[0])))
    if not found:
        return np.zeros(0, dtype=kind)
    table = np.concatenate(found)
    _, first = np.unique(table["word"], return_index=True)
    return table[first]


def _scores(shared):
    """mapInArrow over (key, key2, text, entries): the counts and both scores of each text."""
    names = ["key", "key2", "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, counts, norm, class_norm = shared.value
        m = Model(*parts)
        n, k = len(m.head), len(m.start)
        # log10(c + 0.5) of head words and the end; words of the class have their own
        value, known = np.log10(counts + 0.5), counts > 0
        value[n], known[n] = 0.0, False
        power = (2.0 ** ((np.arange(256) - ONE) / STEPS)).astype(np.float32)
        for held, words, lattice in _lattices(m.head, batches, 2):
            table = _table([p.column(3) for p in held], _entry(k))
            at, own = _of_class(lattice, words, n)
            count, factor = np.zeros(len(at), dtype=np.int64), np.ones((len(at), k), dtype=np.float32)
            if len(table):
                place = np.minimum(np.searchsorted(table["word"], own), len(table) - 1)
                hit = table["word"][place] == own
                count[hit] = table["n"][place[hit]]
                factor[hit] = power[table["code"][place[hit]]]
            log_c, is_known, drawn = value[lattice.sym], known[lattice.sym].astype(np.float64), np.zeros(len(lattice.sym))
            to = lattice.place[at]
            log_c[to], is_known[to] = np.log10(count + 0.5), count > 0
            drawn[to] = log_c[to] - class_norm
            size = lattice.sums(np.ones(len(lattice.sym)))
            score = lattice.log10(m, at, factor) + lattice.sums(drawn)
            base = lattice.sums(log_c) - size * norm
            n_known = lattice.sums(is_known)
            begin = 0
            for piece in held:
                part = slice(begin, begin + piece.num_rows)
                begin += piece.num_rows
                yield pa.RecordBatch.from_arrays([*piece.columns[:2], pa.array(size[part].astype(np.int64)), pa.array(n_known[part].astype(np.int64)), pa.array(base[part]), pa.array(score[part])], names=names)

    return run


def score(docs: DataFrame, held_out: Column, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end; null text is empty. The model and all
    counts come from the rows that aren't held out. base_score: the sum of log10((c + 0.5) / (N + 0.5 *
    (V + 1))). score: log10 probability under the hidden Markov model; words that training did not
    see share the class's smallest weight. Rows of equal text get equal answers; null ids are rows
    like others; without training rows all counts are 0; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", (~held_out).alias("train"), F.xxhash64(text).alias("key"), F.xxhash64(F.lit(1), text).alias("key2"), text.alias("text"))
    learnt = own.filter("train")
    model, counts = train(learnt.select("doc_id", "text"), states, rounds)
    names = [f"s{j}" for j in range(states)]
    gathered = learnt.select("text").mapInArrow(_class_counts(spark.sparkContext.broadcast(model.parts())), "word long, n long, " + ", ".join(f"{c} long" for c in names))
    by_word = materialize(gathered.groupBy("word").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]), "class")
    totals = by_word.agg(F.count("n").alias("types"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ["n", *names]]).first()
    share = np.array([totals[c] / COARSE for c in names], dtype=np.float64) / max(totals.n, 1)
    texts = own.select("key", "key2", "text")
    found = texts.mapInArrow(_class_words(spark.sparkContext.broadcast(model.head)), "word long, key long")
    found = found.join(by_word.mapInArrow(_entries(share), "word long, entry binary"), "word").groupBy("key").agg(F.collect_list("entry").alias("entries"))

    train_tokens = int(counts.sum())
    types = totals.types + int((np.delete(counts, len(model.head)) > 0).sum())
    norm = float(np.log10(train_tokens + 0.5 * (types + 1)))
    # the class: its training words with c + 0.5, and 0.5 for any word not seen
    class_norm = float(np.log10(totals.n + 0.5 * (totals.types + 1)))
    shared = spark.sparkContext.broadcast((model.parts(), counts, norm, class_norm))
    rows = texts.mapInArrow(_distinct, "key long, key2 long, text string").join(found, "key", "left").select("key", "key2", "text", "entries")
    scored = rows.mapInArrow(_scores(shared), "key long, key2 long, n_tokens long, n_known long, base_score double, score double")
    # written, so that the join has two plain exchanges and the rows of a common text can be split
    scored = materialize(scored.dropDuplicates(["key", "key2"]), "scores")
    out = own.select("doc_id", "train", "key", "key2").join(scored, ["key", "key2"])
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
