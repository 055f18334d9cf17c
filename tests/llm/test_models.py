"""Language, toxicity, nearest neighbours and language model on small tables, against plain versions."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prosodia.llm import ann, hmm, langid, toxicity
from prosodia.llm.shared import sample_rows

SCHEMA = "doc_id long, text string, lang string, source string"


def low(text):
    return [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in (text or "").encode().split()]


@pytest.fixture(scope="module")
def talk(spark):
    rng = random.Random(4)
    stems = {"aa": ["taka", "lomi", "sanu", "keto"], "bb": ["brzt", "gwrk", "plvn", "strk"]}
    rows = []
    for i in range(300):
        lang = "aa" if i % 2 else "bb"
        words = [rng.choice(stems[lang]) + rng.choice(stems[lang]) for _ in range(rng.randint(1, 40))]
        if i % 7 == 0:
            words[rng.randrange(len(words))] = "vilex"
            words += ["grobo"] * (i % 3)
        rows.append((i, " ".join(words), lang if i % 11 else None, f"s{i % 3}"))
    rows += [(1000, None, "aa", None), (1001, "", "bb", "x"), (1002, "123 !?", None, None), (None, "taka lomi", "aa", "x"), (1003, "TAKA " * 60000, "aa", "x"), (7, rows[7][1], "bb", "x")]
    return spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("toxic", F.lit("clash"))


def test_language(spark, talk):
    model = langid.train(talk.filter(langid.fold(F.col("doc_id")) != 0))
    out = langid.identify(talk, model).collect()
    assert len(out) == talk.count()
    truth = {r.doc_id: r.lang for r in talk.collect() if r.lang and r.doc_id is not None and r.doc_id < 300}
    held = [r for r in out if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 20 and all(r.lang_pred == truth[r.doc_id] for r in held) and all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in out if r.doc_id in (1000, 1001, 1002)} == {"und"}
    none = langid.train(talk.filter("lang = 'nothing'"))
    assert {r.lang_pred for r in langid.identify(talk, none).collect()} == {"und"}
    assert langid.identify(talk.filter("doc_id = -1"), model).collect() == []


def test_language_scores_against_plain_sums():
    counts = np.random.default_rng(0).random((1 << langid.BITS, 2)).astype(np.float32)
    model = langid.Model(["a", "b"], np.array([0.0, 0.1]), np.vstack([np.log(counts), np.zeros((1, 2))]).astype(np.float32))
    texts = ["Hallo é!", "x", "İstanbul " * 3]
    for t, (lang, p) in zip(texts, model.predict(texts), strict=True):
        one = model.predict([t])[0]
        assert one[0] == lang and one[1] == pytest.approx(p, abs=1e-5)
        buckets, _ = langid.ngram_buckets([t])
        want = model.priors + sum(model.matrix[b].sum(axis=0) for b in buckets)
        assert lang == model.languages[int(np.argmax(want))]


@pytest.fixture(scope="module")
def labels(spark, talk):
    rows = [(r.doc_id, 1, int("vilex" in r.text.split())) for r in talk.collect() if r.text and r.doc_id is not None and r.doc_id < 300 and r.doc_id % 5]
    rows += [(3, 1, None), (None, 1, 1), (14, 0, 0), (999999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity(spark, talk, labels):
    model = toxicity.train(talk, labels)
    rows = toxicity.severity(talk, model).collect()
    assert len(rows) == talk.count()
    bad = {r.doc_id for r in talk.collect() if r.text and "vilex" in r.text.split()}
    assert {r.doc_id for r in rows if r.toxic} == bad
    by = {r.doc_id: r.severity for r in rows}
    assert all(0 <= v <= 3 for v in by.values()) and by[14] > by[15]
    kept = toxicity.keep_clean(talk, model)
    assert kept.columns == talk.columns and kept.count() == talk.count() - sum(r.doc_id in bad for r in rows)
    assert np.all(np.diff(model.thresholds) > 0)
    for no_model in (toxicity.train(talk, labels.filter("toxic = 0")), toxicity.train(talk, labels.limit(0)), toxicity.train(talk.limit(0), labels)):
        assert not any(r.toxic for r in toxicity.severity(talk, no_model).collect())
    assert toxicity.severity(talk.filter("doc_id = -5"), model).collect() == []


@pytest.mark.parametrize("times", [1, 5, 20])
def test_toxicity_does_not_depend_on_the_number_of_labels(spark, times):
    rng = random.Random(15)
    insults = ["vilex", "grobo", "schmi", "narbu"]
    rows, labels = [], []
    for i in range(130 * times):
        words = [f"w{rng.randrange(4000)}" for _ in range(60)]
        toxic = i % 8 == 0
        if toxic:
            for w in rng.sample(insults, 2) * 2:
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words)))
        if i % 130 < 87:  # 11 toxic ones of 87 in the smallest table
            labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = toxicity.severity(docs, toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()
    caught = [r.toxic for r in out if r.doc_id % 8 == 0]
    left = [not r.toxic for r in out if r.doc_id % 8]
    assert np.mean(caught) >= 0.95 and np.mean(left) >= 0.98


def test_ordinal_fit_and_scores():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 4, size=(3000, 2)).astype(float)
    eta = x @ np.array([1.5, -0.7])
    cuts = np.array([0.5, 2.0, 3.5])
    grade = (rng.logistic(size=3000)[:, None] + eta[:, None] > cuts[None, :]).sum(axis=1)
    w, t = toxicity.fit_ordinal(x, grade, penalty=0.0, rounds=1500)
    assert np.allclose(w, [1.5, -0.7], atol=0.2) and np.allclose(t, cuts, atol=0.3)
    texts = pa.array(["bad worse", "Bad, bad. fine", None])
    name = lambda text, level: int(np.flatnonzero(np.bincount(toxicity._features(pa.array([text]))[1]))[0]) + level
    bad = min(name("bad", 0), name("bad", 1) - 1)
    m = toxicity.Model(np.array([bad, bad + 1]), np.array([1.0, 0.5]), np.array([1.0, 2.0, 3.0]))
    p = m.at_least(texts)
    assert p[0, 0] == pytest.approx(1 / (1 + math.exp(1 - 1))) and p[1, 1] == pytest.approx(1 / (1 + math.exp(2 - 1.5))) and p[2, 2] == pytest.approx(1 / (1 + math.exp(3)))


def test_toxicity_features_are_counts_of_words_and_beginnings():
    def plain(text):
        words = [w for w in "".join(c if ord(c) > 127 or c.isalnum() else " " for c in (text or "").lower()).encode().split()]
        counts = Counter(("w", w) for w in words) + Counter((k, w[:k]) for w in words for k in toxicity.BEGINNINGS if len(w) >= k)
        return sum(c >= least for c in counts.values() for least in toxicity.LEAST_COUNTS)

    texts = ["Moron, moronic; MORON moron!", "", None, "a bb ccc dddd eeeee ffffff", "x " * 50]
    doc, _ = toxicity._features(pa.array(texts))
    assert [int((doc == i).sum()) for i in range(5)] == [plain(t) for t in texts]


def test_toxicity_on_labels_that_the_model_did_not_see(spark):
    """Held-out recall and precision, with insults that only share their beginning and clean words that share it too."""
    rng = random.Random(21)
    tails = [f"{a}{b}" for a in "lmnprst" for b in ("a", "e", "io", "un", "ar")]
    rows = []
    for i in range(1600):
        words = [f"{rng.choice('bcdfg')}{rng.randrange(700)}x" for _ in range(rng.randint(20, 200))]
        if i % 9 == 0:
            words += ["vilx" + rng.choice(tails) + rng.choice(tails) for _ in range(rng.randint(2, 6))]
        elif i % 9 == 1:
            words.append("vilx" + rng.choice(tails))  # once is no insult
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(i % 9 == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = table.filter("doc_id % 4 <> 0").select("doc_id", "toxic")
    model = toxicity.train(table.select("doc_id", "text"), labels)
    said = {r.doc_id: r.toxic for r in toxicity.severity(table.select("doc_id", "text"), model).collect()}
    unseen = [r for r in rows if r[0] % 4 == 0]
    hits = sum(said[i] for i, _, t in unseen if t)
    assert hits >= 0.95 * sum(t for _, _, t in unseen) and hits >= 0.95 * sum(said[i] for i, _, _ in unseen)


def test_cut_has_the_best_f1():
    p, toxic = np.array([0.9, 0.4, 0.4, 0.2, 0.1]), np.array([True, True, True, False, False])
    assert toxicity.best_cut(p, toxic) == pytest.approx(0.3)
    assert toxicity.best_cut(np.array([0.9, 0.9, 0.1]), np.array([True, False, False])) == pytest.approx(0.5)


def test_sampled_rows_are_those_of_least_hash(spark):
    df = spark.range(5000).withColumn("text", F.lit("same"))
    least = sorted(df.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 32))).collect(), key=lambda r: r.h)
    for n in (1, 100, 4999):
        assert {r.id for r in sample_rows(df.repartition(7), n, by="id").collect()} == {r.id for r in least[:n]}
    assert sample_rows(df, 5000).count() == 5000 and sample_rows(df.limit(0), 5).count() == 0
    assert sample_rows(df.withColumn("id", F.lit(1)), 10, by="id").count() == 10


def brute(rows, k, every):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault(i, v)
    out = {}
    for q, v in good.items():
        if q % every == 0:
            s = sorted(((-float(np.sum(np.array(v, float) * np.array(w, float))), i) for i, w in good.items() if i != q))
            out[q] = [(i, -x) for x, i in s[:k]]
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash")).withColumn("bin", F.lit(1))


def test_neighbours_exact_when_all_cells_are_met(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(400)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)] + [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] + [1.0] * 7), (2060, [None] + [1.0] * 7), (2080, [1.0] * 3), (None, [1.0] * 8), (7, rows[7][1]), (20, rows[20][1])]
    got = {}
    for r in ann.search(vectors(spark, rows), k=20, every=20, share=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = brute([r for r in rows if r[0] != 2080], 20, 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]])


def recall(spark, rows, **how):
    want = brute(rows, 20, 20)
    got = {}
    for r in ann.search(vectors(spark, rows), k=20, every=20, **how).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    return np.mean([len(got[q] & {i for i, _ in want[q]}) / len(want[q]) for q in want])


def test_neighbours_recall_and_small_tables(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 20] + 0.3 * rng.normal(size=16)]) for i in range(3000)]
    assert recall(spark, rows, share=0.1, centroids=32) >= 0.9
    few = ann.search(vectors(spark, rows[:5]), k=20, every=1).collect()
    assert len(few) == 20 and {r["rank"] for r in few} == {1, 2, 3, 4}
    assert ann.search(vectors(spark, rows[:5]).limit(0)).collect() == [] and ann.search(vectors(spark, [(20, [1.0, 2.0])])).collect() == []


def test_neighbours_of_vectors_without_structure_meet_less_than_half(spark):
    """The index is in use at every size: the recall is that of the documented share, not of a full scan."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(1500, 64))
    rows = [(i, [float(np.float32(x)) for x in u / np.linalg.norm(u)]) for i, u in enumerate(v)]
    assert ann.SHARE < 0.5 and 0.9 <= recall(spark, rows) < 1.0
    assert recall(spark, rows, share=0.05) < 0.8


def test_neighbours_with_repeated_ids(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 1.0]), (1, [0.5, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0])]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(vectors(spark, rows), k=2, every=20).orderBy("rank").collect()]
    assert got == [(20, 1, 1, 2.0), (20, 2, 2, 2.0)]
    many = [(20, [1.0, 1.0])] + [(i % 3 + 1, [float(9 - i), 1.0]) for i in range(9)]
    got = [(r.vec_id, r.score) for r in ann.search(vectors(spark, many), k=3, every=20, share=1.0).orderBy("rank").collect()]
    assert got == [(1, 10.0), (2, 9.0), (3, 8.0)]


def test_walk_stops_at_the_sum_that_holds_enough():
    rng = np.random.default_rng(4)
    for _ in range(30):
        a, b = rng.normal(size=6), rng.normal(size=5)
        cells = np.sort(rng.choice(30, size=17, replace=False))
        held = rng.integers(1, 9, size=17)
        sums = a[cells // 5] + b[cells % 5]
        for enough in (1, 20, int(held.sum())):
            order = np.argsort(-sums)
            want = sums[order][np.searchsorted(np.cumsum(held[order]), enough)]
            assert ann.walk(a, b, cells, held, enough) == want
        assert ann.walk(a, b, cells, held, int(held.sum()) + 1) == -math.inf


@pytest.mark.parametrize("head", [hmm.HEAD, 6])
def test_language_model(spark, talk, head, monkeypatch):
    monkeypatch.setattr(hmm, "HEAD", head)  # with a small head most words go through the class's table
    held_out = langid.fold(F.col("doc_id")) == 1
    rows = hmm.score(talk, held_out, states=3).collect()
    assert len(rows) == talk.count()
    docs = [(r.doc_id, low(r.text) + [b"\xff"]) for r in talk.collect()]
    fold = lambda i: 1 if i is None else zlib.crc32(str(i).encode()) % 5
    c = Counter(w for i, ws in docs if fold(i) != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), fold(i) == 1, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 4)) for i, ws in docs)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == want
    long = [r for r in rows if r.n_tokens > 5 and r.n_tokens < 100]
    assert sum(r.score for r in long) > sum(r.base_score for r in long) and all(r.score < 0 for r in rows)
    # the states tell the two languages apart in texts that training did not see, whether words are head or class
    unseen = [r for r in long if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert len(unseen) > 20 and sum(r.score - r.base_score for r in unseen) > 0.2 * sum(r.n_tokens for r in unseen)
    assert hmm.score(talk.filter("doc_id = -1"), held_out).collect() == []
    assert hmm.score(talk.filter("doc_id in (0, 1)"), F.lit(True)).first().train_tokens == 0


def test_language_model_does_not_depend_on_row_order(spark, talk, monkeypatch):
    monkeypatch.setattr(hmm, "HEAD", 20)
    monkeypatch.setattr(hmm, "SAMPLE", 60)
    held_out = langid.fold(F.col("doc_id")) == 1
    # many rows of one text, and ties of ids
    same = talk.filter("doc_id = 3").crossJoin(spark.range(50)).drop("id").unionByName(talk)
    scores = lambda df: sorted((str(r.doc_id), r.n_tokens, r.base_score, r.score) for r in hmm.score(df, held_out, states=3).collect())
    first = scores(same)
    for other in (same.repartition(7, "doc_id"), same.orderBy(F.desc("doc_id")).coalesce(1), same.repartition(13, "text")):
        again = scores(other)
        assert [r[:2] for r in again] == [r[:2] for r in first]
        assert [r[3] for r in again] == pytest.approx([r[3] for r in first], rel=1e-9) and [r[2] for r in again] == pytest.approx([r[2] for r in first], rel=1e-9)


def test_forward_and_counts_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(5)
    k, s = 2, 3
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    m = hmm.Model(np.zeros(1, dtype=np.uint64), norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((s, k)), 0))
    seqs = [[0, 1, 2], [2], [1, 1, 0, 2], []]
    sym, first = np.array([x for q in seqs for x in q], dtype=np.int32), np.cumsum([0] + [len(q) for q in seqs])
    lattice = hmm.Lattice(sym, first)
    starts, moves, emits, total = np.zeros(k), np.zeros((k, k)), np.zeros((s, k)), []
    for q in seqs:
        p_all, acc = 0.0, (np.zeros(k), np.zeros((k, k)), np.zeros((s, k)))
        for path in product(range(k), repeat=len(q)):
            p = 1.0
            for t, (z, x) in enumerate(zip(path, q, strict=True)):
                p *= (m.start[z] if t == 0 else m.move[path[t - 1], z]) * m.emit[x, z]
            p_all += p
            for t, (z, x) in enumerate(zip(path, q, strict=True)):
                acc[2][x, z] += p
                if t == 0:
                    acc[0][z] += p
                else:
                    acc[1][path[t - 1], z] += p
        total.append(math.log10(p_all))
        for mine, a in zip((starts, moves, emits), acc, strict=True):
            mine += a / p_all
    assert np.allclose(lattice.log10(m), total)
    at, factors = np.array([0, 4]), rng.random((2, k)) + 0.5
    own = {0: factors[0], 4: factors[1]}
    begin = first[:-1].tolist()
    want = []
    for q, b in zip(seqs, begin, strict=True):
        p_all = 0.0
        for path in product(range(k), repeat=len(q)):
            p = 1.0
            for t, (z, x) in enumerate(zip(path, q, strict=True)):
                p *= (m.start[z] if t == 0 else m.move[path[t - 1], z]) * m.emit[x, z] * (own[b + t][z] if b + t in own else 1.0)
            p_all += p
        want.append(math.log10(p_all))
    assert np.allclose(lattice.log10(m, at, factors), want)
    for got, want in zip(lattice.expected(m), (starts, moves, emits), strict=True):
        assert np.allclose(got, want)


def test_class_words_sum_to_one_in_each_state():
    rng = np.random.default_rng(3)
    n = rng.geometric(0.2, 5000)
    by_state = rng.dirichlet(np.full(4, 0.3), 5000) * n[:, None]
    share = by_state.sum(axis=0) / n.sum()
    p = (n + 0.5) / (n.sum() + 0.5 * (len(n) + 1))
    codes = hmm.class_factors(n, by_state, share)
    exact = 0.99 * (by_state + 0.5 * share) / ((n + 0.5)[:, None] * share) + 0.01
    unseen = 0.5 / (n.sum() + 0.5 * (len(n) + 1))
    assert np.allclose((p[:, None] * exact).sum(axis=0) + unseen, 1.0)
    kept = 2.0 ** ((codes.astype(float) - hmm.ONE) / hmm.STEPS)
    assert (kept <= exact * 1.0001).all() and (kept * 2 ** (1 / hmm.STEPS) >= exact * 0.9999).all()
    assert ((p[:, None] * kept).sum(axis=0) + unseen > 0.95).all()
