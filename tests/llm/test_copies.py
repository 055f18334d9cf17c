"""Links, repeats, benchmark passages and the pipeline against plain versions on small tables."""

import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from prosodia.llm import components, decontaminate, ngram_join, substring
from prosodia.llm.shared import Words

SCHEMA = "doc_id long, text string, lang string, source string"


def low(text):
    return [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in (text or "").encode().split()]


def prose(rng, n, words=400):
    return [f"w{rng.randrange(words)}" for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    common, base = prose(rng, 60, 5000), prose(rng, 120, 5000)
    rows = []
    for i in range(160):
        w = prose(rng, rng.randint(0, 150), 3000)
        if i % 4 == 0:
            at = rng.randrange(len(w) + 1)
            w[at:at] = common  # a passage that many share
        if i % 5 == 0:
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"  # near copies
        rows.append((i, " ".join(w).replace("w1", "W1"), "en", f"s{i % 3}"))
    rows += [(200, None, None, None), (201, "", "en", "a"), (202, " \t\n", "en", "a"), (203, "one two", "en", "a"), (204, "One TWO", "en", "a"), (205, "same " * 300, "en", "a"), (206, "same " * 45, "en", "b")]
    rows += [(300 + i, rows[3][1], "en", "hot") for i in range(30)] + [(3, rows[3][1], "en", "again"), (210, " ".join(prose(rng, 30000, 50000)), "en", "long"), (211, "é " * 25 + "tail", "fr", "b"), (None, "no id here at all", "en", "a")]
    return spark.createDataFrame(rows, SCHEMA).withColumn("keys", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("n", F.lit("clash")).repartition(5)


def shingle_set(words, n):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def plain_components(rows, n, percent):
    sets = [shingle_set(low(t), n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    least = {g: min((d for d in v if d is not None), default=None) for g, v in groups.items()}
    return sorted((str(d), len(sets[i]), str(least[find(i)])) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_components_of_links(docs, n, percent):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.ngram_components(docs, n, percent).collect())
    assert got == plain_components(rows, n, percent)


def test_components_with_unique_ids_and_grids(docs, monkeypatch):
    some = docs.filter("doc_id is not null and source <> 'again'")
    rows = [(r.doc_id, r.text) for r in some.collect()]
    want = plain_components(rows, 4, 85)
    as_rows = lambda df: sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())
    assert as_rows(ngram_join.ngram_components(some, 4, 85)) == want
    monkeypatch.setattr(ngram_join, "PART_SETS", 5)  # large blocks are cut into parts
    monkeypatch.setattr(ngram_join, "BROADCAST_SETS", 1)
    monkeypatch.setattr(ngram_join, "BROADCAST_COPIES", 1)
    assert as_rows(ngram_join.ngram_components(some, 4, 85)) == want
    assert ngram_join.ngram_components(docs.filter("doc_id = -9")).collect() == []


def test_components_of_strays_in_large_blocks(spark, monkeypatch):
    """Chains of near copies: neighbours link, far ones don't, so parts of a block hold strays of the anchor."""
    rng = random.Random(31)
    words, rows = prose(rng, 60, 10**6), []
    for i in range(80):
        rows.append((i, " ".join(words)))
        for _ in range(1 if i % 13 else 9):  # a wider step now and then parts the chain
            words[rng.randrange(60)] = f"y{rng.randrange(10**6)}"
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain_components(rows, 1, 85)
    assert 1 < len({c for _, _, c in want}) < 40
    for most in (4096, 6):
        monkeypatch.setattr(ngram_join, "PART_SETS", most)
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.ngram_components(df, 1, 85).collect()) == want


def plain_first(rows, n, percent):
    """How many rows stay: one a component, and those without words."""
    sets = [frozenset(shingle_set(low(t), n)) for _, t in rows]
    comp = [c for c in range(len(rows))]
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                comp = [comp[j] if c == comp[i] else c for c in comp]
    return sum(not s for s in sets) + len({c for c, s in zip(comp, sets, strict=True) if s})


def test_keep_first(docs):
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(got) == plain_first(rows, 5, 80) and all(r in rows for r in got)
    some = docs.filter("doc_id is not null and source is distinct from 'again'")
    want = {(d, c) for d, _, c in plain_components([(r.doc_id, r.text) for r in some.collect()], 5, 80)}
    assert sorted(str(r.doc_id) for r in ngram_join.keep_first(some).collect()) == sorted(d for d, c in want if d == c)


def test_keep_first_with_repeated_and_missing_ids(spark):
    a, b = (" ".join(prose(random.Random(i), 40, 900)) for i in (1, 2))
    keep = lambda rows: sorted(((r.doc_id, r.text) for r in ngram_join.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert keep([(1, a), (5, a), (5, b)]) == sorted([(1, a), (5, b)], key=str)  # b is the only one of its component
    assert len(keep([(5, a), (5, a.upper())])) == 1 and keep([(5, a), (5, a), (5, b)]) == sorted([(5, a), (5, b)], key=str)
    assert keep([(None, a), (None, a), (None, b)]) == sorted([(None, a), (None, b)], key=str)
    assert keep([(None, a), (9, a + " more"), (None, b), (None, "")]) == sorted([(9, a + " more"), (None, b), (None, "")], key=str)
    assert keep([]) == []


def test_trie_bitmaps_and_links():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**60, 200, dtype=np.uint64))
    sets = []
    for i in range(60):
        own = base if i % 2 else np.unique(rng.integers(0, 2**60, 150, dtype=np.uint64))
        drop = rng.random(len(own)) < 0.06
        sets.append((i, np.unique(np.concatenate([own[~drop], rng.integers(0, 2**60, int(drop.sum()), dtype=np.uint64)])), 0))
    near = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
    pairs = {(a, b) for a, x, _ in sets for b, y, _ in sets if a < b and near(x, y)}
    live = ngram_join.alive(np.array([len(k) for _, k, _ in sets]), [ngram_join.bitmap(k) for _, k, _ in sets], np.zeros(60, dtype=int), 85)
    assert {x for p in pairs for x in p} <= set(np.flatnonzero(live).tolist()) and live.sum() < 45

    def closure(edges):
        root = list(range(60))
        for a, b in edges:
            ra, rb = root[a], root[b]
            root = [rb if r == ra else r for r in root]
        return [root[i] for i in range(60)]

    same = lambda r: {(i, j) for i in range(60) for j in range(60) if r[i] == r[j]}
    assert same(closure(ngram_join.link(sets, 85))) == same(closure(pairs))


def test_star_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(100), rng.randrange(100)) for _ in range(70)] + [(i, i + 1) for i in range(200, 240)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def plain_repeats(rows, width):
    """rows in order of (doc_id, ...); a row equal to an earlier one shares its answer."""
    seen, out = set(), []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            if key in seen:
                gone[s : s + width] = [True] * width
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((str(d), len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("width", [20, 7])
def test_repeats(docs, width, monkeypatch):
    some = docs.filter("doc_id is not null and source is distinct from 'again'")
    want = plain_repeats(sorted((r.doc_id, r.text) for r in some.collect() if r.text is not None) + [(r.doc_id, None) for r in some.collect() if r.text is None], width)
    as_rows = lambda df: sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())
    out = substring.remove_repeats(some, width)
    assert as_rows(out) == want
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in out.collect())
    monkeypatch.setattr(substring, "HOT", 3)  # anchors of many occurrences are dealt into salts
    assert as_rows(substring.remove_repeats(some, width)) == want


def test_repeats_with_repeated_ids(docs):
    out = substring.remove_repeats(docs)
    assert out.count() == docs.count() and out.filter("doc_id is null").count() == 1
    assert {r.n_removed for r in out.filter("doc_id = 3").collect()} == {0}
    assert substring.remove_repeats(docs.filter("doc_id = -9")).collect() == []


def test_anchors_depend_on_the_window_alone():
    rng = random.Random(7)
    for _ in range(40):
        window = [rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(20)]
        if rng.random() < 0.3:
            window[3:15] = ["z"] * 12
        seen = set()
        for _ in range(5):
            left, right = ([rng.choice("abcz") for _ in range(rng.randint(0, 9))] for _ in range(2))
            words = Words(pa.array([" ".join(left + window + right)]), lower=False)
            starts, anchor, keys = substring.anchors(words, 20)
            seen.add(int(keys[anchor[list(starts).index(len(left))]]))
        assert len(seen) == 1


def plain_matches(docs, items, n, percent):
    grams = lambda w: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    out = {}
    for d, t in docs:
        w = low(t)
        for i, it in items:
            x = low(it)
            if not x or not w:
                continue
            if len(x) < n:
                if any(w[s : s + len(x)] == x for s in range(len(w))):
                    out[str(d), i] = 1.0
                continue
            want, own = Counter(grams(x)), grams(w)
            for s in range(max(0, len(w) - len(x)) + 1):
                have = Counter(own[s : s + len(x) - n + 1])
                both, all_ = sum((want & have).values()), sum((want | have).values())
                if both and 100 * both >= percent * all_:
                    out[str(d), i] = max(out.get((str(d), i), 0.0), both / all_)
    return out


@pytest.fixture(scope="module")
def bench(spark):
    rng = random.Random(8)
    items = [(i, " ".join(prose(rng, rng.randint(15, 60), 3000))) for i in range(20)] + [(50, None), (51, ""), (52, "tiny item"), (53, "again and again " * 12), (54, "a b c d e")]
    return spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit("clash"))


def test_decontamination(spark, docs, bench, monkeypatch):
    rng = random.Random(6)
    items = [(r.item_id, r.text) for r in bench.collect()]
    planted = []
    for i, t in items:
        w = (t or "").split()
        for k in range(4):
            own = list(w)
            for _ in range(k if len(own) > 20 else 0):
                at = rng.randrange(len(own))
                own[at : at + rng.randint(0, 1)] = ["zz"] * rng.randint(0, 1)
            planted.append((5000 + 10 * i + k, " ".join(prose(rng, rng.randint(0, 30), 3000) + own + prose(rng, rng.randint(0, 30), 3000)), "en", "p"))
    everything = docs.select(*SCHEMA.replace(",", "").split()[::2]).union(spark.createDataFrame(planted, SCHEMA))
    rows = {(r.doc_id, r.text) for r in everything.collect()}
    want = plain_matches(rows, items, 5, 80)
    found = decontaminate.matches(everything, bench)
    got = {(str(r.doc_id), r.item_id): r.similarity for r in found.collect()}
    assert len(want) > 45 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    monkeypatch.setattr(decontaminate, "BROADCAST_GRAMS", 1)
    monkeypatch.setattr(decontaminate, "BROADCAST_DOCS", 1)
    clean = decontaminate.keep_untouched(everything, bench)
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r.doc_id) for r in everything.collect() if str(r.doc_id) not in {d for d, _ in want})
    assert decontaminate.matches(everything.limit(0), bench).collect() == [] and decontaminate.matches(everything, bench.limit(0)).collect() == []


def test_decontamination_finds_reordered_items(spark):
    rng = random.Random(12)
    items = [(i, " ".join(prose(rng, size, 9000))) for i, size in enumerate([60, 80, 57, 40, 60])]
    rows = []
    for i, t in items:
        w = t.split()
        for k, cut in enumerate((len(w) // 2, len(w) // 3, len(w) - 9)):
            moved = w[cut:] + w[:cut]
            for j, (before, after) in enumerate(((100, 100), (0, 7), (3, 0), (0, 0))):
                rows.append((100 * i + 10 * k + j, " ".join(prose(rng, before, 9000) + moved + prose(rng, after, 9000))))
        rows.append((100 * i + 90, " ".join(w[: len(w) // 2] + prose(rng, 40, 9000) + w[len(w) // 2 :])))  # its parts are apart
        rows.append((100 * i + 91, " ".join(prose(rng, 4, 9000) + w[2:-3])))
        rows.append((100 * i + 92, " ".join(w[: len(w) * 9 // 10])))
    want = plain_matches(rows, items, 5, 80)
    found = decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(str(r.doc_id), r.item_id): r.similarity for r in found.collect()}
    assert len(want) > 30 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_starts_are_all_that_can_match(spark):
    rng = random.Random(13)
    rows = []
    for i in range(60):
        words, size = rng.randint(5, 30), rng.randint(5, 120)
        share = rng.choice([0.5, 0.9, 1.0])
        rows.append((i, words, size, [p for p in range(size - 4) if rng.random() < share]))
    df = spark.createDataFrame([r for r in rows if r[3]], "i int, words int, size int, places array<int>")
    for r in df.select("*", decontaminate.starts(5, 80).alias("s")).collect():
        m = r.words - 4
        want = [0] if r.size < r.words else [s for s in range(r.size) if 180 * sum(s <= p < s + m for p in r.places) >= 160 * m]
        assert r.s == want


def test_hamming_blocks_find_all_within_radius(spark):
    rng = random.Random(1)
    a = rng.getrandbits(63)
    rows = []
    for i in range(200):
        b = a
        for bit in rng.sample(range(63), rng.randint(0, 40)):
            b ^= 1 << bit
        rows.append((i, b))
    df = spark.createDataFrame(rows, "i long, f long").withColumn("b", F.explode(decontaminate.blocks(F.col("f"))))
    q = spark.createDataFrame([(a,)], "q long").withColumn("b", F.explode(decontaminate.near_blocks(F.col("q"), 20)))
    near = df.join(q, "b").filter(F.bit_count(F.col("f").bitwiseXOR(F.col("q"))) <= 20)
    assert {r.i for r in near.collect()} == {i for i, b in rows if (a ^ b).bit_count() <= 20}
    assert q.count() == sum(sum(math.comb(w, k) for k in range(4)) for w in (10, 11, 11, 10, 11, 11))


def test_simhash_is_the_majority_of_bits(spark):
    rng = random.Random(3)
    rows = [(i, [rng.getrandbits(64) - (1 << 63) for _ in range(n)]) for i, n in enumerate([1, 2, 3, 10, 61, 500])] + [(9, [-1, -1, 7])]
    rows.append((10, [5, 9] * 17_000 + [9]))  # more than a lane holds
    for r in spark.createDataFrame(rows, "i int, g array<long>").select("g", decontaminate.simhash(F.col("g")).alias("s")).collect():
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in r.g) > len(r.g))
        assert r.s == (want - (1 << 64) if want >= 1 << 63 else want)


def test_candidate_pairs_come_from_fingerprints_and_are_few(spark):
    """Pairs of random windows and items pass the radius with chance 0.002; blocks find the same pairs as all against all."""
    rng = random.Random(5)
    found = spark.createDataFrame([(i, 0, 50, i, rng.getrandbits(64) - (1 << 63)) for i in range(1500)], "doc_id long, row long, words int, start int, print long")
    prints = spark.createDataFrame([(i, 50, rng.getrandbits(64) - (1 << 63)) for i in range(40)], "item_id long, words int, iprint long")
    got = {(r.doc_id, r.item_id) for r in decontaminate.candidates(found, prints, 20).collect()}
    plain = {(w.doc_id, p.item_id) for w, p in itertools.product(found.collect(), prints.collect()) if ((w["print"] ^ p.iprint) & ((1 << 64) - 1)).bit_count() <= 20}
    assert got == plain and 0 < len(got) < 0.01 * 1500 * 40


def test_pipeline(spark, docs, bench, tmp_path):
    d = str(tmp_path)
    rng = random.Random(11)
    base = docs.select("doc_id", "text", "lang", "source").filter("doc_id is not null and source is distinct from 'again'").withColumn("n_chars", F.length("text").cast("long"))
    toxic = [(7000 + i, " ".join(prose(rng, 40, 3000) + ["vilex"] * 2), "en", "t", 0) for i in range(40)]
    leak = [(8000 + r.item_id, f"{r.text} " + " ".join(prose(rng, 30, 3000)), "en", "p", 0) for r in bench.filter("item_id < 10").collect()]
    table = base.union(spark.createDataFrame(toxic + leak, base.schema))
    table.write.parquet(f"{d}/documents.parquet")
    bench.select("item_id", "text").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(7000 + i, 1, 1) for i in range(30)] + [(i, 1, 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "decontamination", "mixing", "token_ids"]
    now = spark.read.parquet(f"{d}/documents.parquet")
    steps = [now]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, d)
        if name != "token_ids":
            assert out.columns == now.columns
            out.write.parquet(f"{d}/{name}")
            out = spark.read.parquet(f"{d}/{name}")
        steps.append(out)
        now = out
    ids = [sorted(r.doc_id for r in s.collect()) for s in steps]
    assert ids[1] == [i for i in ids[0] if not 7000 <= i < 8000]
    comp = plain_components([(r.doc_id, r.text) for r in steps[1].collect()], 5, 80)
    assert ids[2] == sorted(int(x) for x, _, c in comp if x == c)
    hits = {int(k[0]) for k in plain_matches([(r.doc_id, r.text) for r in steps[2].collect()], [(r.item_id, r.text) for r in bench.collect()], 5, 80)}
    assert hits >= {i for i in ids[2] if i >= 8000} and ids[3] == [i for i in ids[2] if i not in hits]
    times = Counter(ids[4])
    assert times.keys() <= set(ids[3]) and max(times.values()) <= 3 and ids[5] == ids[4]
    assert sorted(map(tuple, corpus_pipeline.run(spark, d).collect())) == sorted(map(tuple, steps[5].collect()))
