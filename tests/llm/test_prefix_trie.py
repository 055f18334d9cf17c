"""The conversation trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from prosodia.llm import prefix_trie
from prosodia.llm.queries import op12_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, up int, one double, a int"


def own_turns(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is None:
            continue
        role, text = role or "", text or ""
        by[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    return {c: [x[3:] for x in sorted(v)] for c, v in by.items()}


def plain(rows):
    own = own_turns(rows)
    built = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])
        built[c] = base[:h] + mine[h:]
    nodes = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(path))))
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p)
        children = sum(len(p) == len(path) + 1 for p in below)
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df, path, spark):
    df.write.parquet(f"{path}/conversations.parquet")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in op12_prefix_trie(spark, str(path)).select(columns).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for c in [*range(60), 100, *range(103, 140), 250, 251, 399, -5, -101]:  # 200 and 300 are absent
        out += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "ünï", "four"])) for t in range(rng.randint(1, 9))]
    for c in range(400, 440):  # one hot start, and copies of one conversation
        out += [(c, t, "user", f"same {t}") for t in range(7)] + ([(c, 7, "user", str(c))] if c % 3 else [])
    out += [(500, t, "user", "x" * (t % 3)) for t in range(70)]  # long
    out += [(600, None, None, None), (600, None, "user", "z"), (600, 1, "", ""), (600, 1, "user", "tie"), (600, 1, "user", "tie"), (600, 0, None, "n")]
    out += [(None, 0, "user", "nobody"), (None, None, None, None)]
    rng.shuffle(out)
    return out


def test_same_as_a_dictionary_of_prefixes(spark, rows, tmp_path):
    df = spark.createDataFrame([(*r, "clash", 1, 2.0, 3) for r in rows], SCHEMA)
    want = plain(rows)
    assert result(df, tmp_path / "x", spark) == want
    assert result(df.repartition(9, "text"), tmp_path / "y", spark) == want


def test_turnless_and_empty(spark, tmp_path):
    few = [c for c in range(1, 200) if zlib.crc32(str(c).encode()) % 6 >= 2 and c % 100][:5]
    rows = [(c, 0, "user", "only") for c in few]
    df = spark.createDataFrame([(*r, "clash", 1, 2.0, 3) for r in rows], SCHEMA)
    got = result(df, tmp_path / "x", spark)
    assert got == plain(rows) and len(got) == 1 and got[0][3] == 5 and got[0][5] == 1
    assert result(df.limit(0), tmp_path / "y", spark) == []
    assert result(df.filter("false").unionByName(df.withColumn("conv_id", F.lit(None).cast("long"))), tmp_path / "z", spark) == []


def test_ends_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 1)
    rows = [(d, 7, k, c) for d, k, n in ((0, 1, 900), (2, 5, 3)) for c in range(n)]
    df = spark.createDataFrame(rows, "depth long, k1 long, k2 long, conv_id long").repartition(5)
    got = {r.depth: r.ends for r in prefix_trie.end_digests(df).collect()}
    assert got == {d: hashlib.sha256(",".join(map(str, range(n))).encode()).hexdigest() for d, n in ((0, 900), (2, 3))}
