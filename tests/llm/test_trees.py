"""Source mixture, conversation trie and Merkle manifest: plain Python, edge cases, layouts."""

import hashlib
import math
import os
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from curatrix.llm import manifest, mixture, prefixes
from curatrix.llm.common import crc_mod

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.exists(f"{SF}/documents.parquet"), reason="needs the supplied tables")
@pytest.mark.parametrize("name", ["op11_source_mix", "op12_conversation_trie", "op13_merkle_manifest"])
def test_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    ask = db.execute(__spark_entry__.oracle_sql()[name])
    cols = [x[0] for x in ask.description]
    want = ask.fetchall()
    got = __spark_entry__.queries()[name](spark, SF).select(*cols).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


# ---- mixture --------------------------------------------------------------------------------------


def plain_targets(sizes: list[int], weights=(5, 2, 1), most=3) -> list[float]:
    """The rule as it is said: share, stop at the bound, share the excess again."""
    total, out, full = sum(sizes), [0.0] * len(sizes), set()
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    while len(full) < len(sizes):
        left = total - sum(most * sizes[i] for i in full)
        out = [float(most * n) if i in full else left * w[i] / sum(w[j] for j in range(len(sizes)) if j not in full) for i, n in enumerate(sizes)]
        over = {i for i in range(len(sizes)) if i not in full and out[i] > most * sizes[i]}
        if not over:
            return out
        full |= over
    return [float(most * n) for n in sizes]


@pytest.mark.parametrize("sizes", [[1, 1, 1000, 50], [0, 7, 3], [10_000, 1, 2, 3, 4, 5], [5, 2, 1], [0, 0], [9]])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(f"s{i:02}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = [r.target for r in mixture.targets(rows).orderBy("place").collect()]
    assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(got, plain_targets(sizes)))


def test_apportioned_by_highest_quotients(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for g, (n, seats) in enumerate([(1, 7), (5, 3), (40, 1000), (40, 10), (3, 0), (17, 250)]):
        claims = [0, *rng.integers(1, 10, n).tolist()] if g % 2 else rng.integers(0, 100_000, n).tolist()
        won = [0] * len(claims)
        for _ in range(seats):
            best = max(range(len(claims)), key=lambda i: (claims[i] / (2 * won[i] + 1), -i))
            won[best] += 1
        rows += [(g, i, x, seats) for i, x in enumerate(claims)]
        want |= {(g, i): k for i, k in enumerate(won) if claims[i]}
    df = spark.createDataFrame(rows, "g int, i int, claim long, seats long")
    got = mixture.apportioned(df, F.col("seats"), "claim", ["g"], ["i"]).collect()
    assert {(r.g, r.i): r.quota for r in got} == want


MIXED = [(1, "one two three", "b", "x"), (1, "one two three", "b", "x"), (2, None, "a", "x"), (3, "", None, "y"), (None, "a null id", "a", "z"), (4, "word " * 5000, None, "l"), (5, "x y z\x0bw", "", "t"), (6, "lone", "é", "t")]


def test_mix_edge_cases(spark):
    df = spark.createDataFrame(MIXED, "doc_id long, text string, source string, target string").withColumn("quota", F.lit("clash"))
    got = mixture.mix(df, block=4, shard_words=500).collect()
    assert sorted((r.doc_id or 0, r.size) for r in got) == sorted((i or 0, len((t or "").replace(" ", "_").split())) for i, t, _, _ in MIXED)
    names = ["", "a", "b", "é", None]
    sizes = [sum(r.size for r in got if r.source == n) for n in names]
    want = dict(zip(names, plain_targets(sizes)))
    for n in names:
        of = [r for r in got if r.source == n]
        assert all(math.isclose(r.target, want[n], abs_tol=1e-9) and r.source_size == sum(x.size for x in of) and 0 <= r.taken <= 3 * r.size for r in of)
        assert abs(sum(r.taken for r in of) - want[n]) <= 4 + 2 * (want[n] > 500) * 12
    assert mixture.mix(df.where("false")).count() == 0
    assert mixture.mix(df.where("doc_id = 2")).select("taken", "target").collect() == [(0, 0.0)]


def test_mix_does_not_depend_on_layout(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7)).alias("source"), F.expr("repeat('w ', cast(1 + id * 37 % 190 as int))").alias("text"))
    one = sorted(map(tuple, mixture.mix(df.repartition(7), seed=5, shard_words=8_000).collect()))
    monkeypatch.setattr(mixture, "SENT_BYTES", -1)  # the way of a table of sources that is not small
    assert one == sorted(map(tuple, mixture.mix(df.coalesce(1).orderBy(F.col("doc_id").desc()), seed=5, shard_words=8_000).collect()))
    assert one != sorted(map(tuple, mixture.mix(df, seed=6, shard_words=8_000).collect()))
    for source in {r[1] for r in one}:
        of = [r for r in one if r[1] == source]
        assert abs(sum(r[5] for r in of) - of[0][4]) < 40


# ---- conversation trie ----------------------------------------------------------------------------


def plain_trie(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    told = {k: [x[2:] for x in sorted(v)] for k, v in by.items()}
    built = {k: tuple(told.get(k - k % 5, [])[: zlib.crc32(str(k).encode()) % 9] + t[zlib.crc32(str(k).encode()) % 9 :]) for k, t in told.items()}
    members, below = defaultdict(list), defaultdict(list)
    for k, t in built.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(k)
    for n in members:
        if n:
            below[n[:-1]].append(n)
    sums = {}
    for n in sorted(members, key=len, reverse=True):
        own = (len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0
        sums[n] = (sum(sums[x][0] for x in below[n]) or 1, own + sum(sums[x][1] for x in below[n]))
    ends = lambda n: hashlib.sha256(",".join(str(k) for k in sorted(members[n]) if len(built[k]) == len(n)).encode()).hexdigest()
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), len(below[n]), *sums[n], ends(n)) for n, m in members.items())


def told(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def talks():
    rng = np.random.default_rng(1)
    rows = [(int(k), int(i), "user" if i % 2 == 0 else "assistant", f"t{rng.integers(0, 3)}é" * int(rng.integers(0, 3))) for k in range(60) for i in range(int(rng.integers(1, 12)))]
    rows += [(100, None, None, None), (100, None, None, "first"), (100, 3, "user", None), (101, 1, "user", "x"), (101, 1, "user", "x"), (None, 1, "user", "no one"), (102, 5, "a", "long " * 20_000), (7_000_003, 0, "user", "far")]
    return rows


@pytest.mark.parametrize("bits", [64, 3])
def test_trie(spark, bits):
    """Against plain Python, also with fingerprints of three bits, in which nearly all collide."""
    df = spark.createDataFrame(talks(), "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash"))
    assert told(prefixes.trie(df.repartition(5), bits)) == plain_trie(talks())


def test_trie_of_little(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert prefixes.trie(spark.createDataFrame([], kind)).count() == 0
    alone = [(3, 0, "user", "lost to its family's first, which isn't there")]  # crc32("3") % 9 > 0, so no turn is left
    assert zlib.crc32(b"3") % 9 > 0 and told(prefixes.trie(spark.createDataFrame(alone, kind))) == plain_trie(alone)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 2**64 - 1)), min_size=1, max_size=40), st.integers(1, 39))
def test_scan(turns, cut):
    """The scan equals the rule, also where a batch ends within a conversation."""
    turns.sort(key=lambda x: x[0])
    convs, hashes = np.array([x[0] for x in turns]), np.array([x[1] for x in turns], np.uint64)
    want, at, fp, depth = [], None, 0, 0
    for k, h in turns:
        before = fp if k == at else 0
        depth = depth + 1 if k == at else 1
        at, fp = k, (before * prefixes.BASE + h) % 2**64
        want.append((depth, fp, before))
    got, state = [], (None, 0, 0)
    for a, z in ((0, cut), (cut, len(turns))):
        if a < min(z, len(turns)):
            d, f, u, state = prefixes.scan(convs[a:z], hashes[a:z], state)
            got += zip(d.tolist(), f.tolist(), u.tolist())
    assert got == want


# ---- Merkle manifest ------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def plain_tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def plain_proofs(rows):
    """doc_id, leaf, subroot, root, proof, folded root of rows (doc_id, source, lang, n_chars, text)."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for v in by.values():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
    trees = {s: plain_tree([plain_leaf(r) for r in by[s]]) for s in names}
    top = plain_tree([trees[s][-1][0] for s in names])
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            even = zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 2 == 0
            node, proof = plain_leaf((*r[:4], r[4].replace("\n", "") if even and r[4] is not None else r[4])), []
            for level, place in [(x, i // 3**n) for n, x in enumerate(trees[s][:-1])] + [(x, k // 3**n) for n, x in enumerate(top[:-1])]:
                a = place - place % 3
                left, right = level[a:place], level[place + 1 : a + 3]
                proof += left + right
                node = h(*left, node, *right)
            yield r[0], trees[s][0][i], trees[s][-1][0], top[-1][0], h(*proof), node


KIND = "doc_id long, source string, lang string, n_chars long, text string"


def proven(df):
    out = manifest.prove(df, {"text": F.replace(df["text"], F.lit("\n"), F.lit(""))}, crc_mod("doc_id", 2) == 0)
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in out.collect())


def plainly(rows):
    return sorted((str(i), a, b, c, d, e, e == c) for i, a, b, c, d, e in plain_proofs(rows))


def test_manifest(spark):
    """Sources of one row, of exact powers, of more than a step holds; ids far apart, negative, null and repeated; nulls, equal rows."""
    rows = [(i * 7919 - 40_000, "big", "en", i, f"a\nb {i}") for i in range(2300)] + [(i, "nine", None, None, "x\n" * (i % 2)) for i in range(9)]
    rows += [(2**62 + i, "far", "é", 1, "ü") for i in range(4)] + [(-(2**63), "far", None, 2, None), (5, None, None, None, None), (6, "", "en", 0, ""), (None, "nine", "x", 1, "\n"), (None, "nine", "x", 1, "\n"), (3, "nine", None, None, "x\n"), (7, "A", "en", 30_000, "long\n" * 6000)]
    df = spark.createDataFrame(rows, KIND).withColumn("tree", F.lit("clash")).withColumn("rank", F.lit(1))
    assert proven(df.repartition(3)) == plainly(rows)


@pytest.mark.parametrize("n", [0, 1, 3, 4])
def test_manifest_of_little(spark, n):
    rows = [(i, f"s{i}", "en", 1, "a\n") for i in range(n)]
    assert proven(spark.createDataFrame(rows, KIND)) == plainly(rows)


def test_ranked(spark):
    rng = np.random.default_rng(2)
    keys = [None, -(2**63), 2**63 - 1, 0, 0, -1, *rng.integers(-(2**63), 2**63 - 1, 40).tolist(), *range(5000, 14_000)]
    df = spark.createDataFrame([(("a", "b")[i % 5 == 0], k, f"{i:05}") for i, k in enumerate(keys)], "g string, k long, t string")
    got = manifest.ranked(df, "g", "k", "t").collect()
    for g in "ab":
        of = sorted((r for r in got if r.g == g), key=lambda r: (r.k is not None, r.k or 0, r.t))
        assert [r.rank for r in of] == list(range(len(of))) and {r.total for r in of} == {len(of)}
