import random

import numpy as np
import pytest
from pyspark.sql import types as T

from varistrata.llm import neardup as N
from varistrata.llm.common import table


def brute(rows, k, percent):
    """(doc_id, n, component) by comparing all pairs that share a shingle."""
    import re

    sets = {}
    for d, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[d] = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}) if w else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets, key=lambda d: len(sets[d]))
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if not sets[a] or 100 * len(sets[a]) < percent * len(sets[b]):
                break
            c = len(sets[a] & sets[b])
            if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {(d, len(s), root(d)) for d, s in sets.items()}


def made(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(40)]
    out = []
    while len(out) < n:
        words = [word() for _ in range(rng.choice([1, 2, 3, 5, 40, 150]))] + passage * (rng.random() < 0.3)
        for _ in range(rng.choice([1, 1, 1, 2, 6, 20])):
            copy = list(words)
            for _ in range(rng.randrange(0, max(2, len(copy) // 14))):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    return [(i * 7 % 1009 + 1, t) for i, t in enumerate(out[:n])]


def test_estimate_is_near():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, size=2000, dtype=np.uint64) * np.uint64(2)
    for shared, own in ((800, 100), (500, 250), (100, 450)):
        a, b = np.unique(pool[: shared + own]), np.unique(np.r_[pool[:shared], pool[shared + own : shared + 2 * own]])
        r = N.registers([a, b])
        got = N.estimate(r[:1], r[1:], np.array([len(a)]), np.array([len(b)]))[0]
        assert got == pytest.approx(shared / (shared + 2 * own), abs=0.13)
        both = N.registers([np.union1d(a, b)])
        assert np.array_equal(both[0], r.max(axis=0))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = made(seed, 600)
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 4, 80).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows, 4, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_odd_rows(spark):
    schema = T.StructType().add("doc_id", "long").add("text", "string").add("component", "string")
    rows = [(5, "A b C d e", ""), (3, "a B c D E", ""), (3, "a B c D E", ""), (7, None, ""), (8, "", ""), (9, " \n ", ""), (None, "a b c d e", ""), (10, "x", ""), (2, "x", ""), (11, "w " * 50_000, "")]
    docs = spark.createDataFrame(rows, schema)
    got = sorted(map(tuple, N.near_duplicates(docs, 4, 80).collect()), key=str)
    want = [(5, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (None, 2, None, True), (10, 1, 2, False), (2, 1, 2, True), (11, 1, 11, True)]
    assert got == sorted(want, key=str)
    assert sorted(r.doc_id or 0 for r in N.drop_near_duplicates(docs, 4, 80).collect()) == [0, 2, 3, 3, 7, 8, 9, 11]
    assert N.near_duplicates(docs.limit(0)).count() == 0


def test_one_large_group_of_copies(spark):
    """Copies changed a little to a lot: a large component and many documents near it that have no link."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(420):
        copy = list(base)
        for _ in range(rng.randrange(0, 9)):
            copy[rng.randrange(len(copy))] = word()
        rows.append((i, " ".join(copy)))
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), 4, 80).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows, 4, 80)
    assert sum(r.kept for r in got) > 5


def test_whole_table_equals_sql_and_brute_force(spark):
    import duckdb

    from varistrata.llm import oracles

    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = con.sql(oracles.NEAR_DUPLICATES)
    got = N.query(spark, "/root/testdata/sf0.01").select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute([tuple(r) for r in docs], 4, 80)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_rows_that_share_a_key(spark, kind):
    """Rows of one key with two texts are two documents; keys may be strings."""
    words = [f"w{i}" for i in range(60)]
    t1, t2 = " ".join(words[:30]), " ".join(words[30:])
    rows = [(1, t1), (1, t2), (2, t2 + " zz"), (3, t1 + " yy"), (4, t2 + " zz"), (5, "on its own here now")]
    own = (lambda d: d) if kind == "long" else (lambda d: f"k{d}")
    docs = spark.createDataFrame([(own(d), t) for d, t in rows], f"doc_id {kind}, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(docs, 4, 80).collect())
    assert got == sorted([(own(1), 27, own(1), True), (own(1), 27, own(1), True), (own(2), 28, own(1), False), (own(3), 28, own(1), False), (own(4), 28, own(1), False), (own(5), 2, own(5), True)])
    if kind == "string":
        return
    assert sorted(map(tuple, N.drop_near_duplicates(docs, 4, 80).collect())) == sorted([(own(1), t1), (own(1), t2), (own(5), rows[5][1])])
    twice = spark.createDataFrame([(2, t1), (1, t2), (1, t1), (1, t1), (3, t2 + " q")], "doc_id long, text string")
    assert sorted(map(tuple, N.drop_near_duplicates(twice, 4, 80).collect())) == sorted([(1, t1), (1, t1), (1, t2)])


def test_very_long_texts(spark):
    rng = random.Random(3)
    base = [str(rng.randrange(10**6)) for _ in range(60_000)]
    near, far = list(base), list(base)
    for at in range(0, 60_000, 60):
        near[at] = "x"
    for at in range(0, 60_000, 20):
        far[at] = "y"
    rows = [(i, " ".join(t)) for i, t in enumerate([near, base, far, base[:20_000], base[:19_900], near[:50_000]])]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows, 4, 80)


def test_copies_that_stay_apart_are_not_compared(spark):
    """Copies changed so far that no two have a link: the filters leave no block of them, however many they are."""
    rng = random.Random(12)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(600):
        copy = list(base)
        for at in rng.sample(range(120), 7):
            copy[at] = " ".join(f"n{i}x{at}y{k}" for k in range(rng.randrange(1, 4)))
        rows.append((i, " ".join(copy)))
    rows.append((600, " ".join(base)))
    assert {c for _, _, c in brute(rows, 4, 80)} == set(range(601))
    seen = []
    real = N.block_pairs
    try:
        N.block_pairs = lambda members, *a: seen.append(members.count()) or real(members, *a)
        got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), 4, 80).collect()
    finally:
        N.block_pairs = real
    assert {r.component_id for r in got} == set(range(601)) and seen == [0]


def test_checkpoints_are_deleted(spark, tmp_path):
    import os

    context = spark.sparkContext
    before = context.getCheckpointDir()
    context.setCheckpointDir(str(tmp_path))
    try:
        docs = spark.createDataFrame(made(4, 80), "doc_id long, text string")
        out = N.near_duplicates(docs, 4, 80)
        assert sum(len(d) for d in (os.listdir(f"{tmp_path}/{x}") for x in os.listdir(tmp_path))) == 2 and out.count() == 80
    finally:
        context.setCheckpointDir(before or "/tmp/varistrata-tests")


def test_names_of_the_operator_are_free(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(1, text, 0, 0, "a", "b"), (2, text, 1, 2, "c", "d"), (3, "else", None, None, None, None)], "doc_id long, text string, _gone long, _gone_th long, _key string, _doc string")
    got = N.drop_near_duplicates(docs, 4, 80)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [(1, text, 0, 0, "a", "b"), (3, "else", None, None, None, None)]
