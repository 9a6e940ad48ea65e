import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varistrata.llm import mixing, sharding

SCHEMA = T.StructType().add("doc_id", "long").add("text", "string").add("source", "string").add("copies", "string").add("shard", "string")


def corpus(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "w " * int(rng.integers(1, 60)), "big" if i % 3 else f"small{i % 7}", "x", "y") for i in range(3000)]
    rows += [(9000, None, None, "x", "y"), (9001, "", None, "x", "y"), (9002, "a b c", None, "x", "y"), (None, "k l", "small1", "x", "y"), (None, None, None, None, None)]
    rows += [(42, "w w", "big", "x", "y")] * 3 + [(9100, "w " * 20_000, "long", "x", "y"), (9200, "", "empty", "x", "y")]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_bisection():
    tokens = [1000, 100, 10, 0]
    e = mixing.bisect_exponent(tokens, repeat_limit=3)
    w = mixing.weights(tokens, e)
    assert mixing.repetition(tokens, w, None) == pytest.approx(3, abs=1e-6) and w[3] == 0 and w.sum() == pytest.approx(1)
    h = mixing.bisect_exponent(tokens, target_entropy=0.8)
    assert mixing.entropy(mixing.weights(tokens, h)) == pytest.approx(0.8, abs=1e-6)
    assert mixing.bisect_exponent(tokens, target_entropy=5) == 0 and mixing.bisect_exponent([5], repeat_limit=1) == 0
    assert mixing.bisect_exponent(tokens, repeat_limit=0.5) == 1
    with pytest.raises(ValueError):
        mixing.bisect_exponent(tokens)


def test_mixture_meets_its_budgets(spark):
    rows, docs = corpus(spark)
    for args in ({}, {"budget": 30_000.0, "repeat_limit": 4.0}, {"target_entropy": 1.2, "budget": 90_000.0}):
        mixture = mixing.fit(docs, **args)
        got = mixing.with_copies(docs, mixture).collect()
        assert len(got) == len(rows)
        sums, used, most = defaultdict(int), defaultdict(int), defaultdict(int)
        for r in got:
            n = len((r.text or "").split())
            sums[r.source] += n
            used[r.source] += n * r.copies
            most[r.source] = max(most[r.source], n)
        for tag, n, w, *_ in mixture.frame.collect():
            s = tag[1:] if tag[0] == "s" else None
            assert sums[s] == n and abs(used[s] - w * mixture.budget) <= most[s] + 8
        if not args:
            assert min(r.copies for r in got) >= 1 and max(r.copies for r in got) <= 3
        mixed = mixing.mix(docs, mixture)
        assert mixed.columns == docs.columns
        want = Counter()
        for r in got:
            want[r.doc_id, r.text] += r.copies
        assert Counter((r.doc_id, r.text) for r in mixed.collect()) == +want
    assert mixing.mix(docs.limit(0), mixing.fit(docs.limit(0))).count() == 0


@pytest.mark.parametrize("args", [{}, {"target_entropy": 1.2, "budget": 90_000.0}, {"budget": 30_000.0}])
def test_blocks_keep_budget_and_order(spark, args):
    """Blocks against loops over the uses: whole numbers of tokens, weights in every block, an order within each."""
    rows, docs = corpus(spark)
    mixture = mixing.fit(docs, **args)
    counted = Counter((r.doc_id, r.source, r.copies) for r in mixing.with_copies(docs, mixture).collect())
    uses = mixing.blocks(docs, mixture, block_tokens=5000).collect()
    want = Counter()
    for (d, s, n), times in counted.items():
        for u in range(1, n + 1):
            want[d, s, n, u] += times
    assert Counter((r.doc_id, r.source, r.copies, r.use) for r in uses) == want
    last = max(1, int(np.ceil(mixture.budget / 5000)))
    by_block, by_source = defaultdict(list), defaultdict(list)
    for r in uses:
        by_block[r.block].append(r)
        by_source[r.source].append(r)
    assert set(by_block) <= set(range(last))
    assert all(sorted(r.place for r in b) == list(range(len(b))) for b in by_block.values())
    for own in by_source.values():
        w, most = own[0].weight, max(r.n_tokens for r in own)
        held = Counter()
        for r in own:
            held[r.block] += r.n_tokens
        if w:
            full = [held[b] for b in range(last - 1) if sum(held[c] for c in range(b + 1, last)) > 0]
            assert all(abs(h - w * 5000) <= 2 * most for h in full)
            # A use comes before all later ones of its source.
            for u in range(1, max(r.use for r in own)):
                assert max(r.block for r in own if r.use == u and r.n_tokens) <= min(r.block for r in own if r.use == u + 1 and r.n_tokens)
    big = [b for b in by_block.values() if len(b) > 100]
    orders = [[r.doc_id for r in sorted(b, key=lambda r: r.place)] for b in big]
    assert not args or big and all(o != sorted(o, key=lambda d: d or 0) for o in orders)


def test_mixed_rows_lie_in_the_order_of_blocks(spark, tmp_path):
    """Every run of rows from the first on has each source's weight of its tokens, but for a block's part and a document; stored rows and others alike."""
    rows, docs = corpus(spark)
    docs.write.parquet(str(tmp_path / "docs"))
    for given in (docs, spark.read.parquet(str(tmp_path / "docs"))):
        mixture = mixing.fit(given, target_entropy=1.2, budget=90_000.0)
        mixed = mixing.mix(given, mixture, block_tokens=2000)
        assert mixed.rdd.getNumPartitions() > 1
        mixed.write.parquet(str(tmp_path / "mixed"), mode="overwrite")
        files = sorted((tmp_path / "mixed").glob("*.parquet"))
        got = [r for f in files for r in spark.read.parquet(str(f)).collect()]
        want = Counter()
        for r in mixing.with_copies(given, mixture).collect():
            want[r.doc_id, r.text] += int(r.copies)
        assert Counter((r.doc_id, r.text) for r in got) == +want
        weight = {(t[1:] if t[0] == "s" else None): w for t, _, w, *_ in mixture.frame.collect()}
        n = [len((r.text or "").split()) for r in got]
        most = defaultdict(int)
        for r, k in zip(got, n, strict=True):
            most[r.source] = max(most[r.source], k)
        held, total, over = defaultdict(int), 0, sum(most.values())
        for r, k in zip(got, n, strict=True):
            held[r.source] += k
            total += k
            assert all(abs(held[s] - w * total) <= 2 * (w * 2000 + most[s]) + w * over for s, w in weight.items() if w)
        # A source's documents come in an order other than that of their keys, and all of them before one comes again.
        big = [r.doc_id for r in got if r.source == "big"]
        assert big != sorted(big)
        first = {}
        for i, d in enumerate(big):
            first.setdefault(d, i)
        assert weight["big"] * 90_000 < sum(len(r[1].split()) for r in rows if r[2] == "big") or max(first.values()) <= len(first) + 400


def test_names_of_the_operator_are_free(spark):
    names = ["_tag", "_place", "_epochs", "_weight", "_end0", "_end1", "_end2", "_doc", "_file", "_row", "_metadata", "_spot", "_cell", "_part", "block", "place", "use", "n_tokens", "a.b"]
    docs = spark.createDataFrame([(i, "w " * (i + 1), "s" if i % 2 else None, *[f"{c}{i}" for c in names]) for i in range(6)], ["doc_id", "text", "source", *names])
    mixture = mixing.fit(docs)
    counted = mixing.with_copies(docs, mixture)
    assert counted.columns == [*docs.columns, "weight", "copies"]
    assert sorted(tuple(r)[:-2] for r in counted.collect()) == sorted(map(tuple, docs.collect()))
    mixed = mixing.mix(docs, mixture)
    assert mixed.columns == docs.columns and {tuple(r) for r in mixed.collect()} == {tuple(r) for r in docs.collect()}


def test_many_sources_stay_distributed(spark, monkeypatch):
    _, docs = corpus(spark)
    for args in ({"budget": 30_000.0, "repeat_limit": 4.0}, {"target_entropy": 1.2, "budget": 90_000.0}):
        want = mixing.fit(docs, **args)
        copies = sorted(map(str, mixing.with_copies(docs, want).collect()))
        with monkeypatch.context() as m:
            m.setattr(mixing, "DRIVER_SOURCES", 0)
            got = mixing.fit(docs, **args)
            assert got.exponent == pytest.approx(want.exponent, abs=1e-9)
            assert [r[:2] + r[3:] for r in sorted(map(tuple, got.frame.collect()))] == [r[:2] + r[3:] for r in sorted(map(tuple, want.frame.collect()))]
            assert len(mixing.with_copies(docs, got).collect()) == len(copies) and mixing.blocks(docs, got).count() == mixing.blocks(docs, want).count()


def test_mixing_of_an_empty_table(spark):
    _, docs = corpus(spark)
    assert mixing.blocks(docs.limit(0), mixing.fit(docs.limit(0))).count() == 0


def test_null_keys_are_placed_by_their_text(spark):
    for kind in ("string", "int", "bigint"):
        docs = spark.createDataFrame([(None, f"text {i}") for i in range(300)] + [(None, None)], f"doc_id {kind}, text string")
        got = sharding.plan(docs)
        assert got.select("shard").distinct().count() > 20 and got.count() == 301
        again = sharding.with_shards(docs.unionByName(docs), [1.0] * 24).select("text", "shard").distinct()
        assert again.count() == 301


def test_shards_of_the_whole_table_by_brute_force(spark):
    import xxhash

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()

    def shard(key, n):
        best = []
        for s in range(n):
            h = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), seed=42)
            for v in (s, sharding.SEED):
                h = xxhash.xxh64_intdigest(v.to_bytes(4, "little", signed=True), seed=h)
            best.append((1 / -np.log(((h >> 12) + 0.5) / 2**52), s))
        return max(best)[1]

    got = {r.doc_id: r for r in sharding.query(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(docs)
    for d, t in docs:
        raw = (t or "").encode()
        assert (got[d]["size"], got[d].text_crc32, got[d].shard, got[d].grown_shard) == (len(raw) + 8, zlib.crc32(raw), shard(d, 24), shard(d, 25))
    for s in range(24):
        assert sorted(r.slot for r in got.values() if r.shard == s) == list(range(sum(r.shard == s for r in got.values())))


def test_shards_slots_and_growth(spark):
    rows, docs = corpus(spark)
    got = sharding.plan(docs).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    by = defaultdict(list)
    place = defaultdict(set)
    for r in got:
        by[r.shard].append(r.slot)
        if r.doc_id is not None:
            place[r.doc_id].add((r.shard, r.grown_shard))
        assert r.grown_shard in (r.shard, 24) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) == set(range(24))
    assert all(len(p) == 1 for p in place.values())
    assert sum(r.grown_shard == 24 for r in got) == pytest.approx(len(got) / 25, rel=0.5)
    assert max(map(len, by.values())) < 2 * len(got) / 24
    heavy = sharding.with_shards(docs, [1.0, 3.0], grown=None)
    assert heavy.where("shard = 1").count() == pytest.approx(0.75 * len(rows), rel=0.06) and "grown_shard" not in heavy.columns
    assert sharding.plan(docs.limit(0)).count() == 0


def test_scores_are_the_law(spark):
    import xxhash

    ids = list(range(200))
    got = {r.doc_id: r.shard for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", sharding.rendezvous(F.col("doc_id"), [1.0] * 24).alias("shard")).collect()}
    for i in ids:
        best = []
        for s in range(24):
            h = xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), seed=42)
            for v in (s, sharding.SEED):
                h = xxhash.xxh64_intdigest(v.to_bytes(4, "little", signed=True), seed=h)
            best.append((1 / -np.log(((h >> 12) + 0.5) / 2**52), s))
        assert got[i] == max(best)[1]
