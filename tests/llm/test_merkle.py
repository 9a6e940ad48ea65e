import hashlib
import zlib

import duckdb
import pytest

from varistrata.llm import merkle

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def proofs_of(nodes):
    """root, and for each node its siblings height by height, as (before, after)."""
    proofs, at, under = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(under) > 1:
        for i, k in enumerate(at):
            run = under[k - k % 3 : k - k % 3 + 3]
            proofs[i].append(("".join(run[: k % 3]), "".join(run[k % 3 + 1 :])))
            at[i] = k // 3
        under = [h(*under[i : i + 3]) for i in range(0, len(under), 3)]
    return under[0], proofs


def brute(rows):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of all rows, by lists."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r, told(r)))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = {s: proofs_of([leaf for _, leaf in by[s]]) for s in sources}
    root, upper = proofs_of([trees[s][0] for s in sources])
    out = []
    for s, above in zip(sources, upper, strict=True):
        for (r, leaf), own in zip(by[s], trees[s][1], strict=True):
            proof = own + above
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            folded = told([*r[:4], r[4].replace("\n", "")]) if hit else leaf
            for before, after in proof:
                folded = h(before, folded, after)
            out.append((r[0], leaf, trees[s][0], root, h(*[a + b for a, b in proof]), folded, folded == root))
    return sorted(out, key=str)


def result(docs, **options):
    from pyspark.sql import functions as F

    cut = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    changed = merkle.leaf(*[cut if f == "text" else F.col(f) for f in merkle.FIELDS])
    out = merkle.manifest(docs, payload={"changed": changed}, **options).withColumn("folded_root", merkle.folded(F.col("changed"), F.col("proof")))
    out = out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")), "folded_root", (F.col("folded_root") == F.col("root")))
    return sorted([tuple(r) for r in out.collect()], key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 80, 81, 82, 243, 300, 728, 729])
def test_traversal_gives_every_proof(n):
    leaves = [h(str(i)) for i in range(n)]
    root, proofs = proofs_of(leaves)
    assert merkle.block_root(leaves, merkle.height_of(n)) == root
    assert list(merkle.traverse(leaves, merkle.height_of(n))) == proofs


def test_short_blocks_of_large_sources_reach_the_block_height():
    leaves = [h(str(i)) for i in range(5)]
    want = h(h(*leaves[:3]), h(*leaves[3:]))
    for _ in range(4):
        want = h(want)
    assert merkle.block_root(leaves, 6) == want
    assert [len(p) for p in merkle.traverse(leaves, 6)] == [6] * 5


def test_traversal_holds_two_small_subtrees_a_layer(monkeypatch):
    """However many leaves there are, an existing and a desired subtree for each layer, of ARITY + ARITY ** 2 digests."""
    held = []
    step = merkle.Subtree.step
    monkeypatch.setattr(merkle.Subtree, "step", lambda self: (step(self), held.append(sum(map(len, self.kept)) + sum(map(len, self.runs)))))
    list(merkle.traverse([h(str(i)) for i in range(729)], 6))
    assert max(held) <= 3 + 9 + 2 * 6


def test_whole_table_equals_brute_force_and_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*merkle.FIELDS).collect()]
    got = sorted([tuple(r) for r in merkle.query(spark, SF).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()], key=str)
    assert got == brute(rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(con.sql(merkle.ORACLE).fetchall(), key=str) == got
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_a_source_of_many_blocks_and_rounds(spark, monkeypatch):
    """Blocks of 9: a hot source of 700 rows takes three rounds; many small sources take rounds of their own."""
    rows = [(i, "hot", "en", i, f"text\n{i}") for i in range(700)] + [(1000 + i, f"s{i % 40}", None, None, "é\n" * (i % 3)) for i in range(130)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert result(docs, block_height=2) == brute(rows)
    monkeypatch.setattr(merkle, "BROADCAST_PARTS", 0)
    assert result(docs, block_height=2) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, None, "", 0, ""), (2, "", "en", 5, "a\nb"), (2, "", "en", 5, "a\nb"), (2, "", "en", 5, "a\n\nb"), (3, "s", "en", None, "\n"), (4, "n", None, 4, "x" * 300_000 + "\n"), (-5, "é", None, 4, "Ü")]
    docs = spark.createDataFrame([(*r, 7, "g", "z", None) for r in rows], SCHEMA + ", _tag int, _place string, leaf string, _digest string")
    assert result(docs) == brute(rows)
    assert result(docs.limit(0)) == []
    assert result(docs.where("doc_id = 3")) == brute(rows[6:7])
