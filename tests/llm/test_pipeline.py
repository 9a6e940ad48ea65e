from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from varistrata.llm import decontam, neardup, sharding, toxicity
from varistrata.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def net(spark):
    """Trained once; the stage that trains it is given this one."""
    made = toxicity.model(spark, SF)
    kept = toxicity.model
    toxicity.model = lambda *a: made
    yield made
    toxicity.model = kept


def test_stages_keep_what_they_should(spark, net):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {d for d, s in zip(rows, toxicity.Scorer(net).scores([r.text for r in rows.values()]), strict=True) if s < toxicity.THRESHOLD}
    first = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == kept and kept < set(rows)
    from tests.llm.test_neardup import brute

    alone = {d for d, _, c in brute([(d, rows[d].text) for d in kept], neardup.WORDS_IN_SHINGLE, neardup.PERCENT) if d == c}
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "shard", "grown_shard"]
    got = Counter(r.doc_id for r in out.collect())
    bad = {r.doc_id for r in decontam.contaminated(docs, table(spark, SF, "benchmark")).collect()}
    assert set(got) == alone - bad and set(got.values()) <= {1, 2}
    assert {r.shard for r in out.collect()} <= set(range(sharding.SHARDS))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, grown_shard string, copies string"


def odd(spark):
    """Null, empty and repeated rows, and columns with names that stages use."""
    plain = "the old mill by the river has been sold to a man who wants to make paper there"
    rows = [(1, None, None, None, None, 7, "g", "c"), (2, "", "en", "s", 0, 7, "g", "c"), (None, None, None, None, None, None, None, None), (None, plain + " a", "en", "s", 5, 1, "g", "c"), (3, plain, "en", "s", 5, 1, "g", "c"), (3, plain, "en", "s", 5, 1, "g", "c"), (4, plain, "en", "s", 5, 2, "h", "d"), (5, "word " * 30_000, "en", None, 9, 3, "i", "e")]
    return spark.createDataFrame(rows, SCHEMA)


def test_every_stage_takes_odd_rows(spark, net):
    docs = odd(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "sharding":
            assert sorted(out.columns) == sorted(docs.columns) and {r.shard for r in out.collect()} <= set(range(24))
        else:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        got = Counter((r.doc_id, r.text) for r in out.collect())
        want = Counter((r.doc_id, r.text) for r in docs.collect())
        if name == "toxicity":
            bad = {(r.doc_id, docs.where(F.col("doc_id") == r.doc_id).first().text) for r in toxicity.score(docs, net).where("predicted = 1").collect()}
            want = Counter({k: n for k, n in want.items() if k not in bad})
            assert all(want[k] for k in [(1, None), (2, ""), (None, None)])
        if name == "near_dedup":
            del want[4, docs.where("doc_id = 4").first().text]
        if name == "mixing":
            assert set(got) == set(want) and all(want[k] <= n <= 3 * want[k] for k, n in got.items())
        else:
            assert got == want, name
        assert stage(spark, docs.limit(0), SF).count() == 0
