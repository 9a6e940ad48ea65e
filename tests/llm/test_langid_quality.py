import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varistrata.llm import langid, quality
from varistrata.llm.common import fold, table

SF = "/root/testdata/sf0.01"


def plain_vectors():
    """Language vectors by loops: text to vector."""
    import re

    known = {}

    def letter(c):
        if c not in known:
            known[c] = np.random.default_rng([langid.SEED, ord(c) if c != " " else 0]).integers(0, 2, langid.DIMENSIONS, dtype=np.int8).astype(int) * 2 - 1
        return known[c]

    bound = {}

    def vector(text):
        low = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        runs = " " + re.sub(" +", " ", low).strip() + " "
        out = np.zeros(langid.DIMENSIONS)
        for i in range(len(runs) - 2):
            gram = runs[i : i + 3]
            if gram not in bound:
                bound[gram] = np.roll(letter(gram[0]), 2) * np.roll(letter(gram[1]), 1) * letter(gram[2])
            out += bound[gram]
        return out if runs.strip() else np.zeros(langid.DIMENSIONS)

    return vector


def test_bundle_is_the_plain_sum():
    vector = plain_vectors()
    for text in ("Abba, 1 ébc", "東京 大阪東京", "привет, мир", "a"):
        assert np.array_equal(langid.bundle(langid.trigrams(text)), vector(text))
    assert len(langid.trigrams("Abba, 1 ébc")) == 8
    # Letters of other scripts have vectors of their own.
    assert abs(langid.bundle(langid.trigrams("東京")) @ langid.bundle(langid.trigrams("大阪"))) < 400


def test_languages_of_the_whole_table_by_brute_force(spark):
    docs = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    held = {r.doc_id for r in table(spark, SF, "documents").where(fold("doc_id", 5) == 0).collect()}
    vector = plain_vectors()
    own = {d: vector(r.text) for d, r in docs.items()}
    names = sorted({r.lang for r in docs.values() if r.lang is not None})
    sums = {n: sum((own[d] for d, r in docs.items() if r.lang == n and d not in held), np.zeros(langid.DIMENSIONS)) for n in names}
    unit = {n: v / np.linalg.norm(v) for n, v in sums.items() if v.any()}
    got = langid.query(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        v = own[r.doc_id]
        cosines = {n: v @ u / np.linalg.norm(v) for n, u in unit.items()} if v.any() else {"und": 0.0}
        best = max(cosines.values())
        assert r.held_out == (r.doc_id in held) and r.score == pytest.approx(max(0.0, best), abs=1e-9) and cosines[r.lang_pred] == pytest.approx(best, abs=1e-9)


def test_language_rows(spark):
    schema = T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("score", "string")
    rows = [(1, "the cat and the dog", "en", ""), (2, "der hund und die katze", "de", ""), (3, None, "en", ""), (4, "123 !!", None, ""), (5, "", "de", ""), (None, "und der hund", None, ""), (1, "the cat and the dog", "en", ""), (6, "the dog " * 20_000, None, "")]
    docs = spark.createDataFrame(rows, schema)
    got = sorted(map(tuple, langid.predict(docs, langid.fit(docs)).select("doc_id", "lang_pred").collect()), key=str)
    assert got == sorted([(1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (None, "de"), (6, "en")], key=str)
    assert langid.fit(docs.limit(0)) == {} and {r.lang_pred for r in langid.predict(docs, {}).collect()} == {"und"}


def test_held_out_languages(spark):
    got = langid.query(spark, SF).where("held_out").join(table(spark, SF, "documents"), "doc_id")
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_calibration_fits_shares():
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(-1, 1, 4000), rng.normal(1, 1, 4000)]
    y = np.r_[np.zeros(4000, int), np.ones(4000, int)]
    slope, offset = quality.calibrate(x, y, np.ones(8000))
    assert slope == pytest.approx(2, abs=0.15) and offset == pytest.approx(0, abs=0.1)


def test_quality_rows(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(6))
    good = [" ".join(word() for _ in range(60)) for _ in range(60)]
    bad = [" ".join(word().upper() + "!!" for _ in range(60)) for _ in range(60)]
    schema = T.StructType().add("doc_id", "long").add("text", "string").add("score", "string")
    docs = spark.createDataFrame([(i, t, "") for i, t in enumerate(good + bad)] + [(500, None, ""), (500, None, ""), (501, "", ""), (None, bad[0] * 300, "")], schema)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(900, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert np.mean([got[i].predicted == (i < 60) for i in range(120)]) > 0.97
    assert got[None].predicted == 0 and got[500].score == got[501].score == pytest.approx(model.probability(0))
    none = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}


def test_quality_of_the_whole_table_by_brute_force(spark):
    """The rule written plainly: two dictionaries, blocks, a logistic curve, on labelled rows alone."""
    import math

    import zstandard

    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality.fit(docs, labels.where(fold("doc_id", 3) != 1))
    kinds = [zstandard.ZstdCompressionDict(c) for c in (model.good, model.bad)]

    def size(block, known):
        return len(zstandard.ZstdCompressor(level=3, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False).compress(block))

    held = {r.doc_id for r in docs.where(fold("doc_id", 3) == 1).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    got = quality.query(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = texts[r.doc_id]
        saved = sum(size(raw[i : i + 1024], kinds[1]) - size(raw[i : i + 1024], kinds[0]) for i in range(0, len(raw), 1024)) / max(1, len(raw))
        want = 1 / (1 + math.exp(-(model.slope * saved + model.offset)))
        assert r.held_out == (r.doc_id in held) and r.score == pytest.approx(want, abs=1e-12) and r.predicted == int(want >= 0.5)


def test_fitted_rows_are_bounded_by_whole_texts(spark):
    from varistrata.llm.common import labelled_texts

    docs = spark.createDataFrame([(i, "x" * (10 * i)) for i in range(1, 11)] + [(11, None), (12, "y" * 500)], "doc_id long, text string")
    ids = docs.select("doc_id").withColumn("_y", (F.col("doc_id") % 2).cast("int"))
    got = labelled_texts(docs, ids, "_y", 120).collect()
    for k in (0, 1):
        own = [r for r in got if r._y == k]
        assert 0 < sum(len(r.text or "") for r in own) <= 120
    assert 12 not in {r.doc_id for r in got} and all(r.text is None or len(r.text) == 10 * r.doc_id for r in got)
    assert quality._dictionary([b"abc", b"de"]) in (b"abcde", b"deabc")


def test_quality_of_an_empty_table(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0


def test_held_out_quality(spark):
    got = quality.query(spark, SF).where("held_out").join(table(spark, SF, "labels"), "doc_id").toPandas()
    assert (got.predicted == got.quality).mean() > 0.93
    assert fold("doc_id", 3) is not None
