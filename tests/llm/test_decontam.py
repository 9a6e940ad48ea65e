import duckdb
from pyspark.sql import types as T

from varistrata.llm import decontam

SF = "/root/testdata/sf0.01"
ITEM = "Each morning the baker Tom sells 12 loaves for 3.5 dollars, and then Tom gives 12 rolls away to the school."


def rows(spark, texts, items):
    schema = T.StructType().add("doc_id", "long").add("text", "string").add("windows", "string")
    docs = spark.createDataFrame([(i, t, "") for i, t in texts], schema)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return docs, {(r.doc_id, r.item_id): (r.windows, r.item_windows, r.reworded) for r in decontam.contaminated(docs, bench).collect()}, bench


def test_placeholders(spark):
    got = spark.createDataFrame([("He met Ann Lee Fox, 5 km off; 3.14 or 1,000,000 (no_2#=) End",)], "text string").select(decontam.canonical("text")).first()[0]
    assert got == "he met #a=ann #a=lee #a=fox #n=5 #u=km off #n=3_14 or #n=1_000_000 no #n=2 end"


def test_reworded_questions_and_slots(spark):
    other = ITEM.replace("Tom", "Ann").replace("12", "40").replace("3.5", "9")
    mixed = ITEM.replace("Tom", "Ann", 1)
    texts = [(1, "Well. " + ITEM + " Yes."), (2, other), (3, mixed), (4, None), (5, ""), (None, ITEM), (6, "nothing of the kind here at all, friends, only words"), (1, "Well. " + ITEM + " Yes."), (7, "x " * 30_000 + ITEM), (8, "so many small red birds sing"), (9, ITEM[:60])]
    docs, got, bench = rows(spark, texts, [ITEM, "many small red birds", "a b", None, ITEM])
    n = got[1, 0][0]
    assert {k for k in got if k[1] == 0} == {(1, 0), (2, 0), (3, 0), (None, 0), (7, 0)} and {k[0] for k in got if k[1] == 1} == {8}
    assert got[1, 0] == (n, n, False) or got[1, 0][2] is False
    assert got[2, 0][2] is True and got[7, 0][2] is False
    left = decontam.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {4, 5, 6, 9, None}
    assert decontam.contaminated(docs.limit(0), bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_equals_sql_also_if_shuffled(spark, monkeypatch):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(decontam.ORACLE)
    rows_ = sorted(want.fetchall())
    for most in (decontam.BROADCAST_WINDOWS, 0):
        monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", most)
        assert sorted(map(tuple, decontam.query(spark, SF).select(*want.columns).collect())) == rows_ and rows_


def test_items_with_few_or_no_literal_windows(spark):
    train = "A train covers 120 km in 2 hours and 90 km in 3 hours. What is its mean speed?"
    dense = "12 km 3 hours 40 dollars 7 kg"
    texts = [(1, "Look. " + train), (2, "Look. " + train.replace("120", "75").replace("3 hours", "4 hours")), (3, "All: " + dense + "."), (4, "All: " + dense.replace("40", "41")), (5, train[:40])]
    _, got, _ = rows(spark, texts, [train, dense])
    assert set(got) == {(1, 0), (2, 0), (3, 1)}
    assert not got[1, 0][2] and got[2, 0][2] and not got[3, 1][2]


def test_items_after_a_word_or_comma(spark):
    short, named = "What is the capital of France?", "Tom has 12 apples and sells most of them"
    texts = [(1, "Question: " + short), (2, "Quiz. " + short), (3, "so, " + short), (4, "we ask " + short), (5, "Then " + named), (6, "here " + named.replace("Tom", "Ann")), (7, "it takes 5 minutes to walk from the old mill"), (8, "we ask how is the capital of France?")]
    _, got, _ = rows(spark, texts, [short, named, "minutes to walk from the old mill"])
    assert set(got) == {(1, 0), (2, 0), (3, 0), (4, 0), (5, 1), (6, 1), (7, 2)}
    assert {k for k, v in got.items() if v[2]} == {(6, 1)}


def test_long_verbatim_part_with_one_changed_name(spark):
    item = "Here Tom told Tom that the old mill by the river has been sold to a man who wants to make paper and not flour again"
    mixed = "Here Tom sells and 12 of us buy from Tom what Tom had"
    texts = [(1, "Well. " + item.replace("Tom", "Ann", 1)), (2, "Well. " + item), (3, "Well. " + mixed.replace("Tom", "Ann", 1))]
    _, got, _ = rows(spark, texts, [item, mixed])
    assert set(got) == {(1, 0), (2, 0)} and got[1, 0][2] and not got[2, 0][2]


SHORT = ["Paris", "42", "Tom", "grey mill", "5 km", "so few of us", "12 km 3 hours 40 dollars 7 kg", "If train A has 40 km and 30 miles left, how long is 12 minutes plus 5 hours today?"]


def test_every_item_is_found_verbatim_in_the_sql_too(spark):
    """Items of one token or more, after a word, a number, a comma or the end of a sentence, and changed ones, against the SQL."""
    long = ITEM.replace("Tom", "Ann", 1)
    items = [*SHORT, ITEM, "Here Tom sells and 12 of us buy from Tom what Tom had", "minutes to walk from the old mill"]
    before = ["", "Question: ", "so, ", "they ask ", "it has 9 ", "End. "]
    texts = [(100 * i + j, b + t + ". And more") for i, t in enumerate(items) for j, b in enumerate(before)]
    texts += [(5000, long), (5001, ITEM.replace("12", "8")), (5002, items[9].replace("Tom", "Ann", 1)), (5003, "no such thing"), (5004, None), (5005, ""), (5006, items[7].replace("40", "41").replace("5 hours", "9 days"))]
    docs, got, bench = rows(spark, texts, items)
    for i in range(len(items)):
        for j in range(len(before)):
            assert (100 * i + j, i) in got, (items[i], before[j])
    assert {k for k in got if k[0] in (5003, 5004, 5005)} == set()
    con = duckdb.connect()
    frames = {"documents": docs.drop("windows").toPandas(), "benchmark": bench.toPandas()}
    for name, frame in frames.items():
        con.register(name, frame)
    want = con.sql(decontam.ORACLE)
    own = decontam.contaminated(docs, bench).select(*want.columns)
    assert sorted(map(tuple, own.collect())) == sorted(want.fetchall())


def test_null_items(spark):
    docs = spark.createDataFrame([(1, "a mill by the river"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "a mill by the river"), (3, None), (4, ""), (5, " .. "), (6, "mill by the river")], "item_id long, text string")
    assert [tuple(r)[:2] for r in decontam.contaminated(docs, bench).collect()] == [(1, 6)]
