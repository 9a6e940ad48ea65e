import duckdb
import pytest
from pyspark.sql import functions as F

from varistrata.llm import rules

SF = "/root/testdata/sf0.01"
NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def words_of(text):
    out, word = [], ""
    for ch in text + " ":
        if ch == " " or 9 <= ord(ch) <= 13:
            out += [word] if word else []
            word = ""
        else:
            word += ch
    return out


def brute(doc_id, text):
    """Every rule on its own, by loops."""
    text = text or ""
    words = words_of(text)
    lines = [line for line in text.split("\n") if words_of(line)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    at = {}
    for i, w in enumerate(windows):
        at.setdefault(w, []).append(i)
    repeated = len({i + k for places in at.values() if len(places) > 1 for i in places for k in range(5)})
    n, chars = len(words), sum(len(w) for w in words)
    symbols = sum(ch in "#*$%&|<>" for ch in text)
    dup = sum(line in lines[:i] for i, line in enumerate(lines))
    base = n < 10 or 100 * repeated > 20 * n
    trim = " \t\v\f\r"
    bad = [
        100 * symbols > rules.MOST_SYMBOLS * n,
        n and not rules.SHORTEST_WORDS <= chars / n <= rules.LONGEST_WORDS,
        100 * dup > rules.MOST_DUPLICATE_LINES * len(lines),
        100 * sum(line.lstrip(trim)[:1] in ("-", "*", "•") for line in lines) > rules.MOST_BULLET_LINES * len(lines),
        100 * sum(line.rstrip(trim)[-3:] == "..." or line.rstrip(trim)[-1:] == "…" for line in lines) > rules.MOST_ELLIPSIS_LINES * len(lines),
        100 * sum(any(c.isascii() and c.isalpha() or ord(c) > 127 for c in w) for w in words) < rules.LEAST_LETTERS * n,
    ]
    return (doc_id, n, chars, symbols, dup, repeated, base, not base and not any(bad))


def judged(docs, order=rules.RULES):
    return sorted([tuple(r) for r in rules.cascade(docs, order, counts=True).select(*NAMES).collect()], key=str)


def test_whole_table_equals_brute_force_and_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted([brute(r.doc_id, r.text) for r in docs.collect()], key=str)
    got = sorted([tuple(r) for r in rules.query(spark, SF).select(*NAMES).collect()], key=str)
    assert got == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(con.sql(f"SELECT {', '.join(NAMES)} FROM ({rules.ORACLE})").fetchall(), key=str) == got


def test_good_labels_stay_and_bad_ones_go(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = labels.join(rules.query(spark, SF), "doc_id").where("quality is not null").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept"), F.avg(F.when(~F.col("base_failed"), F.col("kept").cast("double"))).alias("beyond")).collect()
    share = {r.quality: r for r in got}
    assert share[1].kept > 0.95 and share[1].beyond > 0.99 and share[0].kept < 0.1


PLAIN = "the old mill by the river has been sold to a man who wants to make paper there"
MADE = [
    None, "", " \n\t\v\f\r ", "a", PLAIN, PLAIN + "\n" + PLAIN, "a a a a a a", "one two three four five\n" * 3, "  x y", "- " + PLAIN, "\n".join(["  • " + PLAIN[i:] for i in range(12)]),
    PLAIN + "...", PLAIN + "…\r\n" + PLAIN.upper(), "12 34 56 " * 5 + PLAIN, "# " + PLAIN, "#$ " * 5 + PLAIN, "a b c d e f g h i j k l m n", ("x" * 40 + " ") * 3 + PLAIN, "w " * 200_000, " ".join(f"w{i}" for i in range(100_000)), "x" * 300_000, "𝒳𝒴 " + PLAIN + " naïve",
]


def test_odd_texts_rows_and_columns(spark):
    rows = [(i if i % 5 else None, t, 1, "k", True, 2) for i, t in enumerate([*MADE, PLAIN, PLAIN])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, _text string, kept boolean, rejected_by int").repartition(3)
    assert judged(docs) == sorted([brute(r[0], r[1]) for r in rows], key=str)
    kept = rules.keep_good(docs)
    assert kept.columns == docs.columns
    good = [r for r in rows if brute(*r[:2])[-1]]
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, good)) and good
    none = docs.limit(0)
    assert judged(none) == [] and rules.keep_good(none).count() == 0 and [m.rule for m in rules.measure(none)] == list(rules.RULES)


def test_the_order_changes_no_verdict_and_saves_work(spark):
    """Any order keeps the same texts; the measured one asks fewer rules, and none after the first that rejects."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    measured = rules.measure(docs)
    order = [m.rule for m in measured]
    assert {r.name for r in order} == {r.name for r in rules.RULES} and [m.rank for m in measured] == sorted((m.rank for m in measured), reverse=True)
    assert judged(docs, order) == judged(docs, order[::-1])
    texts = [rules.Text(r.text) for r in docs.collect()]
    cost = {m.rule.name: m.cost for m in measured}

    def work(rank):
        return sum(sum(cost[r.name] for r in rank[: next((i + 1 for i, r in enumerate(rank) if r.fails(t)), len(rank))]) for t in texts)

    assert work(order) < work(order[::-1])
    asked = []
    spy = [rules.Rule("no", lambda t: asked.append("no")), rules.Rule("yes", lambda t: asked.append("yes") or True), rules.Rule("never", lambda t: asked.append("never"))]
    assert rules.verdict(rules.Text(PLAIN), spy) == "yes" and asked == ["no", "yes"]


@pytest.mark.parametrize("most", [1, 20, 5000])
def test_the_sample_is_bounded_and_of_different_texts(spark, most):
    docs = spark.createDataFrame([(i, f"t{i % 100}") for i in range(2000)] + [(9999, "y" * 70_000), (None, None)], "doc_id long, text string")
    got = [r.text for r in rules.sample(docs, most=most).collect()]
    assert len(got) == len(set(got)) == min(most, 101) and max(map(len, got)) < 10
