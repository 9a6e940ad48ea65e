"""Quality rules as a short-circuit cascade.

A rule tells whether a text fails. What each rule costs and how many texts it rejects is measured inside tasks on a
sample (at most SAMPLE_TEXTS different texts of at most SAMPLE_BYTES each, those with the lowest hashes), and rules are
put in the order of rejections per cost. Every text then meets the rules in that order until one rejects it. The order changes
the work only: a text is kept if no rule rejects it, whatever the order.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varistrata.llm.common import pieces, table

SAMPLE_TEXTS, SAMPLE_BYTES = 1000, 1 << 16
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTER = re.compile(r"[A-Za-z\x80-\U0010ffff]")
SYMBOLS = "#*$%&|<>"
WINDOW = 5
# Thresholds of the rules, whole numbers (percent where shares are meant).
FEWEST_WORDS, MOST_REPEATED, MOST_SYMBOLS, MOST_DUPLICATE_LINES, MOST_BULLET_LINES, MOST_ELLIPSIS_LINES, LEAST_LETTERS = 10, 20, 10, 50, 90, 30, 60
SHORTEST_WORDS, LONGEST_WORDS = 2, 15
BULLETS, ELLIPSES = ("-", "*", "•"), ("...", "…")


class Text:
    """What rules ask of a text, each worked out when it is first asked for. A null text is an empty one."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[str]:
        return WORD.findall(self.text)

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """Lines with a word."""
        return [line for line in self.text.split("\n") if WORD.search(line)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in windows of WINDOW words that the text has twice or more."""
        numbers: dict[str, int] = {}
        ids = [numbers.setdefault(w, len(numbers)) for w in self.words]
        windows = list(zip(*(ids[i:] for i in range(WINDOW)), strict=False))
        seen = Counter(windows)
        if len(seen) == len(windows):
            return 0
        covered, end = 0, 0
        for at, window in enumerate(windows):
            if seen[window] > 1:
                covered += at + WINDOW - max(at, end)
                end = at + WINDOW
        return covered


def few_words(t: Text) -> bool:
    return t.n_words < FEWEST_WORDS


def repeated_windows(t: Text) -> bool:
    return 100 * t.n_repeat_words > MOST_REPEATED * t.n_words


def symbols(t: Text) -> bool:
    return 100 * t.n_symbols > MOST_SYMBOLS * t.n_words


def word_length(t: Text) -> bool:
    return t.n_words > 0 and not SHORTEST_WORDS * t.n_words <= t.word_chars <= LONGEST_WORDS * t.n_words


def duplicate_lines(t: Text) -> bool:
    return 100 * t.n_dup_lines > MOST_DUPLICATE_LINES * len(t.lines)


def bullet_lines(t: Text) -> bool:
    return 100 * sum(line.lstrip(" \t\v\f\r").startswith(BULLETS) for line in t.lines) > MOST_BULLET_LINES * len(t.lines)


def ellipsis_lines(t: Text) -> bool:
    return 100 * sum(line.rstrip(" \t\v\f\r").endswith(ELLIPSES) for line in t.lines) > MOST_ELLIPSIS_LINES * len(t.lines)


def few_letters(t: Text) -> bool:
    """Too few words have a letter (an ASCII one, or any character beyond ASCII)."""
    return 100 * sum(LETTER.search(w) is not None for w in t.words) < LEAST_LETTERS * t.n_words


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Callable[[Text], bool]


RULES = tuple(Rule(f.__name__, f) for f in (few_words, repeated_windows, symbols, word_length, duplicate_lines, bullet_lines, ellipsis_lines, few_letters))
#: Rules whose failure is told in a column of its own.
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Measured:
    """A rule on the sample: nanoseconds a text, and the share of texts that it rejects."""

    rule: Rule
    cost: float
    rejected: float

    @property
    def rank(self) -> float:
        return self.rejected / max(self.cost, 1.0)


def sample(docs: DataFrame, text: str = "text", most: int = SAMPLE_TEXTS, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """The `most` different texts of at most most_bytes with the lowest hashes. Each task sends hashes, not texts, to find the last of them."""
    short = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).where(F.octet_length("text") <= most_bytes).withColumn("h", F.xxhash64("text"))
    last = short.groupBy("h").agg(F.lit(1)).orderBy("h").limit(most).agg(F.max("h")).first()[0]
    return short.where(F.col("h") <= F.lit(last)).groupBy("h").agg(F.min("text").alias("text")).select("text")


def measure(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", most: int = SAMPLE_TEXTS, most_bytes: int = SAMPLE_BYTES) -> list[Measured]:
    """Costs and rejections on the sample, the rules by rejections per cost, best first; equal ones by cost, then in the order given.

    Without any sampled text (an empty table) the rules stay in the order given.
    """

    def timed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, rejected, n = [0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for value in batch.column(0).to_pylist():
                n += 1
                for i, rule in enumerate(rules):
                    t = Text(value)  # anew, so that no rule profits from another one's work
                    began = time.perf_counter_ns()
                    rejected[i] += bool(rule.fails(t))
                    spent[i] += time.perf_counter_ns() - began
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array(spent, pa.int64()), pa.array(rejected, pa.int64()), pa.array([n] * len(rules), pa.int64())], ["rule", "ns", "rejected", "n"])

    found = sample(docs, text, most, most_bytes).mapInArrow(timed, "rule int, ns long, rejected long, n long").groupBy("rule").agg(F.sum("ns").alias("ns"), F.sum("rejected").alias("rejected"), F.sum("n").alias("n")).collect()
    by = {r["rule"]: r for r in found}
    told = [Measured(rule, by[i]["ns"] / max(1, by[i]["n"]), by[i]["rejected"] / max(1, by[i]["n"])) if i in by else Measured(rule, 1.0, 0.0) for i, rule in enumerate(rules)]
    return sorted(told, key=lambda m: (-m.rank, m.cost))


def verdict(t: Text, order: Sequence[Rule]) -> str | None:
    """The first rule in the order that the text fails; None if it fails none."""
    return next((rule.name for rule in order if rule.fails(t)), None)


def cascade(docs: DataFrame, order: Sequence[Rule], key: str = "doc_id", text: str = "text", counts: bool = False) -> DataFrame:
    """key, rejected_by (the first rule in the order that the text fails, null if none) and kept of each row of docs.

    counts: also n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and base_failed (a rule of BASE fails),
    which take work that the cascade would save. Null and empty texts have no words and fail few_words. Repeated
    rows are judged alike, null keys stay. An empty table gives no rows; other columns, whatever their names, don't count.
    """
    rules = list(order)
    base = [rule for rule in rules if rule.name in BASE]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") if counts else ()

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "_text"):
            said, told, failed = [], [[] for _ in names], []
            for value in texts:
                t = Text(value)
                said.append(verdict(t, rules))
                if counts:
                    for cells, name in zip(told, names, strict=True):
                        cells.append(getattr(t, name))
                    failed.append(any(rule.fails(t) for rule in base))
            more = [*(pa.array(cells, pa.int64()) for cells in told), pa.array(failed, pa.bool_())] if counts else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string()), pa.array([s is None for s in said], pa.bool_()), *more], [key, "rejected_by", "kept", *names, *(["base_failed"] if counts else [])])

    kind = docs.schema[key].dataType.simpleString()
    schema = ", ".join([f"`{key}` {kind}", "rejected_by string", "kept boolean", *(f"{n} long" for n in names), *(["base_failed boolean"] if counts else [])])
    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("_text")).mapInArrow(judged, schema)


def keep_good(docs: DataFrame, order: Sequence[Rule] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that no rule rejects, with the columns of docs; the texts are judged where they lie."""
    rules = [m.rule for m in measure(docs, text=text)] if order is None else list(order)
    schema = docs.schema

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, text):
            yield batch.filter(pa.array([verdict(Text(value), rules) is None for value in texts], pa.bool_()))

    return docs.mapInArrow(kept, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    order = [m.rule for m in measure(docs)]
    return cascade(docs, order, counts=True).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_LINE = r"[ \t\x0B\f\r]*"
#: Counts and rules by lists of words and lines.
ORACLE = rf"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM a),
c AS (SELECT *, row_number() OVER () AS r, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[{SYMBOLS}]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines FROM b),
v AS (SELECT r, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM c)),
t AS (SELECT r, i FROM v JOIN (SELECT r, x FROM v GROUP BY 1, 2 HAVING count(*) > 1) USING (r, x)),
m AS (SELECT r, count(DISTINCT i + k) AS n FROM t, (SELECT unnest(range({WINDOW})) AS k) GROUP BY 1),
d AS (SELECT c.*, CAST(coalesce(m.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS nl FROM c LEFT JOIN m USING (r)),
e AS (SELECT *, n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
 100 * n_symbols > {MOST_SYMBOLS} * n_words OR word_chars NOT BETWEEN {SHORTEST_WORDS} * n_words AND {LONGEST_WORDS} * n_words OR 100 * n_dup_lines > {MOST_DUPLICATE_LINES} * nl
 OR 100 * len(list_filter(l, lambda x: regexp_matches(x, '^{_LINE}(-|\*|•)'))) > {MOST_BULLET_LINES} * nl OR 100 * len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…){_LINE}$'))) > {MOST_ELLIPSIS_LINES} * nl
 OR 100 * len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) < {LEAST_LETTERS} * n_words AS rejected FROM d)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM e
"""
