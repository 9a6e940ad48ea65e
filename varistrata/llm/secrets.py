"""Secret scans with a trigram inverted index.

From the parse tree of each rule's regular expression a Boolean query over trigrams is derived that every
match must satisfy. Per block of texts the trigrams that the queries name get postings; the postings are
joined as the query says, and only the candidates are verified with the regular expression. A rule whose
query is empty (no mandatory trigram) scans every text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import product
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from varistrata.llm.common import pieces, table, text_schema

#: Most alternatives that are spelled out while a query is derived.
SPELLED = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = 0
    #: A match counts if the text of this group has `least` characters or more.
    group: int = 0
    least: int = 0

    @cached_property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, self.flags | re.ASCII)

    @cached_property
    def query(self):
        return trigram_query(self.pattern, self.flags | re.ASCII)

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.regex.finditer(text) if len(m[self.group]) >= self.least]


# The base rules of the contract.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 0, 24),
)
EXTRA = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)

# A query is True (no condition), a trigram, or ("and" | "or", frozenset of queries).


def _join(op: str, parts: list) -> object:
    flat = set()
    for p in parts:
        if p is True:
            if op == "or":
                return True
        elif isinstance(p, tuple) and p[0] == op:
            flat |= p[1]
        else:
            flat.add(p)
    if not flat:
        return True
    return next(iter(flat)) if len(flat) == 1 else (op, frozenset(flat))


def _spelled(strings: set[str]) -> object:
    """Every match has one of these strings in it."""
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


def _walk(nodes) -> tuple[set[str] | None, object]:
    """The strings that the nodes can match, if few, and a condition that holds in any case."""
    exact: set[str] | None = {""}
    whole, run, conditions = True, {""}, []

    def flush() -> None:
        nonlocal run
        conditions.append(_spelled(run))
        run = {""}

    for op, arg in nodes:
        strings, condition = _one(op, arg)
        if strings is not None and len(strings) * len(run) <= SPELLED:
            run = {a + b for a, b in product(run, strings)}
            continue
        whole = False
        flush()
        if strings is not None:
            run = strings
        else:
            conditions.append(condition)
    exact = run if whole else None
    flush()
    return exact, _join("and", conditions)


def _one(op, arg) -> tuple[set[str] | None, object]:
    if op is C.LITERAL:
        c = chr(arg).lower()
        return ({c}, True) if arg < 128 else (None, True)
    if op is C.SUBPATTERN:
        return _walk(arg[3])
    if op is C.BRANCH:
        parts = [_walk(x) for x in arg[1]]
        if all(s is not None for s, _ in parts):
            strings = set().union(*(s for s, _ in parts))
            return (strings, _spelled(strings)) if len(strings) <= SPELLED else (None, _spelled(strings))
        return None, _join("or", [c for _, c in parts])
    if op is C.IN:
        if all(o is C.LITERAL and a < 128 for o, a in arg):
            return {chr(a).lower() for _, a in arg}, True
        return None, True
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, inner = arg
        strings, condition = _walk(inner)
        if low == 0:
            return ({"", *strings}, True) if high == 1 and strings is not None else (None, True)
        return (strings, condition) if low == high == 1 else (None, condition)
    if op is C.AT:
        return {""}, True
    return None, True  # whatever else there is puts no condition


def trigram_query(pattern: str, flags: int = 0):
    return _walk(_parser.parse(pattern, flags))[1]


def _named(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(_named, query[1]))


class TrigramIndex:
    """Postings of the named trigrams over a block of texts, letters A-Z as a-z."""

    def __init__(self, named: list[str]):
        codes = np.array(sorted(c[0] << 16 | c[1] << 8 | c[2] for c in (t.encode() for t in named)), dtype=np.int32)
        self.codes = codes
        self.wanted = np.zeros(1 << 24, dtype=bool)
        self.wanted[codes] = True

    def postings(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        raw = [(t or "").encode() for t in texts]
        block = np.frombuffer(b"\0\0".join(raw).lower() + b"\0\0", dtype=np.uint8).astype(np.int32)
        ends = np.cumsum([len(r) + 2 for r in raw])
        code = block[:-2] << 16 | block[1:-1] << 8 | block[2:]
        hits = np.flatnonzero(self.wanted[code])
        owner, code = np.searchsorted(ends, hits, side="right"), code[hits]
        return {bytes((int(c) >> 16, int(c) >> 8 & 255, int(c) & 255)).decode("latin-1"): np.unique(owner[code == c]) for c in self.codes}


def candidates(query, postings: dict[str, np.ndarray], n: int) -> np.ndarray:
    if query is True:
        return np.arange(n)
    if isinstance(query, str):
        return postings[query]
    parts = [candidates(q, postings, n) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
    return out


class Scanner:
    def __init__(self, rules=BASE + EXTRA):
        self.rules = rules
        self.index = TrigramIndex(sorted(set().union(*(_named(r.query) for r in rules))))

    def scan(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """For each text the (start, rule number, end) of all matches, in order."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        postings = self.index.postings(texts)
        for k, rule in enumerate(self.rules):
            for i in candidates(rule.query, postings, len(texts)).tolist():
                if texts[i]:
                    found[i] += [(a, k, b) for a, b in rule.spans(texts[i])]
        for spans in found:
            spans.sort()
        return found


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", extra=EXTRA) -> DataFrame:
    """Counts and spans of secrets in each row; null and empty texts have none, repeated rows stay.

    Spans are kind:start:end in code points, end exclusive, by start and then in the order of the rules.
    """
    rules = BASE + tuple(extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, base = Scanner(rules), len(BASE)
        for batch, texts in pieces(batches, text, 4_000_000):
            found = scanner.scan(texts)
            told = lambda spans: ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans)
            counts = [pa.array([sum(k == j for _, k, _ in s) for s in found], pa.int64()) for j in range(base)]
            digests = pa.array([hashlib.sha256(told([x for x in s if x[1] < base]).encode()).hexdigest() for s in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array([told(s) for s in found], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    schema = f"doc_id {text_schema(docs, key)}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(key, text).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
