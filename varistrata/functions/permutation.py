"""Keyed permutations of 0 .. n - 1 by arithmetic: any place is found without looking at the others.

A Feistel network of ROUNDS rounds permutes the pairs (i // a, i % a) of a square of side a = ceil(sqrt(n)); a place outside of
0 .. n - 1 is permuted on until it is inside (cycle walking), which keeps the map one-to-one. The key is a list of
whole numbers, such as seed, repetition and size.
"""

from __future__ import annotations

import math

import numpy as np

ROUNDS, MASK = 6, (1 << 32) - 1
# Fixed values of the mixing function: an offset and two odd multipliers below 2**31, so products fit into 63 bits.
OFFSET, FIRST, SECOND = 2654435769, 1103515245, 1812433253


def mix(x):
    """32 bits from a whole number (or array) of up to 62 bits."""
    x = ((x + OFFSET) & MASK) * FIRST & MASK
    x = (x ^ (x >> 15)) * SECOND & MASK
    return x ^ (x >> 13)


def keyed(*key):
    """One number for a key of several; arrays are taken place by place."""
    out = np.int64(0)
    for part in key:
        out = mix(out + (np.asarray(part, dtype=np.int64) & MASK))
    return out


def permuted(i: np.ndarray, n: int | np.ndarray, *key) -> np.ndarray:
    """The places (from 0) of i under the permutation of 0 .. n - 1 with this key; n and parts of the key may be arrays like i."""
    i = np.array(i, dtype=np.int64)
    n = np.broadcast_to(np.asarray(n, dtype=np.int64), i.shape)
    if i.size and (i.min() < 0 or (i >= n).any()):
        raise ValueError("a place is not below n")
    side = np.array([math.isqrt(max(int(v) - 1, 0)) + 1 for v in np.unique(n)], dtype=np.int64)[np.searchsorted(np.unique(n), n)]
    base = np.broadcast_to(keyed(*key), i.shape)
    turns = [mix(base + k) for k in range(ROUNDS)]
    out, left = i.copy(), np.ones(i.shape, dtype=bool)
    while left.any():
        a = side[left]
        high, low = out[left] // a, out[left] % a
        for turn in turns:
            high, low = low, (high + mix(low + turn[left])) % a
        out[left] = high * a + low
        left = out >= n
    return out


def _sql_mix(x: str) -> str:
    return f"list_reduce([CAST(({x} + {OFFSET}) & {MASK} AS BIGINT), 0, 0, 0, 0], lambda fv, _, fk: CASE fk WHEN 2 THEN (fv * {FIRST}) & {MASK} WHEN 3 THEN xor(fv, fv >> 15) WHEN 4 THEN (fv * {SECOND}) & {MASK} ELSE xor(fv, fv >> 13) END)"


def sql_keyed(*key: str) -> str:
    """`keyed` in DuckDB's SQL, for expressions of whole numbers."""
    out = "CAST(0 AS BIGINT)"
    for part in key:
        out = _sql_mix(f"({out} + (CAST({part} AS BIGINT) & {MASK}))")
    return out


def sql(i: str, n: str, *key: str) -> str:
    """`permuted` in DuckDB's SQL. Walks up to 64 steps, which small n need at most and large n never do. Columns of the query must not be named fs, fz and the like."""
    step = f"list_reduce(list_concat([{{'h': fs.v // fs.a, 'l': fs.v % fs.a}}], list_transform(fs.turns, lambda ft: {{'h': ft, 'l': CAST(0 AS BIGINT)}})), lambda fp, fq: {{'h': fp.l, 'l': (fp.h + {_sql_mix('(fp.l + fq.h)')}) % fs.a}})"
    state = f"{{'v': CAST({i} AS BIGINT), 'a': CAST(ceil(sqrt({n})) AS BIGINT), 'n': CAST({n} AS BIGINT), 'turns': list_transform([{sql_keyed(*key)}], lambda fb: list_transform(range({ROUNDS}), lambda fr: {_sql_mix('(fb + fr)')}))[1], 'go': true}}"
    walk = "{'v': fz.h * fs.a + fz.l, 'a': fs.a, 'n': fs.n, 'turns': fs.turns, 'go': fz.h * fs.a + fz.l >= fs.n}"
    return f"list_reduce(list_concat([{state}], list_transform(range(64), lambda _: CAST(NULL AS STRUCT(v BIGINT, a BIGINT, n BIGINT, turns BIGINT[], go BOOLEAN)))), lambda fs, _: CASE WHEN fs.go THEN list_transform([{step}], lambda fz: {walk})[1] ELSE fs END).v"
