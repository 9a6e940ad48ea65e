"""Token counts of a byte-level BPE by rank-synchronous merging of ragged arrays.

All pre-tokens of a batch that are not cached lie in one flat array of symbols. In each step every
sequence finds its lowest-rank pair and applies all its occurrences, left to right, at the same time
as all other sequences. A merged symbol only takes part in pairs of higher rank than its own, so this
gives the same symbols as merging one pair at a time. What survives is counted.

A pre-token of many bytes (no white space for pages) would need a pass over itself for each distinct merge. So it
keeps the places of each rank instead and a step touches only the places of its lowest rank.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from varistrata.llm.common import pieces, table, text_schema

LIMIT = 1024
#: Entries of a worker's cache of counts; a fuller cache is emptied between batches.
CACHE = 400_000
FAR = np.int32(2**31 - 1)
#: Bytes from which a pre-token is merged by itself.
LONG = 4096
# The published pre-token pattern of this vocabulary, with white space as Unicode's White_Space.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else the next one from U+0100."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class RankMerger:
    """Counts for the byte-level BPE of a tokenizers .json file without normaliser or prefix space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([ids[a] << 20 | ids[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in pairs], dtype=np.int32)
        self.byte_ids = np.array([ids[c] for c in byte_characters()], dtype=np.int32)
        special = [t["content"] for t in spec.get("added_tokens") or []]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.split = regex.compile(PATTERN).findall
        self.cache: dict[str, int] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], FAR)

    def survivors(self, words: list[bytes]) -> np.ndarray:
        """The number of symbols that each sequence of bytes ends with."""
        counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), counts)
        ranks = np.full(len(symbols), FAR, dtype=np.int32)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        ranks[inner] = self.rank(symbols[inner], symbols[inner + 1])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[starts, len(symbols)])
            least = np.minimum.reduceat(ranks, starts)
            live = least != FAR
            counts[owner[starts[~live]]] = lengths[~live]
            on = np.repeat(live, lengths)
            symbols, owner, ranks = symbols[on], owner[on], ranks[on]
            if not len(symbols):
                break
            hits = np.flatnonzero(ranks == np.repeat(least[live], lengths[live]))
            run = np.r_[True, np.diff(hits) != 1]
            run_start = hits[np.flatnonzero(run)][np.cumsum(run) - 1]
            hits = hits[(hits - run_start) % 2 == 0]
            symbols[hits] = self.merged[ranks[hits]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[hits + 1] = False
            place = np.cumsum(keep)[hits] - 1
            symbols, owner, ranks = symbols[keep], owner[keep], ranks[keep]
            fresh = np.unique(np.r_[place, place[place > 0] - 1])
            inside = np.zeros(len(fresh), dtype=bool)
            has_next = fresh + 1 < len(owner)
            inside[has_next] = owner[fresh[has_next]] == owner[fresh[has_next] + 1]
            ranks[fresh] = FAR
            fresh = fresh[inside]
            ranks[fresh] = self.rank(symbols[fresh], symbols[fresh + 1])
        return counts

    def survivors_of_one(self, word: bytes) -> int:
        """The number of symbols that one long sequence ends with: lowest rank by lowest rank, at all its places at once."""
        n = len(word)
        symbols = self.byte_ids[np.frombuffer(word, dtype=np.uint8)]
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[n - 1] = n  # n stands for the end
        alive = np.ones(n + 1, dtype=bool)
        alive[n] = False
        ranks = np.full(n + 1, FAR, dtype=np.int32)
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def note(at: np.ndarray) -> None:
            """Work out the ranks of the pairs that begin at these places, and queue them."""
            at = at[after[at] < n]
            found = self.rank(symbols[at], symbols[after[at]])
            ranks[at] = found
            at, found = at[found != FAR], found[found != FAR]
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            kinds, starts = np.unique(found, return_index=True)
            for r, part in zip(kinds.tolist(), np.split(at, starts[1:]), strict=False):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(queue, r)
                waiting[r].append(part)

        if n > 1:
            note(np.arange(n - 1))
        while queue:
            r = heapq.heappop(queue)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[alive[at] & (ranks[at] == r)]
            if not len(at):
                continue
            # Of pairs that overlap, every other one from the left.
            run = np.r_[True, after[at[:-1]] != at[1:]]
            start = np.flatnonzero(run)[np.cumsum(run) - 1]
            at = at[(np.arange(len(at)) - start) % 2 == 0]
            gone = after[at]
            symbols[at] = self.merged[r]
            alive[gone] = False
            ranks[gone] = FAR
            after[at] = after[gone]
            before[after[at]] = at
            ranks[at] = FAR
            left = before[at]
            note(np.unique(np.r_[at, left[left >= 0]]))
        return int(alive.sum())

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; a special string inside a text is one token, as the library has it."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache, rows, specials, new = self.cache, [], [], set()
        for text in texts:
            parts = self.special.split(text or "") if self.special else [text or ""]
            words = self.split(parts[0]) if len(parts) == 1 else [w for p in parts for w in self.split(p)]
            rows.append(words)
            specials.append(len(parts) - 1)
            new.update(words)
        fresh = [w for w in new if w not in cache]
        if fresh:
            raw = [w.encode() for w in fresh]
            short = [i for i, w in enumerate(raw) if len(w) < LONG]
            cache.update(zip([fresh[i] for i in short], self.survivors([raw[i] for i in short]).tolist(), strict=True))
            cache.update((fresh[i], self.survivors_of_one(w)) for i, w in enumerate(raw) if len(w) >= LONG)
        return [sum(map(cache.__getitem__, words)) + k for words, k in zip(rows, specials, strict=True)]


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row. Null and empty texts have 0 of both; repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = RankMerger(path)
        for batch, texts in pieces(batches, text, 2_000_000):
            tokens = merger.counts(texts)
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(key, text).mapInArrow(run, f"doc_id {text_schema(docs, key)}, n_bytes long, n_tokens long, over_limit boolean")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
