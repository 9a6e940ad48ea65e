"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input joins a vector of the word (one of a learned vocabulary, else that of unknown words) and the
scaled sum of vectors of its character 3- and 5-grams (those that were learned, else one for all others). Overlapping windows of words run through a gated recurrent
unit in both directions; attention pools the states into a logit. All windows of a text are scored; the
largest logit, on a calibrated curve, is the text's score. Only texts carry labels, so training looks for the
window that speaks most for a positive text (multiple-instance learning).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varistrata.llm.common import bounded_ids, fold, labelled_texts, pieces, table, text_schema
from varistrata.llm.quality import calibrate

WINDOW, STRIDE = 24, 12
HIDDEN, WORD_SIZE, CHAR_SIZE = 8, 8, 8
#: Labelled texts of each class that are fitted on, and their bytes, at most (whole texts).
FIT_ROWS, FIT_BYTES = 1200, 8 << 20
#: The vocabulary has the words of this many texts or more.
LEAST_TEXTS = 3
ROUNDS, EPOCHS, BATCH, RATE, DECAY = 4, 4, 128, 0.01, 0.01
#: Windows of negative texts in a round for each text, besides the strongest of each.
NEGATIVES = 3
FOLDS, HELD, THRESHOLD = 4, 2, 0.3
#: Distinct words whose inputs a worker keeps; windows that run together.
CACHE, TOGETHER = 120_000, 2048
#: Words whose inputs are worked out together.
PART = 20_000
PAD = 0
_words = re.compile(r"\w+").findall


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 3- and 5-grams of the characters of all words, ends marked, and where each word's hashes begin."""
    padded = ["\x02" + w + "\x03" for w in words]
    lengths = np.fromiter(map(len, padded), dtype=np.int64, count=len(padded))
    flat = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    hashes, owners = [], []
    for size in (3, 5):
        n = len(flat) - size + 1
        if n <= 0:
            continue
        code = np.full(n, size, dtype=np.uint64)
        for k in range(size):
            code = (code ^ flat[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
        inside = owner[:n] == owner[size - 1 :]
        hashes.append(code[inside])
        owners.append(owner[:n][inside])
    order = np.argsort(np.concatenate(owners), kind="stable")
    counts = np.bincount(np.concatenate(owners), minlength=len(words))
    return np.concatenate(hashes)[order], np.cumsum(counts) - counts


class Network:
    """Parameters with their gradients; inputs are numbers of distinct words whose word and character rows are known."""

    def __init__(self, vocabulary: dict[str, int], known_grams: np.ndarray | None = None, seed: int = 5, dtype=np.float32):
        rng = np.random.default_rng(seed)
        draw = lambda *size, scale=0.3: (rng.standard_normal(size) * scale).astype(dtype)
        inner = WORD_SIZE + CHAR_SIZE
        self.vocabulary = vocabulary
        #: Sorted hashes; row 0 of the character table is that of all other n-grams.
        self.known_grams = np.zeros(0, dtype=np.uint64) if known_grams is None else known_grams
        self.p = {"words": draw(len(vocabulary) + 2, WORD_SIZE, scale=0.1), "chars": draw(len(self.known_grams) + 1, CHAR_SIZE, scale=0.1), "pool": draw(2 * HIDDEN, 2), "bias": np.zeros(1, dtype)}
        for d in "fb":
            self.p |= {f"{d}W": draw(inner, 3 * HIDDEN), f"{d}U": draw(HIDDEN, 3 * HIDDEN), f"{d}b": np.zeros(3 * HIDDEN, dtype), f"{d}n": np.zeros(HIDDEN, dtype)}
        self.slope, self.offset = 1.0, 0.0

    # Inputs: rows 0 (padding) and 1 (unknown) of the word table come before the vocabulary's.

    def known(self, words: list[str]) -> np.ndarray:
        return np.fromiter((self.vocabulary.get(w, -1) + 2 for w in words), dtype=np.int64, count=len(words))

    def char_rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        hashes, starts = grams(words)
        if not len(self.known_grams):
            return np.zeros(len(hashes), dtype=np.int64), starts
        at = np.minimum(np.searchsorted(self.known_grams, hashes), len(self.known_grams) - 1)
        return np.where(self.known_grams[at] == hashes, at + 1, 0), starts

    def pooled(self, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each word the sum of its n-grams' vectors over the root of their number."""
        sizes = np.diff(np.r_[starts, len(rows)])
        return np.add.reduceat(self.p["chars"][rows], starts, axis=0) / np.sqrt(sizes)[:, None].astype(self.p["chars"].dtype)

    def inputs(self, words: list[str]) -> np.ndarray:
        rows, starts = self.char_rows(words)
        chars = self.pooled(rows, starts)
        return np.concatenate([self.p["words"][self.known(words)], chars], axis=1)

    def pad_input(self) -> np.ndarray:
        return np.concatenate([self.p["words"][:1], np.zeros((1, CHAR_SIZE), self.p["words"].dtype)], axis=1)

    def gates(self, x: np.ndarray) -> list[np.ndarray]:
        return [x @ self.p[f"{d}W"] + self.p[f"{d}b"] for d in "fb"]

    def logits(self, ids: np.ndarray, gates: list[np.ndarray], keep: list | None = None) -> np.ndarray:
        """ids: windows by places; gates: of each distinct word and direction. keep: gets what the gradient needs."""
        n, length = ids.shape
        both = np.zeros((length, n, 2), dtype=gates[0].dtype)
        for k, d in enumerate("fb"):
            u, bias, pool = self.p[f"{d}U"], self.p[f"{d}n"], self.p["pool"][k * HIDDEN : (k + 1) * HIDDEN]
            h = np.zeros((n, HIDDEN), dtype=gates[0].dtype)
            for t in range(length) if d == "f" else range(length - 1, -1, -1):
                x, a = gates[k][ids[:, t]], h @ u
                zr = _sigmoid(x[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = a[:, 2 * HIDDEN :] + bias
                new = 2 * _sigmoid(2 * (x[:, 2 * HIDDEN :] + r * c)) - 1
                before, h = h, new + z * (h - new)
                both[t] += h @ pool
                if keep is not None:
                    keep.append((d, t, before, z, r, c, new, h))
        attention = np.where(ids.T == PAD, -1e9, both[:, :, 0])
        attention = np.exp(attention - attention.max(axis=0))
        attention /= attention.sum(axis=0)
        out = (attention * both[:, :, 1]).sum(axis=0) + self.p["bias"][0]
        if keep is not None:
            keep.append((attention, both[:, :, 1], out))
        return out.astype(gates[0].dtype)

    def gradient(self, ids: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, word_rows: np.ndarray, chars: tuple[np.ndarray, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        """Of the weighted cross entropy. x, word_rows, chars: of the distinct words, padding first (without characters)."""
        keep: list = []
        gates = self.gates(x)
        out = self.logits(ids, gates, keep)
        attention, values, _ = keep.pop()
        p = _sigmoid(out)
        loss = float(-(weight * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum())
        d_out = weight * (p - y)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["bias"][0] = d_out.sum()
        d_both = np.stack([attention * (values - (attention * values).sum(axis=0)) * d_out, attention * d_out], axis=2)
        d_both[:, :, 0][ids.T == PAD] = 0
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            part = slice(k * HIDDEN, (k + 1) * HIDDEN)
            u, pool = self.p[f"{d}U"], self.p["pool"][part]
            d_gates = np.zeros_like(gates[k])
            dh = np.zeros((len(ids), HIDDEN), dtype=x.dtype)
            for _, t, before, z, r, c, new, h in reversed([s for s in keep if s[0] == d]):
                g["pool"][part] += h.T @ d_both[t]
                dh = dh + d_both[t] @ pool.T
                d_new = dh * (1 - z) * (1 - new * new)
                d_z, d_r = dh * (before - new) * z * (1 - z), d_new * c * r * (1 - r)
                da = np.concatenate([d_z, d_r, d_new * r], axis=1)
                np.add.at(d_gates, ids[:, t], np.concatenate([d_z, d_r, d_new], axis=1))
                g[f"{d}U"] += before.T @ da
                g[f"{d}n"] += (d_new * r).sum(axis=0)
                dh = dh * z + da @ u.T
            g[f"{d}W"] += x.T @ d_gates
            g[f"{d}b"] += d_gates.sum(axis=0)
            dx += d_gates @ self.p[f"{d}W"].T
        np.add.at(g["words"], word_rows, dx[:, :WORD_SIZE])
        rows, starts = chars
        sizes = np.diff(np.r_[starts, len(rows)])
        np.add.at(g["chars"], rows, np.repeat(dx[1:, WORD_SIZE:] / np.sqrt(sizes)[:, None], sizes, axis=0))
        return loss, g

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * logit + self.offset)


def windows(numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One flat array of word numbers, the starts of all windows in it, and the first window of each text (all texts have words)."""
    flat, starts, first, at, count = [], [], [], 0, 0
    for ids in numbers:
        n = max(len(ids), WINDOW)
        flat.append(ids)
        if len(ids) < WINDOW:
            flat.append(np.full(WINDOW - len(ids), PAD, dtype=ids.dtype))
        own = np.arange(0, n - WINDOW + 1, STRIDE)
        if own[-1] != n - WINDOW:
            own = np.append(own, n - WINDOW)
        starts.append(own + at)
        first.append(count)
        at, count = at + n, count + len(own)
    return np.concatenate(flat), np.concatenate(starts), np.array(first)


def window_logits(net: Network, flat: np.ndarray, starts: np.ndarray, gates: list[np.ndarray]) -> np.ndarray:
    places = np.arange(WINDOW)
    return np.concatenate([net.logits(flat[starts[i : i + TOGETHER, None] + places], gates) for i in range(0, len(starts), TOGETHER)])


class Scorer:
    """Scores texts; the gate inputs of a word are worked out once and kept while there is room."""

    def __init__(self, net: Network):
        self.net = net
        self._reset()

    def _reset(self):
        self.numbers: dict[str, int] = {}
        self.tables = [g.astype(np.float32) for g in self.net.gates(self.net.pad_input())]
        self.filled = 1

    def _add(self, new: list[str]):
        for i in range(0, len(new), PART):
            part = new[i : i + PART]
            gates = self.net.gates(self.net.inputs(part))
            if self.filled + len(part) > len(self.tables[0]):
                self.tables = [np.concatenate([t, np.zeros((self.filled + len(part), t.shape[1]), np.float32)]) for t in self.tables]
            for t, g in zip(self.tables, gates, strict=True):
                t[self.filled : self.filled + len(part)] = g
            self.filled += len(part)

    def scores(self, texts: list[str | None]) -> list[float]:
        if len(self.numbers) > CACHE:
            self._reset()
        numbers, new, rows, places = self.numbers, [], [], []

        def number(word: str) -> int:
            n = numbers.get(word)
            if n is None:
                n = numbers[word] = len(numbers) + 1
                new.append(word)
            return n

        for i, text in enumerate(texts):
            words = _words((text or "").lower())
            if words:
                rows.append(np.fromiter(map(number, words), dtype=np.int32, count=len(words)))
                places.append(i)
        out = np.zeros(len(texts))
        if rows:
            self._add(new)
            flat, starts, first = windows(rows)
            logits = window_logits(self.net, flat, starts, self.tables)
            out[places] = self.net.probability(np.maximum.reduceat(logits, first).astype(float))
        return out.tolist()


def train(texts: list[str | None], y: list[int], shares: tuple[float, float], seed: int = 17) -> Network:
    """Fitted on two thirds of the texts and calibrated on the rest; shares: of the classes among all labels.

    With no text of a class the network stays untrained and the score is the share of label 1.
    """
    rng = np.random.default_rng(seed)
    prior = shares[1] / sum(shares) if sum(shares) else 0.0
    # Texts become numbers of their distinct words (from 1) at once.
    number: dict[str, int] = {}
    docs, kept_labels = [], []
    for t, c in zip(texts, y, strict=True):
        words = _words((t or "").lower())
        if words:
            docs.append(np.fromiter((number.setdefault(w, len(number) + 1) for w in words), dtype=np.int32, count=len(words)))
            kept_labels.append(c)
    distinct = list(number)
    held = np.arange(len(docs)) % 3 == 2
    labels = np.array(kept_labels)
    if len(docs) < 6 or len(set(labels[~held].tolist())) < 2:
        net = Network({})
        net.slope, net.offset = 0.0, float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
        return net
    # Words and n-grams of few texts count as unknown. The vectors of the others begin with smoothed log odds in one place.
    parts = [grams(distinct[i : i + PART]) for i in range(0, len(distinct), PART)]
    sizes = np.concatenate([np.diff(np.r_[b, len(h)]) for h, b in parts])
    begins = np.cumsum(sizes) - sizes
    all_grams, gram = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
    del parts
    gram = gram.astype(np.int32)
    seen, total = set(), np.zeros(2)
    in_word, in_gram = np.zeros((2, len(distinct)), np.int32), np.zeros((2, len(all_grams)), np.int32)
    for ids, c, out in zip(docs, kept_labels, held, strict=True):
        if not out and (content := ids.tobytes()) not in seen:
            seen.add(content)
            own = np.unique(ids) - 1
            in_word[c, own] += 1
            in_gram[c, np.unique(np.concatenate([gram[begins[i] : begins[i] + sizes[i]] for i in own]))] += 1
            total[c] += 1
    odds = lambda n: np.log((n[1] + 1) / (total[1] + 2)) - np.log((n[0] + 1) / (total[0] + 2))
    frequent_word, frequent_gram = in_word.sum(axis=0) >= LEAST_TEXTS, in_gram.sum(axis=0) >= LEAST_TEXTS
    net = Network({distinct[i]: k for k, i in enumerate(np.flatnonzero(frequent_word))}, all_grams[frequent_gram])
    net.p["words"][2:, 0] = odds(in_word)[frequent_word] / 2
    net.p["chars"][1:, 0] = odds(in_gram)[frequent_gram] / 2
    flat, starts, first = windows(docs)
    owner = np.repeat(np.arange(len(docs)), np.diff(np.r_[first, len(starts)]))
    rows = np.where(frequent_gram, np.cumsum(frequent_gram), 0).astype(np.int32)[gram]
    word_rows = np.r_[0, net.known(distinct)]
    by_gram = np.maximum.reduceat(np.where(frequent_gram, odds(in_gram), 0.0).astype(np.float32)[gram], begins)
    strength = np.r_[0.0, np.where(frequent_word, odds(in_word), by_gram)]
    score = np.concatenate([strength[flat[starts[i : i + TOGETHER, None] + np.arange(WINDOW)]].max(axis=1) for i in range(0, len(starts), TOGETHER)])
    del gram, by_gram, in_gram
    fit_docs = np.flatnonzero(~held)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    for round_ in range(ROUNDS):
        best = np.array([s + int(np.argmax(score[s:e])) for s, e in zip(first, [*first[1:], len(starts)], strict=True)])
        chosen = [best[fit_docs]]
        negative = fit_docs[labels[fit_docs] == 0]
        others = np.flatnonzero(np.isin(owner, negative))
        chosen.append(rng.choice(others, size=min(len(others), NEGATIVES * len(fit_docs)), replace=False))
        pool = np.unique(np.concatenate(chosen))
        target = labels[owner[pool]].astype(np.float32)
        weight = np.where(target == 1, 0.5 / max(1, target.sum()), 0.5 / max(1, (1 - target).sum())).astype(np.float32) * len(pool)
        for _ in range(EPOCHS):
            order = rng.permutation(len(pool))
            for i in range(0, len(order), BATCH):
                take = pool[order[i : i + BATCH]]
                used, ids = np.unique(np.r_[0, flat[starts[take, None] + np.arange(WINDOW)].ravel()], return_inverse=True)
                ids = ids[1:].reshape(len(take), WINDOW)
                own = used[1:] - 1
                span = np.repeat(begins[own], sizes[own]) + np.arange(sizes[own].sum()) - np.repeat(np.cumsum(sizes[own]) - sizes[own], sizes[own])
                chars = (rows[span], np.cumsum(sizes[own]) - sizes[own])
                pooled = net.pooled(*chars)
                x = np.concatenate([net.p["words"][word_rows[used]], np.concatenate([np.zeros((1, CHAR_SIZE), np.float32), pooled])], axis=1)
                w = weight[order[i : i + BATCH]]
                _, g = net.gradient(ids, x, target[order[i : i + BATCH]], w / len(take), word_rows[used], chars)
                step += 1
                for k, v in net.p.items():
                    m, s = moments[k]
                    m += 0.1 * (g[k] - m)
                    s += 0.001 * (g[k] ** 2 - s)
                    v -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8) + RATE * DECAY * v
        each = [net.gates(net.pad_input()), *(net.gates(net.inputs(distinct[i : i + PART])) for i in range(0, len(distinct), PART))]
        gates = [np.concatenate([g[k] for g in each]) for k in range(2)]
        del each
        score = window_logits(net, flat, starts, gates)
    top = np.maximum.reduceat(score, first).astype(float)
    base = np.flatnonzero(held)
    if len(set(labels[base].tolist())) < 2:
        base = np.arange(len(docs))
    counts = np.bincount(labels[base], minlength=2)
    net.slope, net.offset = calibrate(top[base], labels[base], np.array(shares)[labels[base]] / counts[labels[base]] * len(base) / sum(shares), ridge=0.1)
    return net


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", rows: int = FIT_ROWS, most_bytes: int = FIT_BYTES) -> Network:
    """From at most `rows` labelled texts of each class with most_bytes in all, those whose keys have the smallest hashes.

    Null labels don't count. Without texts of both classes (empty tables too) the network stays untrained and all texts with a word get the share of label 1.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    shares = {r[label]: r["n"] for r in known.groupBy(label).agg(F.count("*").alias("n")).collect()}
    ids = [bounded_ids(known.where(F.col(label) == k), key, rows).withColumn("_y", F.lit(k)) for k in (0, 1)]
    found = sorted(labelled_texts(docs, ids[0].unionByName(ids[1]), "_y", most_bytes, key, text).collect(), key=lambda r: (str(r[key])[::-1], r["_y"]))
    return train([r[text] for r in found], [r["_y"] for r in found], (float(shares.get(0, 0)), float(shares.get(1, 0))))


def score(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted for each row. Texts that are null or have no word get 0; repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for batch, texts in pieces(batches, text, 1_500_000):
            scores = scorer.scores(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select(key, text).mapInArrow(run, f"doc_id {text_schema(docs, key)}, score double, predicted int")


def keep_clean(docs: DataFrame, net: Network, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns as they are, whose score is below the threshold."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for batch in batches:
            named = batch.rename_columns([str(i) for i in range(batch.num_columns)])
            for piece, texts in pieces([named], str(at), 1_500_000):
                good = piece.filter(pa.array([s < threshold for s in scorer.scores(texts)], pa.bool_()))
                yield good.rename_columns(batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def model(spark, sf_dir: str) -> Network:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return fit(docs, labels.where(fold("doc_id", FOLDS) != HELD))


def query(spark, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(fold("doc_id", FOLDS) == HELD, F.lit(False)).alias("held_out")
    return score(table(spark, sf_dir, "documents"), model(spark, sf_dir)).select("doc_id", held_out, "score", "predicted")
