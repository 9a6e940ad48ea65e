"""Quality by compression: two zstandard dictionaries, built from good and from bad labelled text.

A text is cut into blocks; each block is compressed with either dictionary. The difference of the two total
sizes over the size of the text tells which kind of text it resembles; a logistic curve, fitted on labelled
texts that did not go into the dictionaries, makes it a probability. All blocks of a text count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varistrata.llm.common import bounded_ids, fold, labelled_texts, pieces, table, text_schema

#: Labelled texts of each class that are fitted on, and their bytes, at most: whole texts, all of whose parts count.
FIT_ROWS, FIT_BYTES = 1200, 8 << 20
DICTIONARY_BYTES = 98_304
BLOCK_BYTES = 1024
#: Size of the pieces into which labelled text is cut for training a dictionary; all pieces count.
SAMPLE_BYTES = 2048
LEVEL = 3
FOLDS, HELD = 3, 1
THRESHOLD = 0.5


def _dictionary(texts: list[bytes]) -> bytes:
    cut = [t[i : i + SAMPLE_BYTES] for t in texts for i in range(0, len(t), SAMPLE_BYTES)]
    samples = [cut[i] for i in np.random.default_rng(11).permutation(len(cut))]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples: all of the text itself
        return b"".join(samples)


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    slope: float = 0.0
    offset: float = 0.0

    def __post_init__(self):
        self._compress = None

    def __getstate__(self):
        return self.__dict__ | {"_compress": None}

    def compressors(self):
        if self._compress is None:
            made = []
            for content in (self.bad, self.good):
                known = zstandard.ZstdCompressionDict(content)
                known.precompute_compress(level=LEVEL)
                made.append(zstandard.ZstdCompressor(dict_data=known, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
            self._compress = made
        return self._compress

    def difference(self, text: str | None) -> float:
        """Bytes saved by the good dictionary over the bad one, for each byte of text; 0 for an empty text."""
        raw = (text or "").encode()
        if not raw or not self.good or not self.bad:
            return 0.0
        with_bad, with_good = self.compressors()
        view, saved = memoryview(raw), 0
        for i in range(0, len(raw), BLOCK_BYTES):
            block = view[i : i + BLOCK_BYTES]
            saved += len(with_bad(block)) - len(with_good(block))
        return saved / len(raw)

    def probability(self, difference: float) -> float:
        z = max(-500.0, min(500.0, self.slope * difference + self.offset))
        return 1.0 / (1.0 + math.exp(-z))


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of the weighted logistic curve, by Newton's method on x in units of its spread."""
    spread = float(x.std()) or 1.0
    design = np.c_[x / spread, np.ones(len(x))]
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - ridge * beta
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), gradient)
        step *= min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / spread), float(beta[1])


def fit_texts(texts: list[str | None], y: list[int], shares: tuple[float, float]) -> CompressionModel:
    """Dictionaries from two thirds of the texts, the curve from the others; shares: of the classes among all labels."""
    prior = shares[1] / sum(shares) if sum(shares) else 0.5
    flat = math.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    raw, y = [(t or "").encode() for t in texts], np.array(y, dtype=int)
    third = np.arange(len(raw)) % 3 == 2
    parts = [[r for r, c, out in zip(raw, y, third, strict=True) if c == k and r and not out] for k in (0, 1)]
    if not all(parts):
        return CompressionModel(b"", b"", 0.0, flat)
    model = CompressionModel(_dictionary(parts[1]), _dictionary(parts[0]))
    held = np.flatnonzero(third)
    if len(set(y[held].tolist())) < 2:
        held = np.arange(len(raw))
    x = np.array([model.difference(texts[i]) for i in held])
    counts = np.bincount(y[held], minlength=2)
    model.slope, model.offset = calibrate(x, y[held], np.array(shares)[y[held]] / counts[y[held]] * len(held) / sum(shares))
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", rows: int = FIT_ROWS, most_bytes: int = FIT_BYTES) -> CompressionModel:
    """From at most `rows` labelled texts of each class with most_bytes in all, those whose keys have the smallest hashes.

    Null labels don't count. Without texts of both classes (empty tables too) all texts get the share of label 1, 0.5 if there is none.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    shares = {r[label]: r["n"] for r in known.groupBy(label).agg(F.count("*").alias("n")).collect()}
    ids = [bounded_ids(known.where(F.col(label) == k), key, rows).withColumn("_y", F.lit(k)) for k in (0, 1)]
    found = sorted(labelled_texts(docs, ids[0].unionByName(ids[1]), "_y", most_bytes, key, text).collect(), key=lambda r: (str(r[key])[::-1], r["_y"]))
    return fit_texts([r[text] for r in found], [r["_y"] for r in found], (float(shares.get(0, 0)), float(shares.get(1, 0))))


def score(docs: DataFrame, model: CompressionModel, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted for each row. Null and empty texts have difference 0; repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, text):
            scores = [model.probability(model.difference(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select(key, text).mapInArrow(run, f"doc_id {text_schema(docs, key)}, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(fold("doc_id", FOLDS) != HELD))
    held_out = F.coalesce(fold("doc_id", FOLDS) == HELD, F.lit(False)).alias("held_out")
    return score(docs, model).select("doc_id", held_out, "score", "predicted")
