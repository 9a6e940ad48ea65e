"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) its letters' vectors,
each permuted (rolled) by its place; a text's vector bundles (adds) those of its n-grams, and a language's
prototype bundles its texts. A text gets the language whose prototype has the largest cosine with its vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varistrata.llm.common import fold, pieces, table, text_schema

DIMENSIONS = 512
SEED = 77_001
#: A trigram is three code points of so many bits in one long; all that is no letter is 0.
POINT_BITS = 21
UNDETERMINED = "und"
FOLDS = 5


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


class Letters:
    """A random vector for each letter of any script, drawn when the letter is first met; it depends on the letter alone."""

    def __init__(self):
        self.row = np.full(0x110000, -1, dtype=np.int32)
        #: The vectors, permuted by the place of a letter in its trigram.
        self.rolled = [np.zeros((0, DIMENSIONS), dtype=np.int8) for _ in range(3)]

    def rows(self, points: np.ndarray) -> np.ndarray:
        new = np.unique(points[self.row[points] < 0])
        if len(new):
            drawn = np.array([np.random.default_rng([SEED, c]).integers(0, 2, DIMENSIONS, dtype=np.int8) for c in new.tolist()]) * 2 - 1
            self.row[new] = len(self.rolled[0]) + np.arange(len(new))
            self.rolled = [np.concatenate([have, np.roll(drawn, k, axis=1)]) for have, k in zip(self.rolled, (2, 1, 0), strict=True)]
        return self.row[points]


@cache
def _items() -> Letters:
    return Letters()


def trigrams(text: str | None) -> np.ndarray:
    """Codes of the trigrams of letters, lower-cased, other runs as one blank; none without a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, dtype=np.int64)
    symbols = np.zeros(len(points) + 2, dtype=np.int64)
    symbols[1:-1] = np.where(letter, points, 0)
    symbols = symbols[np.r_[True, (symbols[1:] != 0) | (symbols[:-1] != 0)]]
    return symbols[:-2] << 2 * POINT_BITS | symbols[1:-1] << POINT_BITS | symbols[2:]


def bundle(codes: np.ndarray) -> np.ndarray:
    """The sum of the vectors of the n-grams, repeated ones as often as they occur."""
    kinds, counts = np.unique(codes, return_counts=True)
    out = np.zeros(DIMENSIONS)
    letters = _items()
    for i in range(0, len(kinds), 20_000):
        k = kinds[i : i + 20_000]
        points = np.stack([k >> 2 * POINT_BITS, k >> POINT_BITS & (1 << POINT_BITS) - 1, k & (1 << POINT_BITS) - 1])
        at = letters.rows(points.ravel()).reshape(3, -1)
        bound = letters.rolled[0][at[0]] * letters.rolled[1][at[1]]
        bound *= letters.rolled[2][at[2]]
        out += counts[i : i + 20_000].astype(np.float32) @ bound.astype(np.float32)
    return out


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Unit prototypes of all languages, from all given rows with a language and a letter.

    A task sends one vector for each language; Spark adds them, and only the sums reach the driver. Languages are a
    catalogue: one vector of DIMENSIONS numbers for each is held by the driver and every worker. An empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch, texts in pieces(batches, "_text", 1_500_000):
            codes: dict[str, list] = {}
            for name, value in zip(batch.column(1).to_pylist(), texts, strict=True):
                codes.setdefault(name, []).append(trigrams(value))
            for name, all_codes in codes.items():
                sums[name] = sums.get(name, 0) + bundle(np.concatenate(all_codes))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "v"])

    parts = docs.where(F.col(lang).isNotNull()).select(F.col(text).alias("_text"), F.col(lang).alias("_lang")).mapInArrow(run, "lang string, v array<double>")
    rows = parts.select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("v")).collect()
    sums = {}
    for r in rows:
        sums.setdefault(r.lang, np.zeros(DIMENSIONS))[r.pos] = r.v
    return {name: v / np.linalg.norm(v) for name, v in sorted(sums.items()) if v.any()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (the cosine, 0 if negative) for each row.

    A text that is null or has no letter, or any text where nothing was learned, gets `und` and 0.
    Of equal cosines the language first by name wins. Repeated rows stay.
    """
    names = list(prototypes)
    matrix = np.array([prototypes[n] for n in names]).reshape(len(names), DIMENSIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, text):
            found, scores = [], []
            for value in texts:
                codes = trigrams(value) if names else []
                vector = bundle(codes) if len(codes) else np.zeros(DIMENSIONS)
                norm = np.linalg.norm(vector)
                if norm == 0:
                    found.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                cosines = matrix @ vector / norm
                best = int(np.argmax(cosines))
                found.append(names[best])
                scores.append(float(min(1.0, max(0.0, cosines[best]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(key, text).mapInArrow(run, f"doc_id {text_schema(docs, key)}, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = fit(docs.where(fold("doc_id", FOLDS) != 0))
    scored = predict(docs, prototypes)
    return scored.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
