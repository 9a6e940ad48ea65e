"""Temperature mixing of sources.

Shares of tokens are raised to an exponent and normalised; the exponent is bisected to a target entropy or to a
limit on repetition. A source's weight of the budget is realised as whole epochs and a last part of one. The last
part takes the first cells of a permutation of the source's documents: a hash of the key, cut into LEVELS digits of
DIGIT_BITS bits, orders the cells, and level by level the cell in which the budget ends is found from sums alone.
Cells of the last level (about one document each) are taken whole. So no source is ever sorted or gathered, and
whether a row is taken is decided where the row lies.

`blocks` deals the uses of all documents into blocks of about BLOCK_TOKENS tokens, each with every source's weight of
it: a source's uses, epoch by epoch and permuted within each, fill its part of one block after the other, and within a
block all uses are permuted. Tokens before a use are summed cell by cell of the permutation.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varistrata.llm.common import Scratch, cut_lineage, salted_join, shared_folder, table

LEVELS, DIGIT_BITS = 3, 12
SEED = 31
REPEAT_LIMIT = 2.0
#: Tokens of a block.
BLOCK_TOKENS = 1 << 18
#: A catalogue of at most so many sources (about 10 MB) is weighed on the driver and broadcast; a larger one stays distributed.
DRIVER_SOURCES = 100_000


def weights(tokens: Sequence[float], exponent: float) -> np.ndarray:
    """Shares to the exponent, normalised; sources without tokens get 0."""
    n = np.asarray(tokens, dtype=float)
    log = np.where(n > 0, exponent * np.log(np.maximum(n, 1e-300)), -np.inf)
    if not (n > 0).any():
        return np.zeros(len(n))
    w = np.exp(log - log.max())
    return w / w.sum()


def entropy(w: np.ndarray) -> float:
    p = w[w > 0]
    return float(-(p * np.log(p)).sum())


def least_budget(tokens: Sequence[float], w: np.ndarray) -> float:
    """The least budget at which each source is used whole once or more."""
    n = np.asarray(tokens, dtype=float)
    return float(np.max(n[n > 0] / w[n > 0], initial=0.0))


def repetition(tokens: Sequence[float], w: np.ndarray, budget: float | None) -> float:
    """The most epochs of any source under the budget (None: the least that uses all)."""
    n = np.asarray(tokens, dtype=float)
    return float(np.max(w[n > 0] * (least_budget(n, w) if budget is None else budget) / n[n > 0], initial=0.0))


def bisect(within: Callable[[float], bool], steps: int = 60) -> float:
    """The smallest exponent from 0 (equal weights) to 1 (as they are) that is within; 1 if none is."""
    if within(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if within(middle) else (middle, high)
    return high


def bisect_exponent(tokens: Sequence[float], target_entropy: float | None = None, repeat_limit: float | None = None, budget: float | None = None, steps: int = 60) -> float:
    """The smallest exponent from 0 (equal weights) to 1 (as they are) that keeps within the limit or the target.

    Entropy and repetition fall as the exponent grows. If even 1 breaks the limit, 1 is what is left.
    """
    if (target_entropy is None) == (repeat_limit is None):
        raise ValueError("give a target entropy or a limit on repetition")
    if target_entropy is not None:
        return bisect(lambda e: entropy(weights(tokens, e)) <= target_entropy, steps)
    return bisect(lambda e: repetition(tokens, weights(tokens, e), budget) <= repeat_limit, steps)


class Totals:
    """Sums over a catalogue of sources of any size: each step of the bisection is one aggregate."""

    def __init__(self, sources: DataFrame):
        self.rows = sources.where("n > 0").select(F.log(F.col("n").cast("double")).alias("x"))
        self.least, self.most = (x or 0.0 for x in self.rows.agg(F.min("x"), F.max("x")).first())

    def sums(self, e: float) -> tuple[float, float]:
        """The logarithm of the sum of tokens to the exponent, and the mean logarithm of tokens under the weights."""
        scaled = F.exp((F.col("x") - F.lit(self.most)) * F.lit(e))
        total, mean = self.rows.agg(F.sum(scaled), F.sum(scaled * F.col("x"))).first()
        return (float(np.log(total)) + e * self.most, mean / total) if total else (0.0, 0.0)

    def entropy(self, e: float) -> float:
        log_sum, mean = self.sums(e)
        return log_sum - e * mean

    def least_budget(self, e: float) -> float:
        return float(np.exp((1 - e) * self.most + self.sums(e)[0]))

    def repetition(self, e: float, budget: float | None) -> float:
        return float(np.exp((1 - e) * (self.most - self.least))) if budget is None else budget * float(np.exp((e - 1) * self.least - self.sums(e)[0]))

    def exponent(self, target_entropy: float | None, repeat_limit: float | None, budget: float | None) -> float:
        return bisect(lambda e: self.entropy(e) <= target_entropy if target_entropy is not None else self.repetition(e, budget) <= repeat_limit)


def _tag(source: str) -> Column:
    """Null is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def _place(key: str, text: str, seed: int) -> Column:
    return F.xxhash64(F.coalesce(F.col(key).cast("string"), F.col(text)), F.lit(seed))


def _digit(place: Column, level: int) -> Column:
    return F.shiftrightunsigned(place, 64 - DIGIT_BITS * (level + 1)).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)).cast("int")


def attached(rows: DataFrame, catalogue: DataFrame, count: int, spread: str) -> DataFrame:
    """rows with what the catalogue has for their _tag; broadcast only within DRIVER_SOURCES, else dealt out by salts, since a source may hold any share of the rows."""
    return rows.join(F.broadcast(catalogue), "_tag") if count <= DRIVER_SOURCES else salted_join(rows, catalogue, ["_tag"], F.col(spread))


@dataclass
class Mixture:
    """What a source's rows need: weight, whole epochs, and the digits of the cell in which its budget ends."""

    exponent: float
    budget: float
    count: int
    #: _tag, n (tokens), _weight, _epochs, and one digit for each level (_end0, ...; -1: no further part).
    frame: DataFrame


def tokens_of(text: str) -> Column:
    """Words parted by white space; 0 of null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", repeat_limit: float | None = REPEAT_LIMIT, target_entropy: float | None = None, budget: float | None = None, seed: int = SEED) -> Mixture:
    """Weights and the cells in which budgets end. No budget: the least that uses every document once or more.

    Null is a source of its own. A source without tokens has weight 0 and each of its rows is used once. An empty table gives no sources.
    """
    cut = Scratch()
    narrow = cut(docs.select(_tag(source).alias("_tag"), tokens_of(text).alias("n"), _place(key, text, seed).alias("place")))
    sources = cut(narrow.groupBy("_tag").agg(F.sum("n").alias("n")))
    count = sources.count()
    totals = Totals(sources)
    limit = None if target_entropy is not None else repeat_limit
    if count <= DRIVER_SOURCES:
        exponent = bisect_exponent(sources.toArrow()["n"].to_numpy(), target_entropy, limit, budget)
    else:
        exponent = totals.exponent(target_entropy, limit, budget)
    total = totals.least_budget(exponent) if budget is None else float(budget)
    weight = F.when(F.col("n") > 0, F.exp(F.lit(exponent) * F.log(F.col("n").cast("double")) - F.lit(totals.sums(exponent)[0]))).otherwise(0.0)
    shared = sources.withColumn("_weight", weight).withColumn("_share", F.round(F.col("_weight") * F.lit(total)).cast("long"))
    shared = shared.withColumn("_epochs", F.when(F.col("n") > 0, F.expr("_share div n")).otherwise(1).cast("int"))
    state = cut(shared.withColumn("_rest", F.when(F.col("n") > 0, F.col("_share") - F.col("_epochs") * F.col("n")).otherwise(0)))
    # Level by level: the sums of the cells inside the cell of the level before, and the one in which the rest runs out.
    for level in range(LEVELS):
        ends = [f"_end{i}" for i in range(level)]
        cells = attached(narrow.withColumnRenamed("n", "_n"), state.where("_rest > 0").select("_tag", "_rest", *ends), count, "place")
        for i, end in enumerate(ends):
            cells = cells.where(_digit(F.col("place"), i) == F.col(end))
        sums = cells.groupBy("_tag", "_rest", _digit(F.col("place"), level).alias("cell")).agg(F.sum("_n").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy("_tag").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
        last = sums.withColumn("upto", upto).where("upto - _n < _rest and upto >= _rest and _n > 0").select("_tag", "cell", (F.col("upto") - F.col("_n")).alias("before"))
        found = state.join(last, "_tag", "left").withColumn(f"_end{level}", F.coalesce("cell", F.lit(-1))).withColumn("_rest", F.col("_rest") - F.coalesce("before", F.lit(0)))
        state = cut(found.drop("cell", "before"))
    cut.release(state)
    return Mixture(exponent, total, count, state.select("_tag", "n", "_weight", "_epochs", *[f"_end{i}" for i in range(LEVELS)]))


def _with_copies(rows: DataFrame, mixture: Mixture) -> DataFrame:
    """rows (with _tag and _place) and their weight and copies."""
    ends = [F.col(f"_end{i}") for i in range(LEVELS)]
    extra = F.lit(True)  # the cell in which the budget ends is taken too
    for i in reversed(range(LEVELS)):
        digit = _digit(F.col("_place"), i)
        extra = (digit < ends[i]) | ((digit == ends[i]) & extra)
    joined = attached(rows, mixture.frame.drop("n"), mixture.count, "_place")
    out = joined.withColumn("copies", F.col("_epochs") + F.coalesce(extra, F.lit(False)).cast("int")).withColumn("weight", F.col("_weight"))
    return out.drop("_epochs", "_weight", *[f"_end{i}" for i in range(LEVELS)])


def with_copies(docs: DataFrame, mixture: Mixture, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """docs with `weight` (of the row's source) and `copies` (how often the row is used); columns of those names are replaced.

    Nothing is shuffled but for a catalogue of over DRIVER_SOURCES. Rows without tokens get the whole epochs of their source. Rows with equal keys stand or fall together.
    """
    held = _with_copies(docs.select(_whole(docs), _tag(source).alias("_tag"), _place(key, text, seed).alias("_place")), mixture)
    return held.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns if c not in {"weight", "copies"}], "weight", "copies")


def _whole(docs: DataFrame) -> Column:
    """A row as one column, so that no name of docs meets one of the names used here."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")


def _dealt(rows: DataFrame, mixture: Mixture, of_row: list[str], block_tokens: int, seed: int) -> DataFrame:
    """rows (with _tag, _place, n_tokens and what tells a row) once for each use, with weight, copies, use, block and place. Written once, so all steps see the same uses."""
    used = cut_lineage(_with_copies(rows, mixture).where("copies > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("use")).withColumn("_spot", F.xxhash64("_place", "use", *of_row)))
    of_cell = ["_tag", "use", "_cell"]
    celled = used.withColumn("_cell", _digit(F.col("_spot"), 0))
    sums = celled.groupBy(*of_cell).agg(F.sum("n_tokens").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_tag").orderBy("use", "_cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.withColumn("_start", F.coalesce(before, F.lit(0))).drop("_n")
    own = F.sum("n_tokens").over(Window.partitionBy(*of_cell).orderBy("_spot", *of_row).rowsBetween(Window.unboundedPreceding, 0))
    placed = celled.withColumn("_own", own).join(starts, of_cell)
    last = _block_count(mixture, block_tokens) - 1
    filled = F.least(F.floor((F.col("_start") + F.col("_own") - F.col("n_tokens")) / (F.col("weight") * F.lit(block_tokens))), F.lit(last))
    dealt = placed.withColumn("block", F.when(F.col("weight") > 0, filled).otherwise(F.pmod("_spot", F.lit(last + 1))).cast("long"))
    within = Window.partitionBy("block").orderBy(F.xxhash64("_spot", F.lit(seed)), *of_row, "use")
    return dealt.withColumn("place", (F.row_number().over(within) - 1).cast("long"))


def _block_count(mixture: Mixture, block_tokens: int) -> int:
    return max(1, int(np.ceil(mixture.budget / block_tokens)))


def blocks(docs: DataFrame, mixture: Mixture, key: str = "doc_id", text: str = "text", source: str = "source", block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """doc_id, source, n_tokens, weight, copies, use (from 1), block and place (from 0 in the block) for each use of each row.

    A block has each source's weight of block_tokens tokens, up to the document that crosses its end; the last block
    may have less. Every source goes through its documents in another order for each use, and only then begins anew.
    Uses of sources without tokens are dealt out over all blocks. Repeated rows have uses of their own; which of them
    comes first depends on how the rows are stored. An empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), tokens_of(text).alias("n_tokens"), _tag(source).alias("_tag"), _place(key, text, seed).alias("_place"), F.monotonically_increasing_id().alias("_row"))
    return _dealt(rows, mixture, ["_row"], block_tokens, seed).select("doc_id", "source", "n_tokens", "weight", "copies", "use", "block", "place")


def _as_stored(docs: DataFrame) -> DataFrame:
    """docs as a table of files, which has a file and a place in it for each row: as it was read, or else written to the shared folder and read again."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        return docs
    path = f"{shared_folder(docs.sparkSession)}/mixing-{uuid.uuid4().hex}"
    docs.write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def mix(docs: DataFrame, mixture: Mixture, key: str = "doc_id", text: str = "text", source: str = "source", block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """The rows of docs, each as often as the mixture uses it, with the columns of docs, in the order of their blocks and places.

    Partitions hold whole blocks, ascending from partition to partition; within one, rows ascend by block and place, so
    files written of it are to be read from the first to the last. Blocks are dealt by keys, tokens and the places of
    rows in their files; texts are shuffled twice, to meet their places and to lie in their blocks. Rows that are not a
    table of files are written to the shared folder first. An empty table gives no rows.
    """
    stored = _as_stored(docs)
    meta = stored.metadataColumn("_metadata")
    of_row = {"_file": meta.getField("file_path"), "_row": meta.getField("row_index")}
    named = stored.select(_whole(stored), tokens_of(text).alias("n_tokens"), _tag(source).alias("_tag"), _place(key, text, seed).alias("_place"), *[c.alias(n) for n, c in of_row.items()])
    placed = _dealt(named.drop("_doc"), mixture, [*of_row], block_tokens, seed).select(*of_row, "block", "place")
    count = _block_count(mixture, block_tokens)
    parts = min(count, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = named.select("_doc", *of_row).join(placed, [*of_row])
    # Blocks have equal weights of tokens, so equal runs of them make equal partitions, without a sample of the rows.
    run = F.expr(f"int(block * {parts} div {count})")
    return met.select("_doc", "block", "place", run.alias("_part")).repartitionById(parts, "_part").sortWithinPartitions("block", "place").select("_doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return blocks(docs, fit(docs))
