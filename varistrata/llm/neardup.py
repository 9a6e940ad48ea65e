"""Near-duplicates by SetSketch registers on word shingles.

A register is the truncated logarithm, in steps of BASE, of the least hash of a document's shingles, taken as an
exponential variable: registers of two sets are merged by the larger value and agree with a probability close to
the sets' similarity. Bands of registers give buckets. In each bucket all are compared with its hub, the member that shares most
buckets with others;
what is linked so forms components. Linked sets share one of their rarest shingles, and what is rarer in either isn't
shared (exact filters by prefix and place), so only documents that pass both with another component are then compared
across components, on their full sets, block by block of those with a common hub. A task gives back one link between two components at most, so no link
between components is left out and no group is expanded into all its pairs. A pair is compared by its joint likelihood
estimate from both sketches and the known sizes, and links are confirmed on the full sets.
Documents with equal sets are one from the start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from varistrata.llm.common import Scratch, cut_lineage, pieces, salted_join, table, text_schema
from varistrata.llm.media import SharedFilter, digest

BANDS, ROWS = 30, 5
BASE, SHIFT = 1.1, 40
#: Estimates this low are six standard errors below the least similarity of a link.
ESTIMATE_MARGIN = 0.2
#: Buckets of hashes in which shingle frequencies are counted, as a power of two.
COUNT_POWER = 18
#: Documents and shingles of a block; two blocks meet in a task.
BLOCK, BLOCK_SHINGLES = 64, 200_000
#: Words of a shingle: in general (and in the pipeline), and as the contract of the query has it.
WORDS_IN_SHINGLE, WORDS_IN_QUERY, PERCENT = 5, 4, 80
MULTIPLIERS = np.random.default_rng(909).integers(0, 1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Sorted distinct hashes of a text's shingles of k words; ASCII letters lower-cased, words parted by ASCII white space."""

    def __init__(self, k: int):
        self.k = k
        self.words: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        found = (text or "").encode().lower().split()
        n = len(found)
        if not n:
            return np.zeros(0, dtype=np.uint64)
        if len(self.words) > 300_000:
            self.words.clear()
        known, get = self.words, self.words.get
        hashes = np.empty(n, dtype=np.uint64)
        for i, w in enumerate(found):
            h = get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            hashes[i] = h
        size = min(self.k, n)
        out = np.full(n - size + 1, size, dtype=np.uint64)
        for j in range(size):
            out = (out ^ hashes[j : n - size + 1 + j]) * MIX
            out ^= out >> np.uint64(29)
        return np.unique(out)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers for each set; no set is empty."""
    out = np.empty((len(sets), len(MULTIPLIERS)), dtype=np.uint64)
    start = 0
    while start < len(sets):
        stop, held = start, 0
        while stop < len(sets) and (stop == start or held + len(sets[stop]) <= 16_384):
            held += len(sets[stop])
            stop += 1
        block = np.concatenate(sets[start:stop])
        offsets = np.cumsum([0, *map(len, sets[start : stop - 1])])
        hashed = np.empty_like(block)
        for i, m in enumerate(MULTIPLIERS):
            np.multiply(block, m, out=hashed)
            out[start:stop, i] = np.minimum.reduceat(hashed, offsets)
        start = stop
    least = -np.log1p(-(out.astype(np.float64) + 0.5) / 2.0**64)
    return np.clip(np.floor(SHIFT - np.log(least) / np.log(BASE)), 0, 255).astype(np.uint8)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """For each row and band its number and registers in one long."""
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.int64), (len(regs), BANDS)).copy()
    for j in range(ROWS):
        keys = keys << 8 | regs[:, j::ROWS].astype(np.int64)
    return keys


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of sketches from the numbers of larger, smaller and equal registers."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    p = lambda x: -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)
    best, found = np.full(len(a), -np.inf), np.zeros(len(a))
    for j in np.linspace(0, 1, 101):
        possible = j <= np.minimum(u / v, v / u) + 0.01
        up, down = np.clip(p(np.maximum(u - v * j, 0)), 1e-9, 1), np.clip(p(np.maximum(v - u * j, 0)), 1e-9, 1)
        value = np.where(possible, more * np.log(up) + less * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-9, 1)), -np.inf)
        better = value > best
        best, found = np.where(better, value, best), np.where(better, j, found)
    return found


def sketches(docs: DataFrame, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), n (distinct shingles), same (digest of the set), bands, regs for each row; empty sets have null for the last three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(k)
        for batch, texts in pieces(batches, "_text", 4_000_000):
            sets = [shingle(t) for t in texts]
            full = [s for s in sets if len(s)]
            regs = registers(full) if full else np.zeros((0, BANDS * ROWS), np.uint8)
            keys, at, rows = band_keys(regs).tolist(), 0, []
            for s in sets:
                rows.append((digest(s.tobytes()), keys[at], regs[at].tobytes()) if len(s) else (None, None, None))
                at += len(s) > 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.binary(), pa.list_(pa.int64()), pa.binary())))],
                ["doc_id", "th", "n", "same", "bands", "regs"],
            )

    chosen = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_th"), F.col(text).alias("_text"))
    return chosen.mapInArrow(run, f"doc_id {text_schema(docs, key)}, th long, n long, same binary, bands array<long>, regs binary")


def full_sets(docs: DataFrame, wanted: DataFrame, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """wanted (same, doc_id of one document that has the set, and more) with the shingles of the set.

    Only documents whose key hits a filter of bounded size are cut into shingles again; wrong hits fall out in the join.
    """
    keys = SharedFilter.of(wanted.select(F.col("doc_id").cast("string").cast("binary").alias("digest")).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(k)
        for batch in batches:
            hit = batch.filter(pa.array([d is not None and d.encode() in keys for d in batch.column(0).to_pylist()], pa.bool_()))
            for _, texts in pieces([hit], "_text", 4_000_000):
                sets = [shingle(t) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array([digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["same", "shingles"])

    found = docs.select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text")).mapInArrow(run, "same binary, shingles array<long>")
    return wanted.join(found.dropDuplicates(["same"]), "same")


@F.pandas_udf(T.DoubleType())
def _estimated(a, b, na, nb):
    import pandas as pd

    rows = lambda s: np.frombuffer(b"".join(s), dtype=np.uint8).reshape(len(s), BANDS * ROWS)
    return pd.Series(estimate(rows(a), rows(b), na.to_numpy(float), nb.to_numpy(float)))


def likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, c) whose sizes and sketches allow a link. sets: id, n, regs of all distinct sets."""
    side = lambda end: sets.select(F.col("id").alias(end), F.col("n").alias(f"n{end}"), F.col("regs").alias(f"r{end}"))
    sized = pairs.join(side("a"), "a").join(side("c"), "c").where(100 * F.least("na", "nc") >= percent * F.greatest("na", "nc"))
    return sized.where(_estimated("ra", "rc", "na", "nc") >= percent / 100 - ESTIMATE_MARGIN).select("a", "c")


def confirmed(pairs: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, c) that are links by their full sets (id, shingles)."""
    part = lambda end: shingles.select(F.col("id").alias(end), F.col("shingles").alias(f"s{end}"))
    both = pairs.join(part("a"), "a").join(part("c"), "c").withColumn("common", F.size(F.array_intersect("sa", "sc")))
    return both.where(100 * F.col("common") >= percent * (F.size("sa") + F.size("sc") - F.col("common"))).select("a", "c")


def prefixes(shingles: DataFrame, percent: int) -> DataFrame:
    """(id, component, n, s, most) for the rarest shingles of each set, enough that two linked sets share one.

    Sets that share percent % of their union share that much of either set, so of any fixed order of all shingles
    their first n - ceil(percent % of n) + 1 have one in common. The order is by frequency, counted in buckets of
    hashes (a table of fixed size), so the first ones are those that few sets have. What comes before the first common
    shingle isn't shared, so from there on a linked set has `most` shingles in all at most.
    """
    counted = shingles.select(F.explode("shingles").alias("s")).groupBy(F.col("s").bitwiseAND(F.lit((1 << COUNT_POWER) - 1)).alias("w")).agg(F.count("*").alias("v")).toArrow()
    counts = np.zeros(1 << COUNT_POWER, dtype=np.int32)
    counts[counted["w"].to_numpy()] = np.minimum(counted["v"].to_numpy(), 2**31 - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, most = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            rows = []
            for own in batch.column(3):
                s = own.values.to_numpy(zero_copy_only=False)
                c = counts[s & ((1 << COUNT_POWER) - 1)]
                first = np.lexsort((s, c))[: len(s) - (percent * len(s) + 99) // 100 + 1]
                places = np.flatnonzero(c[first] > 1)
                kept.append(s[first[places]])
                most.append((100 + percent) * (len(s) - places) // percent - len(s))
                rows.append(len(places))
            rows = pa.array(np.repeat(np.arange(len(rows)), rows))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(3)), pa.array(np.concatenate(kept), pa.int64()), pa.array(np.concatenate(most), pa.int64())], ["id", "component", "n", "s", "most"])

    return shingles.select("id", "component", "n", "shingles").mapInArrow(run, "id long, component long, n long, s long, most long").where(f"100 * most >= {percent} * n")


def across_components(rare: DataFrame) -> DataFrame:
    """id, n of the documents that may be linked to one of another component, from their rare shingles.

    Of two sets with a common shingle neither may be larger than the other's `most`. So of the two one at least has
    a `most` no less than its own size. Documents without that (much of them is like nothing else: copies of one text,
    changed so far that they have no link) need one that has it, and is no larger than their `most`.
    """
    whole = F.col("most") >= F.col("n")
    low, high = (lambda c: F.min(c), lambda c: F.max(c))
    shared = rare.groupBy("s").agg(low("component").alias("_low"), high("component").alias("_high"), low(F.when(whole, F.col("component"))).alias("_wlow"), high(F.when(whole, F.col("component"))).alias("_whigh"), low(F.when(whole, F.col("n"))).alias("_wleast")).where("_low != _high and _wlow is not null")
    other = (F.col("_wlow") != F.col("component")) | (F.col("_whigh") != F.col("component"))
    return rare.join(shared, "s").where(whole | (other & (F.col("_wleast") <= F.col("most")))).select("id", "n").distinct()


def block_pairs(members: DataFrame, percent: int, cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame | None:
    """pair, id, component: which documents meet in which task, from distinct (hub, id, component, n); None where there are none.

    A hub's documents fall into rings by size, linked ones in the same or the next; in a ring a large component
    has blocks of its own and the others share blocks, of about BLOCK documents and BLOCK_SHINGLES shingles at most each.
    Blocks of one component never meet, since they hold nothing that is not known.
    """
    if members.isEmpty():
        return None
    ringed = members.withColumn("ring", F.floor(F.log("n") / float(-np.log(percent / 100)) + 1e-9).cast("int"))
    of = ["hub", "ring", "component"]
    counted = cut(ringed.groupBy(*of).agg(F.count("*").alias("own"), F.sum("n").alias("size")))
    kinds = counted.withColumn("kind", F.when((F.col("own") >= BLOCK) | (F.col("size") >= BLOCK_SHINGLES), F.col("component")))
    blocks = cut(kinds.groupBy("hub", "ring", "kind").agg(F.sum("own").alias("held"), F.sum("size").alias("size")).withColumn("blocks", F.greatest(F.ceil(F.col("held") / BLOCK), F.ceil(F.col("size") / BLOCK_SHINGLES)).cast("int")))
    large = cut(kinds.where("kind is not null").select(*of, F.lit(True).alias("large")))
    placed = ringed.join(large, of, "left").withColumn("kind", F.when(F.col("large"), F.col("component"))).drop("large")
    x, y = placed.alias("x"), blocks.alias("y")
    placed = cut(x.join(y, (F.col("x.hub") == F.col("y.hub")) & (F.col("x.ring") == F.col("y.ring")) & F.col("x.kind").eqNullSafe(F.col("y.kind"))).select("x.*", F.struct("x.ring", "x.kind", F.pmod(F.xxhash64("x.id"), F.col("y.blocks")).alias("no")).alias("block")))
    numbered = blocks.select("hub", "ring", "kind", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("no"))
    each = numbered.select("hub", F.struct("ring", "kind", F.col("no").cast("long").alias("no")).alias("block"))
    p, q = each.select("hub", F.col("block").alias("p")), each.select(F.col("hub").alias("_hub"), F.col("block").alias("q"))
    known = F.col("p.kind").isNotNull() & (F.col("p.kind") == F.col("q.kind"))
    meet = p.join(q, (F.col("hub") == F.col("_hub")) & (F.col("p") <= F.col("q")) & (F.abs(F.col("p.ring") - F.col("q.ring")) <= 1) & ~F.coalesce(known, F.lit(False)))
    meet = meet.select("hub", "p", "q", F.xxhash64("hub", "p", "q").alias("pair"))
    sides = cut(meet.select("hub", F.col("p").alias("block"), "pair").unionByName(meet.where("p != q").select("hub", F.col("q").alias("block"), "pair")))
    return placed.join(sides, ["hub", "block"]).select("pair", "id", "component")


def _links_in_block(percent: int):
    def run(group: pa.Table) -> pa.Table:
        component = group.column("component").to_numpy()
        sets = group.column("shingles").combine_chunks()
        sizes = np.diff(sets.offsets.to_numpy())
        _, column = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        row = np.repeat(np.arange(len(component)), sizes)
        often = np.bincount(column) > 1
        dense = np.cumsum(often) - 1
        row, column = row[often[column]], dense[column[often[column]]]
        common = np.zeros((len(component), len(component)), dtype=np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for start in range(0, int(often.sum()), 8192):
            a, b = np.searchsorted(column, [start, start + 8192])
            held = np.zeros((len(component), 8192), dtype=np.float32)
            held[row[a:b], column[a:b] - start] = 1
            common += held @ held.T
        i, j = np.nonzero((100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)) & (component[:, None] < component[None, :]))
        # One link between two components says all; they are named here.
        pairs = np.unique(np.stack([component[i], component[j]]), axis=1)
        return pa.table({"a": pa.array(pairs[0], pa.int64()), "c": pa.array(pairs[1], pa.int64())})

    return run


def components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """id and component (its least id) of all ends of the edges: labels fall to the least of the neighbours', then to the label's label."""
    both = cut(edges.select("a", "c").unionByName(edges.select(F.col("c").alias("a"), F.col("a").alias("c"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("c")).alias("component")))
    while True:
        heard = both.join(labels.select(F.col("id").alias("a"), "component"), "a").select(F.col("c").alias("id"), "component")
        lower = cut(labels.unionByName(heard).groupBy("id").agg(F.min("component").alias("component")))
        jumped = lower.join(lower.select(F.col("id").alias("component"), F.col("component").alias("_next")), "component", "left")
        after = cut(jumped.select("id", F.coalesce("_next", "component").alias("component")))
        changed = after.join(labels.withColumnRenamed("component", "_before"), "id").where(F.col("component") != F.col("_before")).limit(1).count()
        labels = after
        if not changed:
            return labels


def grouped(docs: DataFrame, k: int, percent: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, th, n for each row, with top: key and hash of the text (doc_id, th) of the first row of its group, null where it is linked with nothing.

    A distinct set has a number of its own, so rows that share a key but not a text are told apart.
    """
    cut = Scratch()
    rows = cut(sketches(docs, k, key, text))
    linkable = "same is not null and doc_id is not null"
    least = F.min(F.struct("doc_id", "th")).alias("least")
    sets = cut(rows.where(linkable).groupBy("same").agg(least, F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("regs").alias("regs")).withColumn("id", F.monotonically_increasing_id()))
    known_by = sets.select("id", "same", F.col("least.doc_id").alias("doc_id"))
    entries = sets.select("id", F.explode("bands").alias("b"))
    buckets = cut(entries.groupBy("b").agg(F.count("*").alias("members")).where("members > 1"))
    shared = cut(entries.join(buckets, "b"))
    # A bucket's hub is its member with the most company over all bands: of copies of a text, the one changed least.
    company = F.sum("members").over(Window.partitionBy("id"))  # a document has BANDS rows at most
    ranked = shared.select("b", F.struct((-company).alias("_less"), F.col("id").alias("first")).alias("_rank"))
    hubs = cut(ranked.groupBy("b").agg(F.min("_rank").alias("_rank")).select("b", F.col("_rank.first").alias("first")))
    members = cut(shared.select("b", "id").join(hubs, "b"))
    narrow = sets.select("id", "n", "regs")
    stars = cut(likely(members.where("id != first").select(F.least("first", "id").alias("a"), F.greatest("first", "id").alias("c")).distinct(), narrow, percent))
    ends = cut(stars.select("a").unionByName(stars.select(F.col("c").alias("a"))).distinct().select(F.col("a").alias("id")).join(known_by, "id"))
    links = cut(confirmed(stars, cut(full_sets(docs, ends, k, key, text).select("id", "shingles")), percent))
    labels = components(links, cut)
    # Buckets whose members are not all in one component: what may link across components, by the rarest shingles. Hubs have been compared.
    known = cut(members.join(labels, "id", "left").select("b", "first", "id", F.coalesce("component", "id").alias("component")))
    mixed = cut(known.groupBy("b").agg(F.min("component").alias("_low"), F.max("component").alias("_high"), F.count("*").alias("_n")).where("_low != _high and _n > 2").select("b"))
    left = cut(known.where("id != first").join(mixed, "b").select("id", "component").distinct().join(known_by, "id"))
    shingles = cut(full_sets(docs, left, k, key, text).select("id", "component", F.size("shingles").cast("long").alias("n"), "shingles"))
    rare = cut(prefixes(shingles, percent))
    active = cut(across_components(rare))
    groups = cut(known.where("id != first").select(F.col("first").alias("hub"), "id", "component").distinct().join(active, "id"))
    split = cut(groups.groupBy("hub").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low != _high").select("hub"))
    tasks = block_pairs(salted_join(groups, split, ["hub"], F.col("id")), percent, cut)
    merged = None
    if tasks is not None:
        met = tasks.join(shingles.select("id", "shingles"), "id")
        across = cut(met.groupBy("pair").applyInArrow(_links_in_block(percent), "a long, c long").distinct())
        if not across.isEmpty():
            merged = components(across, cut).select(F.col("id").alias("_own"), F.col("component").alias("_merged"))
    # A group is known by its first row; a group may have any number of sets, so its name is dealt out by salts.
    named = sets.select("id", "same", "least").join(labels, "id", "left")
    if merged is not None:
        named = named.withColumn("_own", F.coalesce("component", "id")).join(merged, "_own", "left").withColumn("component", F.coalesce("_merged", "component"))
    named = cut(named.select("id", "same", "least", "component"))
    tops = cut(named.where("component is not null").groupBy("component").agg(F.min("least").alias("top")))
    joined = salted_join(named.where("component is not null"), tops, ["component"], F.col("id")).select("same", "top")
    named = cut(joined.unionByName(named.where("component is null").select("same", F.col("least").alias("top"))))
    cut.release(rows, named)
    linked = rows.where(linkable).join(named, "same").select("doc_id", "th", "n", "top")
    alone = rows.where(f"not ({linkable})").select("doc_id", "th", "n").withColumn("top", F.lit(None).cast(linked.schema["top"].dataType))
    return linked.unionByName(alone)


def near_duplicates(docs: DataFrame, k: int = WORDS_IN_SHINGLE, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row; the key may have any type that has an order.

    Texts that are null, empty or blank are linked with nothing. A row without key is linked with nothing, has
    component null and is kept. Repeated rows stay, with equal values. Rows that share a key but not a text are
    documents of their own, each with its own links.
    """
    own = grouped(docs, k, percent, key, text).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("top.doc_id", "doc_id").alias("component_id"))
    return own.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, k: int = WORDS_IN_SHINGLE, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that stand for their group: those of its least key (of several texts with that key, one).

    Rows without key stay, and so do rows with null, empty or blank texts. Rows with equal keys and texts are one
    document: they stay or go together. An empty table gives no rows.
    """
    gone = grouped(docs, k, percent, key, text).where("top is not null and (doc_id != top.doc_id or th != top.th)")
    gone = gone.select(F.col("doc_id").alias("_gone"), F.col("th").alias("_gone_th")).distinct()
    # A row is one column, so that no name of docs meets one of these.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(f"`{key}`").alias("_key"), F.xxhash64(F.col(f"`{text}`")).alias("_th"))
    return rows.join(gone, (F.col("_key") == F.col("_gone")) & (F.col("_th") == F.col("_gone_th")), "left_anti").select("_doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), WORDS_IN_QUERY, PERCENT)
