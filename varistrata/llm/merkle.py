"""A Merkle manifest of a dataset: a leaf for each row, a proof for each leaf, one root.

The rows of a source are a tree of their own (a node over every ARITY consecutive ones, the last run shorter), and the
sources' roots are one more tree. Rows are ranked by a range partitioning, so a source may hold any share of them. A
source is then cut into aligned blocks of ARITY ** BLOCK_HEIGHT leaves, each one group of bounded size. Inside
a block the proofs are emitted leaf after leaf by fractal traversal: for each layer of LAYER heights an existing
subtree is kept, which has the siblings of the present leaf, and the desired one that follows grows by a leaf a step.
The blocks' roots are the nodes of the next round (fewer by the block size), until a source is one node; the proofs
of these rounds are appended to those below.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varistrata.llm.common import Scratch, table

#: Children of a node, heights of a block (729 leaves) and of one stacked subtree in it.
ARITY, BLOCK_HEIGHT, LAYER = 3, 6, 2
#: The parts of sources (about 60 bytes each) are broadcast up to so many, beyond that joined by a shuffle.
BROADCAST_PARTS = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: For each height the digests of the run before and after the node, each put together.
PROOF = "array<struct<before: string, after: string>>"


def node(children: Iterable[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def height_of(n: int) -> int:
    """Heights above n nodes, until one is left."""
    out = 0
    while n > 1:
        n, out = -(-n // ARITY), out + 1
    return out


class Subtree:
    """One subtree under a node at height `high`, built leaf by leaf; digests at heights from `low` up are kept."""

    def __init__(self, leaves: Sequence[str], place: int, low: int, high: int):
        span = ARITY**high
        self.leaves, self.low, self.high = leaves, low, high
        self.at, self.end = place * span, min(len(leaves), (place + 1) * span)
        self.runs: list[list[str]] = [[] for _ in range(high)]
        self.kept: list[list[str]] = [[] for _ in range(high - low)]
        self.root: str | None = None

    def _put(self, height: int, digest: str) -> None:
        while height < self.high:
            if height >= self.low:
                self.kept[height - self.low].append(digest)
            run = self.runs[height]
            run.append(digest)
            if len(run) < ARITY:
                return
            digest = node(run)
            run.clear()
            height += 1
        self.root = digest

    def step(self) -> None:
        """One more leaf; after the last one, runs that are not full are closed."""
        if self.at >= self.end:
            return
        self._put(0, self.leaves[self.at])
        self.at += 1
        if self.at == self.end:
            for height in range(self.high):
                if run := self.runs[height]:
                    digest = node(run)
                    run.clear()
                    self._put(height + 1, digest)

    def whole(self) -> Subtree:
        while self.at < self.end:
            self.step()
        return self


def block_root(leaves: Sequence[str], height: int) -> str:
    return Subtree(leaves, 0, height, height).whole().root


def traverse(leaves: Sequence[str], height: int) -> Iterator[list[tuple[str, str]]]:
    """The proof of one leaf after the other up to `height`, as (digests before, digests after) for each height.

    Held at once: an existing and a desired subtree for each layer, about ARITY ** LAYER digests each.
    """
    layers = [(low, min(low + LAYER, height)) for low in range(0, height, LAYER)]
    existing = [Subtree(leaves, 0, *layer).whole() for layer in layers]
    desired = [Subtree(leaves, 1, *layer) for layer in layers]
    for place in range(len(leaves)):
        proof = []
        for (low, high), own in zip(layers, existing, strict=True):
            for k in range(low, high):
                at = place // ARITY**k % ARITY ** (high - k)
                first = at - at % ARITY
                run = own.kept[k - low][first : first + ARITY]
                proof.append(("".join(run[: at - first]), "".join(run[at - first + 1 :])))
        yield proof
        for i, (low, high) in enumerate(layers):
            desired[i].step()
            if (place + 1) % ARITY**high == 0:
                existing[i] = desired[i]
                desired[i] = Subtree(leaves, (place + 1) // ARITY**high + 1, low, high)


def leaf(*columns: Column) -> Column:
    """Digest of the columns: `-` if null, else the UTF-8 bytes of the value as text, a colon and the value."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, digest, lambda own, run: F.sha2(F.concat(run["before"], own, run["after"]).cast("binary"), 256))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings, height by height and from left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda run: F.concat(run["before"], run["after"])), "").cast("binary"), 256)


def tag(source: Column) -> Column:
    """A source as text that is never null and sorts as the sources do, null first."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def ranked(rows: DataFrame, by: str, order: Sequence[str], keep: Scratch) -> DataFrame:
    """rows with `_place` (from 0 in the order within `by`) and `_total` (rows of `by`).

    Rows are range-partitioned, sorted and numbered within their parts; where a group's part begins is summed from the
    parts before. No group is sorted in one task. The numbered rows are checkpointed, so a lost part comes back as it was.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = [F.col(c).asc_nulls_first() for c in (by, *order)]
    spread = rows.repartitionByRange(parts, *sort).sortWithinPartitions(*sort)
    fixed = keep(spread.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    counts = keep(fixed.groupBy(F.col(by).alias("_by"), F.col("_part").alias("_of")).agg(F.count("*").alias("_n"), F.min("_at").alias("_from")))
    whole = Window.partitionBy("_by")
    before = whole.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumns({"_start": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_total": F.sum("_n").over(whole)}).drop("_n")
    small = F.broadcast(starts) if counts.count() <= BROADCAST_PARTS else starts
    joined = fixed.join(small, (F.col(by) == F.col("_by")) & (F.col("_part") == F.col("_of")))
    return joined.withColumn("_place", F.col("_start") + F.col("_at") - F.col("_from")).drop("_by", "_of", "_part", "_at", "_from", "_start")


def _height(total: int, block_height: int) -> int:
    return min(block_height, height_of(total))


def _roots(nodes: DataFrame, block_height: int) -> DataFrame:
    """The roots of the blocks, as nodes of the next round."""

    def root(group: pa.Table) -> pa.Table:
        group = group.sort_by("_place")
        total = group["_total"][0].as_py()
        found = block_root(group["_digest"].to_pylist(), _height(total, block_height))
        cells = [(group["_tag"][0].as_py(), pa.string()), (group["_block"][0].as_py(), pa.int64()), (-(-total // ARITY**block_height), pa.int64()), (found, pa.string())]
        return pa.Table.from_arrays([pa.array([v], kind) for v, kind in cells], ["_tag", "_place", "_total", "_digest"])

    return _blocks(nodes, block_height).groupBy("_tag", "_block").applyInArrow(root, "_tag string, _place long, _total long, _digest string")


def _structs(proofs: list[list[tuple[str, str]]]) -> pa.Array:
    ends = [0]
    for proof in proofs:
        ends.append(ends[-1] + len(proof))
    sides = [pa.array([run[side] for proof in proofs for run in proof], pa.string()) for side in (0, 1)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(sides, ["before", "after"]))


def _blocks(nodes: DataFrame, block_height: int) -> DataFrame:
    return nodes.withColumn("_block", F.expr(f"_place div {ARITY**block_height}"))


def _proved(nodes: DataFrame, upper: DataFrame, payload: Sequence[str], block_height: int) -> DataFrame:
    """payload and _tag, _place, _proof, _subroot, _root of the nodes: block by block, what `upper` has for the block appended."""
    kept = [*payload, "_tag", "_place"]

    def prove(group: pa.Table, above: pa.Table) -> pa.Table:
        group = group.sort_by("_place")
        leaves = group["_digest"].to_pylist()
        rest = [(run["before"], run["after"]) for run in above["_proof"][0].as_py()]
        proofs = _structs([[*own, *rest] for own in traverse(leaves, _height(group["_total"][0].as_py(), block_height))])
        same = {c: pa.array([above[c][0].as_py()] * len(leaves), pa.string()) for c in ("_subroot", "_root")}
        return pa.table({c: group[c] for c in kept} | {"_proof": proofs} | same)

    schema = ", ".join([*[f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in kept], f"_proof {PROOF}", "_subroot string", "_root string"])
    above = upper.withColumnRenamed("_place", "_block").select("_tag", "_block", "_proof", "_subroot", "_root")
    return _blocks(nodes, block_height).groupBy("_tag", "_block").cogroup(above.groupBy("_tag", "_block")).applyInArrow(prove, schema)


def _rounds(nodes: DataFrame, block_height: int, keep: Scratch) -> list[DataFrame]:
    """The nodes, the roots of their blocks, and so on until every tag is one node (the last)."""
    out = [nodes.select("_tag", "_place", "_total", "_digest")]
    while True:
        out.append(keep(_roots(out[-1], block_height)))
        if out[-1].where("_total > 1").isEmpty():
            return out


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", source: str = "source", payload: dict[str, Column] | None = None, block_height: int = BLOCK_HEIGHT) -> DataFrame:
    """key, leaf, proof, subroot and root of each row, and the columns of `payload` (expressions on a row of docs).

    Leaves of a source are in the order of the key (null first; equal keys in the order of their leaves), so repeated rows
    have equal leaves and a place of their own each. Null is a source, the first one. A null or empty field has a text
    of its own in the leaf. An empty table gives no rows. Other columns of docs, whatever their names, don't count.
    """
    keep, passing = Scratch(), Scratch()
    named = {f"_p{i}": c for i, c in enumerate((payload or {}).values())}
    rows = docs.select(F.col(f"`{key}`").alias("_key"), tag(F.col(f"`{source}`")).alias("_tag"), leaf(*[F.col(f"`{f}`") for f in fields]).alias("_digest"), *[c.alias(n) for n, c in named.items()])
    leaves = ranked(rows, "_tag", ["_key", "_digest", *named], keep)
    own = _rounds(leaves, block_height, keep)
    # The subroots of all sources are one more tree, in the order of the sources.
    subroots = own[-1].select(F.lit("").alias("_tag"), F.col("_tag").alias("_source"), "_digest")
    over = ranked(subroots, "_tag", ["_source"], passing)
    shared = _rounds(over, block_height, passing)
    empty = F.expr(f"CAST(array() AS {PROOF})")
    above = shared[-1].select("_tag", "_place", empty.alias("_proof"), F.col("_digest").alias("_subroot"), F.col("_digest").alias("_root"))
    for nodes in reversed(shared[1:-1]):
        above = _proved(nodes, above, [], block_height)
    sources = _proved(over.withColumnRenamed("_digest", "_own").withColumn("_digest", F.col("_own")), above, ["_source", "_own"], block_height)
    above = keep(sources.select(F.col("_source").alias("_tag"), F.lit(0).cast("long").alias("_place"), "_proof", F.col("_own").alias("_subroot"), "_root"))
    passing.release()
    for nodes in reversed(own[1:-1]):
        above = _proved(nodes, above, [], block_height)
    out = _proved(leaves.withColumnRenamed("_digest", "_leaf").withColumn("_digest", F.col("_leaf")), above, ["_key", "_leaf", *named], block_height)
    return out.select(F.col("_key").alias(key), F.col("_leaf").alias("leaf"), F.col("_proof").alias("proof"), F.col("_subroot").alias("subroot"), F.col("_root").alias("root"), *[F.col(n).alias(c) for n, c in zip(named, payload or {}, strict=True)])


def query(spark, sf_dir: str) -> DataFrame:
    """Every row's proof, and what root it leads to after line breaks of every other row (by checksum) are deleted; a null key is never tampered with."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    cut = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    changed = leaf(*[cut if f == "text" else F.col(f) for f in FIELDS])
    rows = manifest(docs, payload={"changed": changed}).withColumn("folded_root", folded(F.col("changed"), F.col("proof")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: The trees as one list of nodes for each source and height; the checksum bit by bit.
ORACLE = r"""
WITH RECURSIVE f AS (SELECT *, list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text], lambda v: CASE WHEN v IS NULL THEN '-' ELSE concat(strlen(v), ':', v) END) AS parts FROM documents),
b AS (SELECT *, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295) AS crc FROM f),
l AS (SELECT doc_id, source, sha256(array_to_string(parts, '')) AS leaf,
 sha256(array_to_string(list_concat(parts[1:4], [CASE WHEN text IS NULL THEN '-' WHEN crc % 2 = 0 THEN concat(strlen(replace(text, chr(10), '')), ':', replace(text, chr(10), '')) ELSE parts[5] END]), '')) AS changed FROM b),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM l),
t(source, k, nodes) AS (SELECT source, 0, list(leaf ORDER BY place) FROM p GROUP BY source
 UNION ALL SELECT source, k + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1 : i + 3], ''))) FROM t WHERE len(nodes) > 1),
s AS (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS place FROM t WHERE len(nodes) = 1),
u(k, nodes) AS (SELECT 0, list(subroot ORDER BY place) FROM s
 UNION ALL SELECT k + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1 : i + 3], ''))) FROM u WHERE len(nodes) > 1),
r AS (SELECT nodes[1] AS root FROM u WHERE len(nodes) = 1),
runs AS (SELECT p.doc_id, p.leaf, p.changed, p.place AS own, p.source, 0 AS part, t.k, t.nodes, p.place // CAST(power(3, t.k) AS BIGINT) AS spot FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source WHERE len(t.nodes) > 1
 UNION ALL SELECT p.doc_id, p.leaf, p.changed, p.place, p.source, 1, u.k, u.nodes, s.place // CAST(power(3, u.k) AS BIGINT) FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source, u WHERE len(u.nodes) > 1),
sides AS (SELECT *, array_to_string(nodes[spot - spot % 3 + 1 : spot], '') AS before, array_to_string(nodes[spot + 2 : spot - spot % 3 + 3], '') AS after FROM runs),
proofs AS (SELECT doc_id, source, own, list({'a': before, 'b': after} ORDER BY part, k) AS steps FROM sides GROUP BY 1, 2, 3),
d AS (SELECT p.doc_id, p.leaf, p.changed, p.source, coalesce(steps, []) AS steps FROM p LEFT JOIN proofs q ON p.source IS NOT DISTINCT FROM q.source AND p.place = q.own),
e AS (SELECT *, list_reduce(list_concat([{'a': changed, 'b': ''}], steps), lambda x, y: {'a': sha256(concat(y.a, x.a, y.b)), 'b': ''}).a AS folded_root FROM d)
SELECT e.doc_id, e.leaf, s.subroot, r.root, sha256(array_to_string(list_transform(steps, lambda x: concat(x.a, x.b)), '')) AS proof_sha256, folded_root, folded_root = r.root AS verified
FROM e JOIN s ON e.source IS NOT DISTINCT FROM s.source, r
"""
