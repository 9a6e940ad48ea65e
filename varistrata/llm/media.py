"""Media columns with content-defined chunks.

A payload is cut where a rolling gear hash has zero high bits, so equal passages give equal chunks. Chunks are
stored once each, found by digest with Spark joins; the ordered chunk list of a payload rebuilds it, and every
chunk and the whole are verified.

A store is a folder of three tables: `chunks` (digest and frame of each chunk that several payloads have), `lists`
(the ordered chunk lists of payloads with such a chunk) and `own` (the whole stored form of all others). Which digests
are shared is counted from digests alone; a Bloom filter of bounded size over the shared ones routes the rows, so only
what is shared is shuffled. Wrong hits of a full filter only send more rows to `chunks`. Features are computed from
what is read back from the folder.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varistrata.llm.common import cut_lineage, pieces, shared_folder, table, text_schema

UNIT = 64
LEAST, MOST, CUT_BITS = 1024, 16384, 12
LEVEL = 3
MAGIC = b"VCHK"
#: Bits of a filter for each key, least and most bits as powers of two (2**28 bits are 32 MB), and hashes that set one each.
FILTER_BITS, FILTER_POWERS, FILTER_HASHES = 16, (12, 28), 2
GEAR = np.random.default_rng(4242).integers(0, 1 << 32, size=256, dtype=np.uint64).astype(np.uint32)


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks. The hash at a byte covers the 32 bytes up to it, each shifted by its distance."""
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    for s in (1, 2, 4, 8, 16):
        wider = h.copy()
        wider[s:] += h[:-s] << np.uint32(s)
        h = wider
    ends, start = [], 0
    for c in (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist():
        while c - start > MOST:
            start += MOST
            ends.append(start)
        if c - start >= LEAST:
            ends.append(c)
            start = c
    while len(data) - start > MOST:
        start += MOST
        ends.append(start)
    if start < len(data):
        ends.append(len(data))
    return ends


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


@cache
def _codecs():
    return zstandard.ZstdCompressor(level=LEVEL, write_checksum=False).compress, zstandard.ZstdDecompressor().decompress


def squeeze(data: bytes) -> bytes:
    return _codecs()[0](data)


def expand(frame: bytes) -> bytes:
    return _codecs()[1](frame)


def container(frames: list[tuple[bytes, bytes]]) -> bytes:
    """The stored form of a payload: its ordered list of chunks (digest, size of the frame) and then their frames."""
    head = b"".join(d + struct.pack("<I", len(f)) for d, f in frames)
    return MAGIC + struct.pack("<I", len(frames)) + head + b"".join(f for _, f in frames)


def unpack(stored: bytes) -> list[tuple[bytes, bytes]]:
    if stored[:4] != MAGIC:
        raise ValueError("not a stored media payload")
    n = struct.unpack_from("<I", stored, 4)[0]
    at, out = 8 + 20 * n, []
    for i in range(n):
        size = struct.unpack_from("<I", stored, 24 + 20 * i)[0]
        out.append((stored[8 + 20 * i : 24 + 20 * i], stored[at : at + size]))
        at += size
    return out


def read_back(stored: bytes) -> bytes:
    """The payload, each chunk checked against its digest."""
    parts = []
    for d, frame in unpack(stored):
        raw = expand(frame)
        if digest(raw) != d:
            raise ValueError("a stored chunk differs from its digest")
        parts.append(raw)
    return b"".join(parts)


RESULT = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def described(stored: bytes) -> tuple:
    """What RESULT names, from the stored bytes alone."""
    data = read_back(stored)
    samples = np.frombuffer(data, dtype=np.uint8)
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    mean = float(counts @ np.arange(256)) / len(samples)
    feature = f"chunks={struct.unpack_from('<I', stored, 4)[0]};mean={mean:.4f};entropy={abs(float(-(share * np.log2(share)).sum())):.4f};zeros={int(counts[0])}"
    return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature


def _result_arrays(rows: list[tuple]) -> list[pa.Array]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]


RESULT_NAMES = [x.split()[0] for x in RESULT.split(", ")]


class SharedFilter:
    """Bloom filter over digests, of bounded size; the JVM and Python use the same hashes. A fuller one only hits too often."""

    def __init__(self, power: int, at: np.ndarray, words: np.ndarray):
        self.power = power
        self.words = np.zeros(1 << (power - 5), dtype=np.uint32)
        self.words[at] = words

    def __contains__(self, d: bytes) -> bool:
        h = xxhash.xxh64_intdigest(d, seed=42)
        for k in range(FILTER_HASHES):
            bit = h >> (self.power * k) & ((1 << self.power) - 1)
            if not int(self.words[bit >> 5]) >> (bit & 31) & 1:
                return False
        return True

    @staticmethod
    def of(digests: DataFrame) -> SharedFilter:
        """Sized by the number of keys; at most 2**28 bits, as at most 2**23 words, come to the driver, whatever the input."""
        power = int(np.ceil(np.log2(max(1, FILTER_BITS * digests.count()))))
        power = min(max(power, FILTER_POWERS[0]), FILTER_POWERS[1])
        h = F.xxhash64("digest")
        bits = F.array(*[F.shiftrightunsigned(h, power * k).bitwiseAND(F.lit((1 << power) - 1)) for k in range(FILTER_HASHES)])
        each = digests.select(F.explode(bits).alias("b"))
        words = each.groupBy(F.shiftright("b", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(b & 31))")).alias("v"))
        found = words.toArrow()
        return SharedFilter(power, found["w"].to_numpy(), found["v"].to_numpy().astype(np.uint32))


def recipes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (digest of the payload) and digests (of its chunks in order) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, text):
            data = [payload(t) for t in texts]
            size = [len((t or "").encode()) for t in texts]
            parts = [[digest(c) for c in chunks(d)] for d in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array([digest(d) for d in data], pa.binary()), pa.array(parts, pa.list_(pa.binary()))], ["doc_id", "n_bytes", "media", "digests"])

    return docs.select(key, text).mapInArrow(run, f"doc_id {text_schema(docs, key)}, n_bytes long, media binary, digests array<binary>")


def chunk_store(docs: DataFrame, shared: SharedFilter | None = None, text: str = "text") -> DataFrame:
    """digest and frame of each distinct chunk, of all rows or of those with a chunk in the filter. Null and empty texts have the chunk of one unit of zeros; an empty table has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in pieces(batches, text, 2_000_000):
            found: dict[bytes, bytes] = {}
            for t in texts:
                own = [(digest(c), c) for c in chunks(payload(t))]
                if shared is None or any(d in shared for d, _ in own):
                    found.update((d, squeeze(c)) for d, c in own if d not in found)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], ["digest", "frame"])

    return docs.select(text).mapInArrow(run, "digest binary, frame binary").groupBy("digest").agg(F.first("frame").alias("frame"))


def rebuild(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """media and its frames in order, from distinct (media, digests) rows and the store. A list is as long as its payload at most; repeated chunks of a payload come back at each of their places."""
    refs = wanted.select("media", F.posexplode("digests").alias("pos", "digest"))
    return refs.join(store, "digest").groupBy("media").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "frame"))).alias("frames"))


def describe_frames(rebuilt: DataFrame) -> DataFrame:
    """media and RESULT; stops if the payload isn't the one that the digest names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media, frames in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                stored = container([(f["digest"], f["frame"]) for f in frames])
                if digest(read_back(stored)) != media:
                    raise ValueError("a rebuilt payload differs from its digest")
                rows.append(described(stored))
            yield pa.RecordBatch.from_arrays([batch.column(0), *_result_arrays(rows)], ["media", *RESULT_NAMES])

    return rebuilt.select("media", "frames").mapInArrow(run, f"media binary, {RESULT}")


def having_shared(known: DataFrame, shared: SharedFilter) -> DataFrame:
    """Rows of recipes with a digest that hits the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("digests")).to_pylist()
            yield batch.filter(pa.array([any(d in shared for d in digests) for digests in column], pa.bool_()))

    return known.mapInArrow(run, known.schema)


def write_media(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> None:
    """The store of all payloads, in a new folder that all executors share."""
    known = cut_lineage(recipes(docs, key, text))
    distinct = known.groupBy("media").agg(F.first("digests").alias("digests"))
    often = distinct.select(F.explode(F.array_distinct("digests")).alias("digest")).groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    repeated = known.groupBy("media").agg(F.count("*").alias("n"), F.first("digests").alias("digests")).where("n > 1").select(F.explode("digests").alias("digest"))
    shared = SharedFilter.of(often.select("digest").unionByName(repeated))

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, text, 2_000_000):
            keep, size, stored = [], [], []
            for t in texts:
                own = [(digest(c), c) for c in chunks(payload(t))]
                keep.append(not any(d in shared for d, _ in own))
                if keep[-1]:
                    size.append(len((t or "").encode()))
                    stored.append(container([(d, squeeze(c)) for d, c in own]))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), pa.array(size, pa.int64()), pa.array(stored, pa.binary())], ["doc_id", "n_bytes", "stored"])

    plain = {"compression": "none", "parquet.enable.dictionary": "false", "parquet.block.size": str(8 << 20)}  # frames are compressed; a task holds one row group
    docs.select(key, text).mapInArrow(alone, f"doc_id {text_schema(docs, key)}, n_bytes long, stored binary").write.options(**plain).parquet(f"{folder}/own")
    chunk_store(docs, shared, text).write.options(**plain).parquet(f"{folder}/chunks")
    having_shared(known, shared).write.parquet(f"{folder}/lists")


def read_media(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_bytes and RESULT for each row of a store; each chunk is checked against its digest, each rebuilt payload too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *_result_arrays([described(x.as_py()) for x in batch.column(2)])], ["doc_id", "n_bytes", *RESULT_NAMES])

    own, lists = spark.read.parquet(f"{folder}/own"), spark.read.parquet(f"{folder}/lists")
    in_place = own.mapInArrow(run, f"doc_id {text_schema(own, 'doc_id')}, n_bytes long, {RESULT}")
    described_once = cut_lineage(describe_frames(rebuild(lists.groupBy("media").agg(F.first("digests").alias("digests")), spark.read.parquet(f"{folder}/chunks"))))
    return in_place.unionByName(lists.select("doc_id", "n_bytes", "media").join(described_once, "media").select("doc_id", "n_bytes", *RESULT_NAMES))


def media_features(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """doc_id, n_bytes and RESULT for each row, from a store in the folder (a new one in the shared folder, if none is named).

    Null and empty texts are payloads of one unit of zeros; repeated rows stay; an empty table gives no rows.
    """
    folder = folder or f"{shared_folder(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    write_media(docs, folder, key, text)
    return read_media(docs.sparkSession, folder)


def query(spark, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))
