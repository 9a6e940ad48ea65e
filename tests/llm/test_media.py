import hashlib
import random
import zlib

from pyspark.sql import types as T

from varistrata.llm import media


def gear_plain(data):
    """Ends of the chunks, one byte at a time."""
    ends, start, h = [], 0, 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(media.GEAR[b])) % 2**32
        cut = h >> (32 - media.CUT_BITS) == 0
        if i + 1 - start >= media.LEAST and cut or i + 1 - start == media.MOST:
            ends.append(i + 1)
            start = i + 1
    return ends if ends and ends[-1] == len(data) else [*ends, len(data)]


def test_chunks_and_round_trip():
    rng = random.Random(4)
    for n in (1, 64, 1024, 5000, 100_000):
        data = bytes(rng.choice(b"abcdefgh \n") for _ in range(n))
        assert media.cuts(data) == gear_plain(data) and b"".join(media.chunks(data)) == data
        stored = media.container([(media.digest(c), media.squeeze(c)) for c in media.chunks(data)])
        assert media.read_back(stored) == data
    assert media.cuts(b"a" * 40_000)[0] <= media.MOST


def test_rows(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(5))
    base = " ".join(word() for _ in range(9000))
    rows = [(1, base, 1), (2, base, 2), (2, base, 2), (3, base[:30_000] + "x" + base[30_000:], 3), (4, None, 4), (5, "", 5), (None, "short", 6), (7, "a" * 64, 7), (8, " ".join(word() for _ in range(3000)), 8)]
    schema = T.StructType().add("doc_id", "long").add("text", "string").add("feature", "integer")
    got = media.media_features(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        padded = raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        stored = media.container([(media.digest(c), media.squeeze(c)) for c in media.chunks(padded)])
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert media.media_features(spark.createDataFrame([], schema)).count() == 0
    both = spark.createDataFrame(rows, schema)
    store = media.chunk_store(both)
    rebuilt = media.rebuild(media.recipes(both).groupBy("media").agg({"digests": "first"}).withColumnRenamed("first(digests)", "digests"), store)
    assert media.describe_frames(rebuilt).count() == 6 and store.count() < 35


def plain_frames(data):
    """Digests and frames of the chunks, by the byte-wise cutter and plain library calls."""
    import zstandard

    ends = gear_plain(data)
    parts = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    return [(hashlib.blake2b(c, digest_size=16).digest(), zstandard.ZstdCompressor(level=3, write_checksum=False).compress(c)) for c in parts]


def test_whole_table_by_brute_force(spark, tmp_path):
    import struct

    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    media.write_media(frame, f"{tmp_path}/store")
    got = media.read_media(spark, f"{tmp_path}/store").collect()
    assert len(got) == len(docs)
    for r in got:
        raw = docs[r.doc_id]
        padded = raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        if len(padded) < 30_000:
            frames = plain_frames(padded)
            stored = b"VCHK" + struct.pack("<I", len(frames)) + b"".join(d + struct.pack("<I", len(f)) for d, f in frames) + b"".join(f for _, f in frames)
            assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    counts = [spark.read.parquet(f"{tmp_path}/store/{t}").count() for t in ("own", "lists", "chunks")]
    assert counts[0] + counts[1] == len(docs) and min(counts) > 0


def test_a_damaged_store_is_noticed(spark, tmp_path):
    import pytest
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "same words again " * 200) for i in range(3)], "doc_id long, text string")
    media.write_media(docs, f"{tmp_path}/a")
    chunks = spark.read.parquet(f"{tmp_path}/a/chunks")
    other = media.squeeze(b"x" * 64)
    chunks.withColumn("frame", F.lit(other)).write.parquet(f"{tmp_path}/b/chunks")
    for t in ("own", "lists"):
        spark.read.parquet(f"{tmp_path}/a/{t}").write.parquet(f"{tmp_path}/b/{t}")
    assert media.read_media(spark, f"{tmp_path}/a").count() == 3
    with pytest.raises(Exception, match="differs from its digest"):
        media.read_media(spark, f"{tmp_path}/b").collect()
