from pyspark.sql import functions as F

from varistrata.plans import adapters as A
from varistrata.streaming import ingest


def test_chunks_are_appended_and_counted(spark, tmp_path):
    wide = A.wide(spark, "/root/testdata/sf0.01").withColumnsRenamed({c: c.replace("-", "_").replace(".", "_") for c in A.COLUMNS}).cache()
    names = [c for c in wide.columns if c != "eid"][:4]
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    wide.where("eid % 2 = 0").repartition(3).write.parquet(folder)
    for expected in (wide.where("eid % 2 = 0").count(), wide.count()):
        chunks = ingest.read_chunks(spark, folder, wide.schema, 2)
        ingest.append_subset(chunks, out, f"{tmp_path}/state", names, lambda d: d.withColumn("seen", F.lit(True))).awaitTermination()
        assert spark.read.parquet(out).count() == expected
        wide.where("eid % 2 = 1").write.mode("append").parquet(folder) if expected != wide.count() else None
    q = ingest.running_missing(ingest.read_chunks(spark, folder, wide.schema), names).writeStream.format("memory").queryName("missing").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["column"]: r["missing"] for r in spark.sql("select * from missing").collect()}
    want = wide.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in names]).first().asDict()
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}
