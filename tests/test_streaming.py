from pyspark.sql import functions as F

from strandloom.streaming import pairing


def test_pairs_meet_in_a_stream(spark, tmp_path):
    rows = [(t, e, t * 10 + e, 1_700_000_000 + t * 60 + e) for t in range(20) for e in (1, 2) if not (t % 5 == 0 and e == 2)]
    df = spark.createDataFrame(rows, "template long, end_no int, rec long, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = pairing.stream_pairs(stream).writeStream.format("memory").queryName("paired").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got = sorted(r.template for r in spark.sql("select * from paired").collect())
    assert got == [t for t in range(20) if t % 5]
