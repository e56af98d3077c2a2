from pyspark.sql import functions as F

from topicloom.streaming.topics import windowed_counts

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_stream_counts_as_the_table_does(spark, tmp_path):
    table = spark.read.parquet(EVENTS)
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")).withColumnRenamed("event_type", "topic")
    q = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("topic_counts").start()
    q.processAllAvailable()
    q.stop()
    want = table.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("start"), F.col("event_type").alias("topic")).count()
    assert sorted(map(tuple, spark.table("topic_counts").collect())) == sorted(map(tuple, want.collect()))
