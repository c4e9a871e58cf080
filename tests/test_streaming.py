from pyspark.sql import functions as F

from gavelspark.streaming.running import running_accuracy


def test_running_accuracy(spark, tmp_path):
    rows = [(1, 0, r"\boxed{A}", 0), (1, 0, r"\boxed{A}", 1), (1, 1, "none", 2), (2, 0, r"\boxed{B}", 700), (2, 1, r"\boxed{C}", 710), (9, 0, r"\boxed{A}", 3)]
    df = spark.createDataFrame(rows, "list_id long, k int, text string, s long").withColumn("arrived", F.timestamp_seconds("s")).drop("s")
    df.write.parquet(str(tmp_path / "in"))
    truth = spark.createDataFrame([(1, "A"), (2, "B")], "list_id long, chosen_answer string")
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = running_accuracy(stream, truth).writeStream.format("memory").queryName("running").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    got = sorted((r.answers, r.verdicts, r.right) for r in spark.table("running").collect())
    assert got == [(2, 1, 1), (2, 2, 1)]
