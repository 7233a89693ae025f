from pyspark.sql import functions as F

from weft.streaming import sessions


def test_session_memory_keeps_newest(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("s", t, 10) for t in range(5)] + [("r", 1, 99)], "s string, t long, n long").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("s string, t long, n long").parquet(str(src))
    q = sessions.session_memory(stream, "s", "t", "n", most_turns=3, most_chars=50).writeStream.format("memory").queryName("memory_out").outputMode("update").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r["session"]: tuple(r)[1:5] for r in spark.table("memory_out").collect()}
    assert got == {"s": (3, 30, 2, 4), "r": (0, 0, None, None)}


def test_incremental_runs_only_new_sources(spark, tmp_path):
    done, src = str(tmp_path / "done"), str(tmp_path / "src")
    spark.createDataFrame([(1, "h1", "old")], "id long, mark string, out string").write.parquet(done)
    spark.createDataFrame([(1, "h1"), (2, "h2")], "id long, mark string").write.parquet(src)
    stream = spark.readStream.schema("id long, mark string").parquet(src)
    q = sessions.incremental(stream, spark, done, ["id", "mark"], lambda df: df.withColumn("out", F.lit("new")), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.read.parquet(done).collect()) == [(1, "h1", "old"), (2, "h2", "new")]
