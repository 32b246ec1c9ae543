from helixframe.streaming import events

DATA = [("2024-01-01 00:00:00", "u"), ("2024-01-01 00:03:00", "u"), ("2024-01-01 00:20:00", "u"), ("2024-01-01 05:00:00", "w")]


def run(spark, tmp_path, make, name):
    spark.createDataFrame(DATA, "t string, k string").selectExpr("cast(t as timestamp) as ts", "k").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, k string").parquet(f"{tmp_path}/in")
    q = make(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
    q.processAllAvailable()
    q.stop()
    return [tuple(r) for r in spark.table(name).collect()]


def test_sessions(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: events.sessions(s, "ts", "k", "10 minutes", "1 minute"), "sess")
    assert sorted((r[0], r[3]) for r in got) == [("u", 1), ("u", 2)]


def test_first_per_key(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: events.first_per_key(s, "k", "ts", "1 hour"), "firsts")
    assert sorted(r[1] for r in got) == ["u", "w"]


def test_sliding_counts(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: events.sliding_counts(s, "ts", "k", "10 minutes", "5 minutes", "1 minute"), "slides")
    assert sum(r[2] for r in got if r[1] == "u") == 6
