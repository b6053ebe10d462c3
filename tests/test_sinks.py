"""Recording of streams: replays add nothing, and a source that fails ends alone."""

from pyspark.sql import functions as F

from signalmill.streaming import sinks


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1, "é"), ("s", 2, None)], "session_id string, tick long, text string")
    write = sinks.batch_writer(str(tmp_path / "out"))
    for _ in range(2):
        write(rows, 0)
    write(rows.limit(0), 1)
    write(rows.limit(1), 2)
    got = sinks.recorded(spark, str(tmp_path / "out"), rows.schema)
    assert got.count() == 3 and {r.text for r in got.collect()} == {"é", None}


def test_a_source_that_fails_ends_alone_and_goes_on_later(spark, tmp_path):
    for name in ("me", "them"):
        for i in range(3):
            spark.createDataFrame([(name, i)], "speaker string, tick long").coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def stream(name):
        return spark.readStream.schema("speaker string, tick long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))

    broken = stream("them").withColumn("tick", F.when(F.col("tick") >= 1, F.raise_error(F.lit("line is dead")).cast("long")).otherwise(F.col("tick")))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoints")
    failed = sinks.failures(sinks.merge_streams({"me": stream("me"), "them": broken}, out, checkpoint, once=True))
    assert failed.keys() == {"them"} and "line is dead" in failed["them"]
    schema = "speaker string, tick long"
    assert sorted((r.source, r.tick) for r in sinks.recorded(spark, out, schema).collect()) == [("me", 0), ("me", 1), ("me", 2), ("them", 0)]
    again = sinks.failures(sinks.merge_streams({"them": stream("them")}, out, checkpoint, once=True))
    assert not again
    assert sorted((r.source, r.tick) for r in sinks.recorded(spark, out, schema).collect()) == [(n, i) for n in ("me", "them") for i in range(3)]
