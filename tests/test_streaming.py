from lattice.streaming.ingest import EVENT, follow, latest


def test_latest_wins_and_repeats_change_nothing(spark):
    before = spark.createDataFrame([("a", "1", 1), ("b", "1", 5)], EVENT)
    events = spark.createDataFrame([("a", "2", 2), ("a", "3", 3), ("b", "0", 4), ("c", None, 1)], EVENT)
    once = {tuple(r) for r in latest(before, events).collect()}
    assert once == {("a", "3", 3), ("b", "1", 5), ("c", None, 1)}
    assert {tuple(r) for r in latest(latest(before, events), events).collect()} == once


def test_stream(spark, tmp_path):
    source = str(tmp_path / "events")
    for k, rows in enumerate(([("a", "1", 1)], [("a", "2", 2), ("b", "1", 1)])):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENT).parquet(source)
        query = follow(stream, str(tmp_path / "state"), str(tmp_path / "checkpoint"))
        query.processAllAvailable()
        query.stop()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "state" / "batch=1")).collect()} == {("a", "2", 2), ("b", "1", 1)}
