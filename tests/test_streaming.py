import datetime
import random

from lumigraph.streaming.watch import flushes, relevant, stream_flushes, watch

AT = datetime.datetime(2024, 1, 1)


def fold(times, wait):
    out, first = [], None
    for t in sorted(times):
        if first is None or t >= first + wait:
            out.append([t, 0])
            first = t
        out[-1][1] += 1
    return [tuple(x) for x in out]


def test_flushes(spark):
    rng = random.Random(2)
    rows = [(k, rng.randint(0, 2000)) for k in "ab" for _ in range(60)]
    frame = spark.createDataFrame([(k, AT + datetime.timedelta(milliseconds=t)) for k, t in rows], "key string, ts timestamp")
    got = {}
    for r in flushes(frame, 300).orderBy("key", "first_ts").collect():
        assert r.flush_ts - r.first_ts == datetime.timedelta(milliseconds=300)
        got.setdefault(r.key, []).append((round((r.first_ts - AT).total_seconds() * 1000), r.n_events))
    assert got == {k: fold([t for x, t in rows if x == k], 300) for k in "ab"}
    assert flushes(frame.where("false")).isEmpty()
    assert flushes(frame.limit(1), 1).first().flush_ts - flushes(frame.limit(1), 1).first().first_ts == datetime.timedelta(milliseconds=50)


def test_stream_flushes(spark, tmp_path):
    src = str(tmp_path / "in")
    for i, ts in enumerate([[0, 100, 250], [400, 2500], [9000]]):
        spark.createDataFrame([("a", AT + datetime.timedelta(milliseconds=t)) for t in ts], "key string, ts timestamp").coalesce(1).write.parquet(f"{src}/{i}")
    for i in range(3):
        stream = spark.readStream.schema("key string, ts timestamp").parquet(f"{src}/*") if i == 2 else None
    query = stream_flushes(stream, 300, "0 seconds").writeStream.format("memory").queryName("flushed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got = sorted((round((r.first_ts - AT).total_seconds() * 1000), r.n_events) for r in spark.table("flushed").collect())
    assert got[:3] == [(0, 3), (400, 1), (2500, 1)]


def test_relevance_and_watch(spark, tmp_path):
    rows = spark.createDataFrame([("src/a.rs",), ("target/x",), (".git/HEAD",), (".lumigraph/1",), ("a/target/x",)], "path string")
    assert {r.path for r in relevant(rows).collect()} == {"src/a.rs", "a/target/x"}
    src, calls = str(tmp_path / "in"), []

    def reindex(full):
        calls.append(full)
        if len(calls) == 1:
            raise RuntimeError("disk")

    for path in ("src/a.rs", "target/x"):
        spark.createDataFrame([(path,)], "path string").coalesce(1).write.mode("append").parquet(src)
        events = spark.readStream.schema("path string").parquet(src)
        query = watch(events, reindex, str(tmp_path / "c"))
        try:
            query.processAllAvailable()
        except Exception as error:  # the first call fails, and the batch is read again
            assert "disk" in str(error)  # noqa: PT017
        query.stop()
    assert len(calls) == 2
