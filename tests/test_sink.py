"""The live table and stateful streams over restarts: replayed batches, timers, how many files stay."""

import random

import pytest
from pyspark.sql import functions as F

from castclip.operators import jobs
from castclip.streaming import sink, streams

from test_streaming import EVENT, at, events


def files(path):
    return [f for f in path.rglob("*") if f.is_file() and not f.name.startswith((".", "_"))]


def test_the_newest_row_stays_and_files_are_few(spark, tmp_path):
    table = sink.LiveTable(spark, str(tmp_path / "t"), ["job_id", "kind"], fan=3)
    with pytest.raises(ValueError):
        table.read()
    rng, want = random.Random(1), {}
    for n in range(14):
        rows = [(k, None if k % 2 else "x", f"s{n}", None if n % 2 else float(n)) for k in rng.sample(range(20), 6)]
        table.write(spark.createDataFrame(rows, "job_id long, kind string, step string, percent double").coalesce(1), n)
        want |= {r[:2]: r for r in rows}
        table.write(spark.createDataFrame([(99, "never", "replayed", 1.0)], "job_id long, kind string, step string, percent double"), rng.randrange(n + 1))
    assert {tuple(r)[:2]: tuple(r) for r in table.read().collect()} == want
    levels = [x for _, x in table.state()["parts"]]
    assert table.state()["last"] == 13 and len(table._lists()) == 2 and all(levels.count(x) < 3 for x in levels)
    # two lists of one line, and the folders that they name
    assert len(list((tmp_path / "t" / "parts").iterdir())) <= 2 * 3 * 2 and not list((tmp_path / "t" / "drafts").iterdir())


def test_a_second_writer_is_told(spark, tmp_path):
    one, two = (sink.LiveTable(spark, str(tmp_path / "t"), ["k"]) for _ in range(2))
    row = spark.createDataFrame([(1, "a")], "k int, v string")
    one.write(row, 0)
    old = two.state()
    one.write(row, 1)
    with pytest.raises(RuntimeError):
        two._commit({**old, "number": old["number"] + 1, "last": 1})
    assert two.state()["last"] == 1


def feed(spark, src, k, rows):
    part = src.parent / f"b{k}"
    spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(str(part))
    for f in part.glob("part-*"):
        f.rename(src / f"{k}-{f.name}")


def go(spark, src, here, make, write):
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = write(make(stream).writeStream).option("checkpointLocation", str(here / "c")).trigger(availableNow=True).start()
    q.awaitTermination()


def test_job_state_stays_up_over_restarts(spark, tmp_path):
    rows, src, out = events(), tmp_path / "in", str(tmp_path / "state")
    src.mkdir()
    write = lambda w: w.outputMode("update").foreachBatch(streams.upsert(out, ["job_id"], fan=2))
    for k in range(4):  # each round is a restart
        feed(spark, src, k, rows[k * 10 : k * 10 + 10])
        go(spark, src, tmp_path, jobs.job_state, write)
    want = {tuple(r) for r in jobs.job_state(spark.createDataFrame(rows, EVENT)).collect()}
    assert {tuple(r) for r in streams.latest(spark, out, ["job_id"]).collect()} == want
    # the last batch comes again, as after a crash between its commit here and the stream's own
    last = max((tmp_path / "c" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    last.unlink()
    for hidden in (tmp_path / "c" / "commits").glob(f".{last.name}.crc"):
        hidden.unlink()
    before = sink.LiveTable(spark, out, ["job_id"]).state()
    go(spark, src, tmp_path, jobs.job_state, write)
    assert sink.LiveTable(spark, out, ["job_id"]).state() == before
    assert {tuple(r) for r in streams.latest(spark, out, ["job_id"]).collect()} == want


def test_timers_come_back_after_a_restart(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    streams.keep_states_on_disk(spark)
    try:
        src, out = tmp_path / "in", str(tmp_path / "out")
        src.mkdir()
        write = lambda w: w.outputMode("append").format("parquet").option("path", out)
        make = lambda e: streams.stale_jobs_stream(e, 120.0, "10 seconds")
        feed(spark, src, 0, [(1, 1, "download", 1.0, at(0)), (2, 2, "download", 1.0, at(0)), (3, 3, "download", 1.0, at(0)), (4, 4, "done", 1.0, at(1))])
        go(spark, src, tmp_path, make, write)
        assert spark.read.schema("job_id long").parquet(out).count() == 0
        feed(spark, src, 1, [(5, 2, "done", 1.0, at(20)), (6, 3, "edit", 1.0, at(110)), (7, 9, "x", 1.0, at(200))])
        go(spark, src, tmp_path, make, write)
        assert [r["job_id"] for r in spark.read.parquet(out).collect()] == [1]
        feed(spark, src, 2, [(8, 9, "x", 1.0, at(300)), (9, 1, "again", 1.0, at(299))])
        go(spark, src, tmp_path, make, write)
        got = spark.read.parquet(out)
        assert sorted((r["job_id"], r["last"]) for r in got.collect()) == [(1, at(0)), (3, at(110))]
        assert {(r["status"], r["reason"]) for r in got.collect()} == {("failed", "no event within the limit")}
    finally:
        spark.conf.set(key, old)


def test_newest_event_decides_in_one_batch(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    streams.keep_states_on_disk(spark)
    try:
        rng = random.Random(4)
        rows = [(k, rng.randrange(12), rng.choice(("download", "edit", "done")), 1.0, at(rng.randrange(4000))) for k in range(60)] + [(99, 50, "edit", 1.0, at(4100))]
        src, out = tmp_path / "in", str(tmp_path / "out")
        src.mkdir()
        feed(spark, src, 0, rows)
        go(spark, src, tmp_path, lambda e: streams.stale_jobs_stream(e, 500.0, "0 seconds"), lambda w: w.outputMode("append").format("parquet").option("path", out))
        want = jobs.stale_jobs(spark.createDataFrame(rows, EVENT), F.lit(at(4100)), 500.0)
        assert sorted(r["job_id"] for r in spark.read.parquet(out).collect()) == sorted(r["job_id"] for r in want.collect())
    finally:
        spark.conf.set(key, old)
