"""Streams over small files."""

import datetime

from codeloom.streaming import changes


def test_change_sets_of_a_stream(spark, tmp_path):
    state = {"stored": spark.createDataFrame([], "path string, sha256 string"), "seen": []}

    def write(ch, table, batch):
        state["seen"].append((batch, sorted(r.status for r in ch.collect())))
        state["stored"] = spark.createDataFrame(table.collect(), "path string, sha256 string")

    (tmp_path / "in").mkdir()
    for step in (("a", "1"), ("b", "2")), (("a2", "3"),):
        for name, text in step:
            (tmp_path / "in" / name).write_text(text)
        q = changes.read_files(spark, f"file://{tmp_path}/in").writeStream.foreachBatch(changes.apply_fingerprints(lambda: state["stored"], write)).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert [s for _, s in state["seen"]][0] == ["ADDED", "ADDED"] and state["stored"].count() == 3
    assert state["seen"][-1][1].count("ADDED") == 1


def test_histories_as_state(spark, tmp_path):
    spark.createDataFrame([(1, k, f"t{k}") for k in range(7)] + [(2, 0, "x")], "conv_id long, turn long, text string").coalesce(1).write.parquet(f"{tmp_path}/t")
    s = spark.readStream.schema("conv_id long, turn long, text string").parquet(f"{tmp_path}/t")
    q = changes.capped_history(s).writeStream.format("memory").queryName("histories").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.conv_id, r.history[-1]): (r.turn_index, list(r.history)) for r in spark.table("histories").collect()}
    assert got[(1, "t6")] == (5, ["t2", "t3", "t4", "t5", "t6"]) and got[(2, "x")] == (0, ["x"])


def test_histories_of_many_batches(spark, tmp_path):
    spark.createDataFrame([(1, k * 7 % 25, f"t{k * 7 % 25}") for k in range(25)], "conv_id long, turn long, text string").coalesce(1).write.parquet(f"{tmp_path}/t")
    s, size = spark.readStream.schema("conv_id long, turn long, text string").parquet(f"{tmp_path}/t"), "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(size)
    spark.conf.set(size, "4")
    try:
        changes.capped_history(s).writeStream.format("memory").queryName("batches").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    finally:
        spark.conf.set(size, old)
    got = sorted((len(r.history), r.history[-1], list(r.history), r.turn_index) for r in spark.table("batches").collect())
    assert got == sorted((len(h), h[-1], h, min(k, 5)) for k in range(25) for h in [[f"t{i}" for i in range(max(k - 4, 0), k + 1)]])


def test_session_windows(spark):
    t = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    e = spark.createDataFrame([(1, t(m)) for m in (0, 20, 60, 61)], "user_id int, ts timestamp")
    assert sorted(r.n for r in changes.session_windows(e).collect()) == [2, 2]
