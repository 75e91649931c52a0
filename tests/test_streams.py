import tempfile

from matchspark.streaming import streams

ROW = streams.LOG.replace(" int", "").replace(" long", "").split(", ")


def write(spark, folder, rows):
    spark.createDataFrame([(m, p, r, t, kind, 0, 0, 0, w) for m, p, r, t, kind, w in rows], streams.LOG).coalesce(1).write.mode("append").parquet(folder)


def test_changed_sets_over_batches_and_a_repeated_batch(spark):
    folder, state, out = (tempfile.mkdtemp(prefix="spark-") for _ in range(3))
    files = [[(1, 1, 1, 0, 5, None), (1, 1, 2, 1, 5, None), (2, 1, 9, 0, 5, None)], [(1, 1, 3, 2, 5, None)], [(1, 1, 3, 2, 5, None)]]
    seen = []
    for rows in files:
        write(spark, folder, rows)

        def act(batch, n):
            for _ in range(2):  # as if the batch had been tried again
                streams.write_batch(f"{out}/acted")(batch, n)
            seen.append((n, sorted((r.match_id, r.rows, r.fingerprint) for r in batch.collect())))

        streams.on_change(streams.read_log(spark, f"{folder}"), state, "match_id", ROW, act)
    keys = [[(m, k) for m, k, _ in rows] for _, rows in seen]
    assert keys == [[(1, 2), (2, 1)], [(1, 3)], [(1, 4)]]
    assert spark.read.parquet(f"{out}/acted").count() == 4
    one = streams.set_state(spark.read.parquet(folder), "match_id", ROW).where("match_id = 1").first()
    assert one.fingerprint == seen[-1][1][0][2]  # the batches that brought the rows leave no trace
    assert len({f for _, rows in seen for m, _, f in rows if m == 1}) == 3


def test_closed_streams_give_each_session_and_life_once(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    write(spark, folder, [(1, 4, 1, 0, 2, None), (1, 4, 2, 5, 6, 0), (1, 4, 3, 9, 6, 0), (1, 4, 4, 30, 4, None), (1, 4, 5, 40, 2, None)])
    write(spark, folder, [(1, 4, 6, 100, 6, 0)])
    run = lambda rows: {tuple(r) for r in streams.drained(rows, tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")).collect()}
    assert run(streams.touch_sessions(streams.read_log(spark, folder), 12)) == set()  # all windows are open yet
    streams.close_log(spark, folder)
    log = lambda: streams.read_log(spark, folder)
    assert run(streams.touch_sessions(log(), 12)) == {(1, 0, 2, 5, 9), (1, 0, 1, 100, 100)}
    assert run(streams.buckets(log())) == {(1, 0, 5, 0), (1, 60, 1, 0)}
    assert run(streams.lives(log())) == {(1, 4, 0, 30), (1, 4, 40, None)}
