"""Totals of strictly earlier days: the stream against the batch window and against a loop."""

import datetime as dt

from matchgrain.streaming.prior import RESULT, prior_batch, prior_totals

SCHEMA = "unit_id long, ts timestamp, value double"


def at(day, hour=12):
    return dt.datetime(2024, 3, day, hour)


def rows_of(frame):
    return sorted(((r.unit_id, r.day.day, r.n, r.total, r.prior_n, r.prior_total) for r in frame.collect()), key=repr)


def test_stream_equals_batch_and_a_loop(spark, tmp_path):
    batches = [
        [(1, at(1, 23), 1.0), (1, at(1, 3), 2.0), (2, at(1), None), (None, at(1), 4.0), (3, None, 9.0)],
        [(1, at(3), 5.0), (1, at(2), 6.0), (2, at(3), 7.0)],  # out of order, in time
        [(1, at(2), 100.0), (2, at(4), 8.0), (1, at(4), 1.5)],  # the first one's day closed when day 3 came
        [(9, at(20), 0.0)],  # closes all other days
    ]
    source, closed = tmp_path / "in", []
    stream = prior_totals(spark.readStream.schema(SCHEMA).parquet(str(source / "*")))
    source.mkdir()
    for i, b in enumerate(batches):  # a run a batch: totals and open days come back from the checkpoint
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.parquet(str(source / str(i)))
        run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination(120)
        closed.append(rows_of(spark.read.schema(RESULT).parquet(str(tmp_path / "out"))))
    kept = [r for b in batches for r in b if r[2] != 100.0 and r[1] is not None]
    want, loop = rows_of(prior_batch(spark.createDataFrame(kept, SCHEMA))), []
    for u, d in {(u, t.day) for u, t, _ in kept}:
        here, before = ([v or 0.0 for a, t, v in kept if a == u and t.day == d], [v or 0.0 for a, t, v in kept if a == u and t.day < d])
        loop.append((u, d, len(here), sum(here), len(before), sum(before)))
    assert want == sorted(loop, key=repr)
    assert closed[0] == [] and closed[1] == [r for r in want if r[1] < 3] and closed[-1] == [r for r in want if r[1] < 20]
