"""Second moments of windows: stream against table, with late and repeated rows and a restart."""

import datetime as dt

import numpy as np
import pytest

from effnum.streaming import windows

START = dt.datetime(2024, 1, 1)


def plain(vectors):
    x = np.array(vectors, dtype=float)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
    z = (x @ x.T) ** 2
    np.fill_diagonal(z, 1.0)
    return len(x) ** 2 / z.sum()


def rows_of(rng, first, hours):
    return [(first + k, START + dt.timedelta(hours=h), rng.normal(size=4).tolist()) for k, h in enumerate(hours)]


SCHEMA = "id long, ts timestamp, vec array<double>"


def test_table_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = rows_of(rng, 0, [0.1, 0.2, 0.3, 25, 26]) + [(90, START, [0.0] * 4), (91, START, [0.0] * 4), (92, START, None)]
    df = spark.createDataFrame([*rows, rows[0]], SCHEMA)
    got = windows.squared_diversity(df, "ts", "vec", "1 day", id="id").orderBy("window").collect()
    first = [v for _, t, v in rows if t < START + dt.timedelta(days=1) and v is not None]
    assert [r.n_species for r in got] == [5, 2]
    assert got[0].diversity == pytest.approx(plain(first))
    assert got[1].diversity == pytest.approx(plain([v for _, _, v in rows[3:5]]))
    assert windows.squared_diversity(df.limit(0), "ts", "vec", "1 day").collect() == []


def test_stream_equals_table_after_a_restart(spark, tmp_path):
    rng = np.random.default_rng(4)
    first = rows_of(rng, 0, [1, 2, 3])
    second = rows_of(rng, 10, [4, 26]) + [first[1]]  # repeated after the restart
    third = rows_of(rng, 20, [80])  # closes the first two days
    late = rows_of(rng, 30, [5, 81])  # the first is too late
    last = rows_of(rng, 40, [200])
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in (first, second, third, late, last):
        # Every part is a run of its own that continues from the state of the one before.
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        out = windows.squared_diversity(stream, "ts", "vec", "1 day", late="1 hour", id="id")
        query = (
            out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state)
            .outputMode("append").trigger(availableNow=True).start()
        )
        assert query.awaitTermination(120) and query.exception() is None
    got = [(r.n_species, r.diversity) for r in spark.read.parquet(sink).orderBy("window").collect()]
    days = [first + second[:1], second[1:2], third + late[1:]]
    assert got == [(len(d), pytest.approx(plain([v for _, _, v in d]))) for d in days]


def test_updates_follow_a_window(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = rows_of(rng, 0, [1, 2, 3, 4, 5])
    source, state, seen = str(tmp_path / "in"), str(tmp_path / "state"), []
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        out = windows.squared_diversity(stream, "ts", "vec", "1 day")
        query = (
            out.writeStream.foreachBatch(lambda batch, _: seen.extend((r.n_species, r.diversity) for r in batch.collect()))
            .option("checkpointLocation", state).outputMode("update").trigger(availableNow=True).start()
        )
        assert query.awaitTermination(120) and query.exception() is None
    assert seen == [(2, pytest.approx(plain([v for _, _, v in rows[:2]]))), (5, pytest.approx(plain([v for _, _, v in rows])))]
