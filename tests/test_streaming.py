"""Versions of grids in a stream: late, repeated and withdrawn ones, expiry, and a restart from the checkpoint."""

import datetime

from fieldgrid.streaming import versions

KIND = "design_id long, phase_idx int, field string, action string, ts timestamp"


def at(minute):
    return datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(minutes=minute)


def test_versions_and_restart(spark, tmp_path):
    path, out, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))

    def arrive(rows):
        spark.createDataFrame([(d, p, f, a, at(m)) if m is not None else (d, p, f, a, None) for d, p, f, a, m in rows], KIND).coalesce(1).write.mode("append").parquet(path)

    def drained():
        return {r.design_id: (r.n_present, r.complete, r.closed) for r in versions.drain(spark, path, 2, out, checkpoint, late="60 minutes", keep_ms=120 * 60_000).collect()}

    arrive([(1, 0, "a", "put", 0), (1, 0, "b", "put", 1), (2, 0, "a", "put", 2), (2, 0, "a", "put", 2), (3, 0, "a", "put", 3), (4, 0, "a", "put", None), (None, 0, "a", "put", 4)])
    assert drained() == {1: (2, True, False), 2: (1, False, False), 3: (1, False, False)}
    # a run that finds nothing new changes nothing
    assert drained() == {1: (2, True, False), 2: (1, False, False), 3: (1, False, False)}
    # the withdrawal of minute 1 is older than what design 2 has, but later than design 3's; one at the same time as a put wins
    arrive([(1, 0, "b", "withdraw", 20), (2, 0, "a", "withdraw", 1), (2, 0, "b", "put", 30), (3, 0, "a", "withdraw", 3)])
    assert drained() == {1: (1, False, False), 2: (2, True, False), 3: (0, False, False)}
    # half an hour late, behind rows that have come since
    arrive([(1, 0, "b", "put", 25), (5, 1, "a", "put", 50)])
    assert drained() == {1: (2, True, False), 2: (2, True, False), 3: (0, False, False), 5: (1, False, False)}
    # the stream's time passes 120 minutes after all but the last
    arrive([(6, 0, "a", "put", 400)])
    assert drained() == {1: (2, True, True), 2: (2, True, True), 3: (0, False, True), 5: (1, False, True), 6: (1, False, False)}
    # rows too late are dropped
    arrive([(1, 0, "a", "withdraw", 26), (6, 0, "b", "put", 390)])
    assert drained() == {1: (2, True, True), 2: (2, True, True), 3: (0, False, True), 5: (1, False, True), 6: (2, True, False)}
    # a closed design opens anew
    arrive([(1, 0, "a", "put", 410)])
    assert drained()[1] == (1, False, False)
    assert spark.conf.get(versions.PROVIDER) != versions.ROCKS
