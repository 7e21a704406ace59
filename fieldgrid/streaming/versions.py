"""Grids that arrive again, late or are withdrawn, and the designs that are complete so far, in state that expires."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "design_id long, n_present int, complete boolean, closed boolean"


class Versions(StatefulProcessor):
    """The latest version of each of a design's grids, for keep_ms after the design's last one."""

    def __init__(self, n_expected: int, keep_ms: int):
        self.n_expected, self.keep_ms = n_expected, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.grids = handle.getMapState("grids", "phase_idx int, field string", "at long, there boolean")
        self.last = handle.getValueState("last", "at long")

    def _told(self, design_id, closed: bool) -> Row:
        n = sum(there for _, there in self.grids.values())
        return Row(design_id=design_id, n_present=n, complete=n >= self.n_expected, closed=closed)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = self.last.get()[0] if self.last.exists() else None
        for r in rows:
            grid, new = (r.phase_idx, r.field), (r.at, r.action == "put")
            old = self.grids.getValue(grid) if self.grids.containsKey(grid) else None
            # the latest counts, in whatever order they come; of two at a time the withdrawal
            if old is None or (new[0], not new[1]) >= (old[0], not old[1]):
                self.grids.updateValue(grid, new)
            last = r.at if last is None else max(last, r.at)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.keep_ms)
        self.last.update((last,))
        yield self._told(key[0], False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield self._told(key[0], True)
        self.grids.clear()
        self.last.clear()

    def close(self) -> None:
        pass


def drain(spark: SparkSession, path: str, n_expected: int, out: str, checkpoint: str, late: str = "1 hour", keep_ms: int = 7_200_000, files_at_once: int = 1) -> DataFrame:
    """Reads what has arrived under path since the checkpoint, and returns the latest state of each design: design_id, n_present, complete, closed.

    Rows are design_id, phase_idx, field, action (`put` or `withdraw`) and ts. A grid is
    present if the latest of its rows is a put, whatever order they come in; a repeated
    row changes nothing. Rows later than `late` behind the latest ts may be dropped. A
    design that has had no row for keep_ms of the stream's time is closed: its last state
    is told once more and its entries go, so state holds the designs of the last keep_ms
    and not the dataset; a later row opens it anew, with that row alone. Rows with a null
    in any of the columns are left out. A run that ends anywhere goes on from the
    checkpoint, and a batch that is repeated replaces what it wrote.
    """
    stream = spark.readStream.schema("design_id long, phase_idx int, field string, action string, ts timestamp").option("maxFilesPerTrigger", files_at_once).parquet(path)
    rows = stream.dropna().withWatermark("ts", late).select("design_id", "phase_idx", "field", "action", "ts", F.unix_millis("ts").alias("at"))
    states = rows.groupBy("design_id").transformWithState(Versions(n_expected, keep_ms), STATE, "Update", "eventTime")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        query = states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
    told = spark.read.schema(f"{STATE}, batch int").parquet(out)
    return told.groupBy("design_id").agg(F.max_by(F.struct("n_present", "complete", "closed"), "batch").alias("s")).select("design_id", "s.*")
