"""State with timers, and refreshes that may be repeated; extensions, as windows are."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folioscope.streaming.windows import watermarked

#: The state store that keeps lists and timers; a session's own setting.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_BURST = "start_us long, due_us long, n long, withdrawn boolean"


class Bursts(StatefulProcessor):
    """A site's bursts of edits that aren't over: an edit keeps its burst open for the quiet period, one that withdraws something for less. A timer tells when a burst is due."""

    def __init__(self, quiet_s: int, after_withdrawal_s: int):
        self._waits = {False: quiet_s * 1_000_000, True: after_withdrawal_s * 1_000_000}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getListState("open", _BURST)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        bursts = [tuple(r) for r in self._open.get()]
        bursts += [(r.at_us, r.at_us + self._waits[bool(r.withdrawn)], 1, bool(r.withdrawn)) for r in rows]
        merged: list[tuple] = []
        for start, due, n, withdrawn in sorted(bursts):
            if merged and start < merged[-1][1]:
                a, b, m, w = merged[-1]
                merged[-1] = (a, max(b, due), m + n, w or withdrawn)
            else:
                merged.append((start, due, n, withdrawn))
        self._open.put(merged)
        known = set(self._handle.listTimers())
        for _, due, _, _ in merged:
            if (at := -(-due // 1000)) not in known:
                self._handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        bursts = [tuple(r) for r in self._open.get()]
        over = [b for b in bursts if b[1] <= now]
        if over:
            rest = [b for b in bursts if b[1] > now]
            self._open.put(rest) if rest else self._open.clear()
        for _, due, n, withdrawn in over:
            yield Row(site_id=key[0], due_us=due, n=n, withdrawn=withdrawn)

    def close(self) -> None:
        pass


def due_refreshes(changes: DataFrame, quiet_s: int = 300, after_withdrawal_s: int = 60, late: str = "1 day") -> DataFrame:
    """(site_id, due_us, n, withdrawn) of a stream of edits (site_id, ts, withdrawn): what windows.settled() says of a table, told as soon as a burst is over.

    Edits later than ``late`` behind the newest are dropped, as windows do.
    The session needs STORE. State is a site's open bursts, which a timer closes.
    """
    rows = watermarked(changes, late).withColumn("at_us", F.unix_micros("ts"))
    return rows.groupBy("site_id").transformWithState(
        Bursts(quiet_s, after_withdrawal_s), "site_id long, due_us long, n long, withdrawn boolean", outputMode="Append", timeMode="EventTime"
    )


def refresh_counts(path: str, keys: list[str]):
    """A foreachBatch() function: each batch's counts by ``keys`` go to a folder of the batch's own, which a repeated batch overwrites. counts() adds them up."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def counts(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """(keys, n) over all batches so far, each once however often it was run."""
    return spark.read.parquet(path).groupBy(*keys).agg(F.sum("n").alias("n"))
