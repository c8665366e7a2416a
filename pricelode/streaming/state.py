"""Change capture with the last observation of every key in the state store.

A batch costs what it holds: the state of other keys isn't read or written. State lives in RocksDB beside the
checkpoint, so a query that is started again goes on where it ended."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Microseconds of a day of UTC.
DAY = 86_400_000_000
EPOCH, MICROSECOND = dt.datetime(1970, 1, 1), dt.timedelta(microseconds=1)


def _place(told: tuple) -> tuple:
    """A row in an order in which null is first."""
    return (told[0], *((v is not None, v if v is not None else 0) for v in told[1:]))


def _plain(value: Any) -> Any:
    """A value as JSON keeps it."""
    if value is None or (isinstance(value, float) and value != value):
        return None
    return value if isinstance(value, (str, int, float, bool)) else str(value)


class NewObservations(StatefulProcessor):
    """Of each key's observations in time order (equal times: by ``values``) those that say something new: the first, and such as differ
    from the one before in their day or a value (null is a value). Rows that are not behind the last one seen are late or repeated, and say nothing."""

    def __init__(self, ts: str, values: list[str]) -> None:
        self.ts, self.values = ts, values

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "micros long, told string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        some = [row for row in rows if row[self.ts] is not None]
        told = [((row[self.ts] - EPOCH) // MICROSECOND, *(_plain(row[v]) for v in self.values)) for row in some]
        last = self.last.get()
        before: tuple | None = (last[0], *json.loads(last[1])) if last is not None else None
        seen = before
        for i in sorted(range(len(told)), key=lambda i: _place(told[i])):
            row = told[i]
            if before is None or _place(row) > _place(before):
                if before is None or row[0] // DAY != before[0] // DAY or row[1:] != before[1:]:
                    yield some[i]
                before = row
        if before != seen:
            self.last.update((before[0], json.dumps(before[1:])))

    def close(self) -> None:
        pass


def new_observations(observed: DataFrame, keys: list[str], ts: str, values: list[str]) -> DataFrame:
    """The stream of observations that say something new (see NewObservations). ``ts`` is a timestamp without time zone; rows without one go."""
    spark = observed.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    declared = ", ".join(f"`{c}` {kind}" for c, kind in observed.dtypes)
    # rows and not pandas frames: most keys have a few rows in a batch, and a frame for each would cost more than they do
    processor = NewObservations(ts, values)
    return observed.groupBy(*keys).transformWithState(processor, declared, "Append", "None")


def append_changes(observed: DataFrame, path: str, checkpoint: str, keys: list[str], ts: str, values: list[str]) -> StreamingQuery:
    """New observations appended to a Parquet table, each once: the sink's log says which files count. Runs until the input at hand is read."""
    found = new_observations(observed, keys, ts, values)
    return found.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
