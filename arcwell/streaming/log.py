"""The activity log as a stream with state: bounded, with what leaves it told once.

Needs a session whose state store keeps lists (``STORE``), as Spark asks of such operators.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Entries that a log keeps (fixed value), and the state store that the session must name.
KEPT = 500
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
ENTRY = "ts timestamp, id long"


class _Log(StatefulProcessor):
    """A project's newest entries as list state. What is older than ``keep`` newer ones leaves;
    it can't come back, since later events only add newer ones or are older still."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getListState("entries", ENTRY)

    def handleInputRows(self, key: Any, rows: Iterator[Any], timerValues: Any) -> Iterator[Any]:  # noqa: N802, N803
        import pandas as pd

        held = [tuple(e) for e in self.entries.get()]
        for frame in rows:
            held += list(zip((t.to_pydatetime() for t in frame["ts"]), (int(i) for i in frame["id"]), strict=True))
        held.sort()
        gone, held = held[: max(0, len(held) - self.keep)], held[-self.keep :]
        self.entries.put(held)
        yield pd.DataFrame({"project": [key[0]] * len(gone), "ts": pd.Series([t for t, _ in gone], dtype="datetime64[us]"), "id": pd.Series([i for _, i in gone], dtype="int64")})

    def close(self) -> None:
        pass


def evicted(events: DataFrame, keep: int = KEPT) -> DataFrame:
    """(project, ts, id) of the entries (project, ts, id) that aren't among the ``keep`` newest of
    their project, each once: on a stream as soon as they leave, on a batch all of them.
    Entries of one time are ordered by id. The state of a project is ``keep`` entries."""
    rows = events.select("project", "ts", "id")
    if events.isStreaming:
        return rows.groupBy("project").transformWithStateInPandas(_Log(keep), f"project string, {ENTRY}", "append", "none")
    newest = Window.partitionBy("project").orderBy(F.desc("ts"), F.desc("id"))
    return rows.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") > keep).drop("_n")


def periodic(events: DataFrame, run, folder: str, every: str = "10 minutes", **trigger):
    """One query that calls ``run(batch, number)`` on what came since the last turn, at most once
    ``every`` so long (or by another ``trigger``); its progress below ``folder`` lets a restart
    go on where it stopped. A turn without new events doesn't run."""
    def turn(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            run(batch, number)

    return events.writeStream.foreachBatch(turn).option("checkpointLocation", folder).trigger(**(trigger or {"processingTime": every})).start()
