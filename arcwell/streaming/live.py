"""The live loop as Structured Streaming: every transformation also runs on a batch
frame, so a stream's result can be held against the batch on the same events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def debounce(events: DataFrame, quiet: str = "15 seconds", lateness: str = "1 minute") -> DataFrame:
    """One row per burst: (begin, end, n). A burst ends when nothing came for ``quiet``."""
    e = events.withWatermark("ts", lateness) if events.isStreaming else events
    return e.groupBy(F.session_window("ts", quiet).alias("s")).agg(F.count("*").alias("n")).select(F.col("s.start").alias("begin"), F.col("s.end").alias("end"), "n")


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Event-time counts by type in tumbling or sliding windows; later rows are dropped."""
    e = events.withWatermark("ts", lateness) if events.isStreaming else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return e.groupBy(w.alias("w"), "type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("begin"), "type", "n")


def alerts(events: DataFrame, drop: float = 10.0) -> DataFrame:
    """Events worth telling: a health drop of ``drop`` or more, a new critical risk, a
    critical rule violation, a failed build or CI run."""
    fit = ((F.col("type") == "health-down") & (F.col("magnitude") >= drop)) | (F.col("type").isin("risk-new", "rule-violation") & (F.col("severity") == "critical")) | F.col("type").isin("ci-failure", "build-failure")
    return events.where(fit)


def once_a_day(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """The first event of each (entity, trigger, day)."""
    e = events.withColumn("day", F.to_date("ts"))
    if e.isStreaming:
        return e.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["entity", "trigger", "day"])
    return e.dropDuplicates(["entity", "trigger", "day"])


def dispatch_stream(events: DataFrame, cap: int = 5, failures: int = 2, lateness: str = "1 day") -> DataFrame:
    """``govern.dispatch`` on a stream of (id, ts, entity, trigger, failed_before): the state
    of a day is its dispatched keys, at most ``cap``. Events of a batch are taken in order
    of ts and id; a day's state goes when the watermark is a day past it."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        sent = [tuple(x.split("\x1f")) for x in state.get[0]] if state.exists else []
        for rows in [pd.concat(list(frames)).sort_values(["ts", "id"])]:
            said = []
            for entity, trigger, failed in zip(rows["entity"], rows["trigger"], rows["failed_before"], strict=True):
                name = (str(entity), str(trigger))
                said.append("duplicate" if name in sent else "capped" if len(sent) >= cap else "blocked" if failed >= failures else "dispatched")
                if said[-1] == "dispatched":
                    sent.append(name)
            state.update((["\x1f".join(x) for x in sent],))
            state.setTimeoutTimestamp(int((pd.Timestamp(key[0], tz="UTC") + pd.Timedelta(days=2)).timestamp() * 1000))
            yield pd.DataFrame({"id": rows["id"], "day": key[0], "decision": said})

    e = events.withWatermark("ts", lateness).withColumn("day", F.to_date("ts"))
    return e.groupBy("day").applyInPandasWithState(decide, "id long, day date, decision string", "sent array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def keep_last(log: DataFrame, n: int = 500) -> DataFrame:
    """The newest ``n`` entries of a log (ts, id), as its readers see it."""
    return log.orderBy(F.desc("ts"), F.desc("id")).limit(n)


def changed_files(now: DataFrame, cache: DataFrame) -> DataFrame:
    """Files of ``now`` (file, text) whose content the cache (file, digest) lacks."""
    return now.withColumn("digest", F.sha2("text", 256)).join(cache.select("file", "digest"), ["file", "digest"], "left_anti")


def incremental(now: DataFrame, cache: DataFrame, facts: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Facts of unchanged files from before and fresh facts of the others; equal to a
    full run."""
    fresh = changed_files(now, cache)
    same = now.select("file").join(fresh.select("file"), "file", "left_anti")
    return facts.join(same, "file", "left_semi").unionByName(extract(fresh.select("file", "text"))).select(*facts.columns)


def fan_out(events: DataFrame, sinks: list[Callable[[DataFrame, int], None]], folder: str, **trigger):
    """One query a sink, each with its own progress below ``folder``."""
    return [events.writeStream.foreachBatch(s).option("checkpointLocation", f"{folder}/{i}").trigger(**(trigger or {"availableNow": True})).start() for i, s in enumerate(sinks)]
