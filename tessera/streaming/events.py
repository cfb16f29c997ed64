"""Event streams: reading, filtering, windows, deduplication and run states.

Everything works on batch DataFrames too, with the same results, except the sinks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT_SCHEMA = "type string, docVersionId string, tenantId string, processingRunId string, timestamp string, data struct<status: string, level: string, runType: string, durationMs: bigint, error: string, stepsCompleted: int>"
EVENT_NAMES = ("type", "docVersionId", "tenantId", "processingRunId", "timestamp", "data")
TABLE_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, schema: str = TABLE_SCHEMA, per_trigger: int = 1) -> DataFrame:
    """A stream of Parquet files of events."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def parse_messages(messages: DataFrame, value: str = "value") -> DataFrame:
    """Typed events of JSON messages; malformed ones are dropped."""
    parsed = messages.select(F.from_json(F.col(value).cast("string"), EVENT_SCHEMA).alias("e"))
    return parsed.where("e.type is not null and e.tenantId is not null").select("e.*", F.to_timestamp("e.timestamp").alias("at"))


def publish(events: DataFrame) -> DataFrame:
    """Events as ``key`` and JSON ``value``, keyed by version, else tenant, else run, as a topic takes them."""
    names = EVENT_NAMES
    return events.select(F.coalesce("docVersionId", "tenantId", "processingRunId").alias("key"), F.to_json(F.struct(*(n for n in names if n in events.columns))).alias("value"))


def split_dead(jobs: DataFrame, retries: dict[str, int], kind: str = "kind", attempts: str = "attempts") -> tuple[DataFrame, DataFrame]:
    """Failed jobs to be tried again, with their delay in seconds, and those that used up the retries of their kind."""
    most = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in retries.items() for x in kv)), F.col(kind)), F.lit(1))
    again = jobs.where(F.col(attempts) < most).withColumn("delay_seconds", 5.0 * F.pow(F.lit(2.0), F.col(attempts) - 1))
    return again, jobs.where(F.col(attempts) >= most)


def subscribe(events: DataFrame, tenant: str, version: str | None = None) -> DataFrame:
    """One tenant's events, of one document version if given."""
    rows = events.where(F.col("tenantId") == tenant)
    return rows if version is None else rows.where(F.col("docVersionId") == version)


def _timed(events: DataFrame, late: str) -> DataFrame:
    # a watermark needs a timestamp with a time zone; the session's is UTC
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    return rows.withWatermark("at", late) if events.isStreaming else rows


def tumbling(events: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums by event type in windows of a width."""
    found = _timed(events, late).groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return found.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Each user's sessions: runs of events less than ``gap`` apart."""
    found = _timed(events, late).groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.max("at").alias("last"))
    return found.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("last").cast("timestamp_ntz").alias("last"), "n")


def once(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Events without those whose idempotency key was seen within the watermark."""
    rows = _timed(events, late)
    return rows.dropDuplicatesWithinWatermark([key]) if events.isStreaming else rows.dropDuplicates([key])


def run_states(events: DataFrame, idle: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """The latest state of each user's run as events come; runs without events for ``idle`` become failed.

    Events later than ``late`` are dropped.
    """
    limit = pd.Timedelta(idle)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last, kind = state.get if state.exists else (0, 0, None)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "state": ["failed"], "n_events": [n]})
            return
        for rows in batches:
            n += len(rows)
            top = rows.sort_values(["at", "event_id"]).iloc[-1]
            at = int(top["at"].value // 1000)
            if at >= last:
                last, kind = at, top["event_type"]
        state.update((n, last, kind))
        state.setTimeoutTimestamp(int(max(last // 1000, state.getCurrentWatermarkMs()) + limit.total_seconds() * 1000) + 1)
        yield pd.DataFrame({"user_id": [key[0]], "state": [kind], "n_events": [n]})

    rows = _timed(events, late).select("user_id", "at", "event_id", "event_type")
    return rows.groupBy("user_id").applyInPandasWithState(update, "user_id long, state string, n_events long", "n long, last long, kind string", "update", GroupStateTimeout.EventTimeTimeout)


def rate_limited(events: DataFrame, key: str, seconds: int, limit: int, late: str = "1 hour") -> DataFrame:
    """Events with ``limited``: whether their key had more than ``limit`` events in the last ``seconds``, this one
    included and one exactly that old not.  The state is the log of a key's recent times; a key without recent
    events loses it.
    """
    span = seconds * 1_000_000

    def update(who: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        now = rows["at"].to_numpy("datetime64[us]").astype(np.int64)
        held = np.array(state.get[0] if state.exists else [], np.int64)
        log = np.concatenate([held, now])
        # places in the log of each event and of the first one within its window; events that come late see those before them
        upto = len(held) + np.arange(1, len(now) + 1)
        inside = np.array([np.count_nonzero(log[:n] > t - span) for n, t in zip(upto, now)]) if (np.diff(log) < 0).any() else upto - np.searchsorted(log, now - span, "right")
        state.update((log[log > log.max() - span].tolist(),))
        state.setTimeoutTimestamp(int(max(log.max() // 1000 + seconds * 1000, state.getCurrentWatermarkMs())) + 1)
        yield pd.DataFrame({"event_id": rows["event_id"].to_numpy(), key: who[0], "limited": inside > limit})

    rows = _timed(events, late).select(key, "at", "event_id")
    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).applyInPandasWithState(update, f"event_id long, {key} {kind}, limited boolean", "log array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def write_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process all that is there and stop; restarts go on from the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
