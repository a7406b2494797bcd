"""Change events, incremental sync and the serving log as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftwell.functions.text import redacted
from siftwell.sources.workspace import watch_relevant

DEBOUNCE = "2 seconds"


def sessions(events: DataFrame, time: str = "ts", by: list[str] = (), gap: str = DEBOUNCE, late: str = "1 minute") -> DataFrame:
    """Bursts of events that end after a quiet gap. Works on batch and streaming frames; a stream gets a watermark."""
    df = events.withColumn("_t", F.col(time).cast("timestamp"))
    if events.isStreaming:
        df = df.withWatermark("_t", late)
    key = list(by) or [F.col("_t").isNotNull().alias("_any")]  # streams want a key besides the window
    out = df.groupBy(F.session_window("_t", gap), *key).agg(F.count(F.lit(1)).alias("n_events"), *([F.max(watch_relevant("path")).alias("fires")] if "path" in events.columns else []))
    return out.select(*by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *[c for c in out.columns if c in ("n_events", "fires")])


def on_change(events: DataFrame, sync: Callable[[], None], checkpoint: str, trigger: str = DEBOUNCE) -> StreamingQuery:
    """Run a sync for every micro-batch that holds a relevant change; the sync itself diffs against the manifest, so a repeat is harmless."""

    def step(batch: DataFrame, _: int) -> None:
        if not batch.where(watch_relevant("path")).isEmpty():
            sync()

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()


def log_rows(calls: DataFrame) -> DataFrame:
    """Serving-log rows: query redacted and cut to 500 characters, latency in milliseconds."""
    return calls.withColumn("query", F.substring(redacted("query"), 1, 500))


def log_sink(calls: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append log rows as JSON lines, each once."""
    return log_rows(calls).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
