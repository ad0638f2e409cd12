"""The batch operators over streams: texts that arrive are checked as those that are there."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import streams
from ..operators.matching import quotations


def stored_once(corpus: DataFrame, checkpoint: str) -> DataFrame:
    """The corpus as a table beside a stream's checkpoint, so that its batches don't tokenise it again."""
    corpus.write.mode("overwrite").parquet(f"{checkpoint}-corpus")
    return corpus.sparkSession.read.schema(corpus.schema).parquet(f"{checkpoint}-corpus")


def check_stream(texts: DataFrame, records: DataFrame, path: str, checkpoint: str, id_col: str, least: int = 6) -> StreamingQuery:
    """Appends the quotations of arriving texts to ``path``; each batch is written under its number, so a repeated one overwrites itself."""
    corpus = stored_once(streams(records, "item_id"), checkpoint)

    def write(batch: DataFrame, number: int) -> None:
        quotations(streams(batch, id_col), corpus, least=least).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rate_limited_stream(requests: DataFrame, most: int = 30, seconds: int = 60, delay: str = "0 seconds") -> DataFrame:
    """(key, at, request, allowed) of streamed requests (key, at seconds, request), those of a batch in their order.

    State: the times of a key that were let through within the window before its last request. When the watermark, which
    ``delay`` holds back, has passed a key's window, its state is dropped, so idle keys take no room; what a dropped key
    sends later starts anew, as it would anyhow. Requests older than the watermark are late and are left out.
    """

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["at", "request"])
        allowed = []
        for at in rows["at"]:
            recent = [t for t in recent if t > at - seconds]
            allowed.append(len(recent) < most)
            if allowed[-1]:
                recent.append(int(at))
        state.update((recent,))
        state.setTimeoutTimestamp(max((int(rows["at"].max()) + seconds) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": key[0], "at": rows["at"], "request": rows["request"], "allowed": allowed})

    timed = requests.withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", delay)
    return timed.groupBy("key").applyInPandasWithState(decide, "key long, at long, request long, allowed boolean", "recent array<long>", "append", "EventTimeTimeout")


def windowed_counts(events: DataFrame, delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events by type in tumbling windows, late ones within the delay included."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").count()
