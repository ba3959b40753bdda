"""Streams of nodes into a store, and a token bucket for streams of requests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest


def ingest_stream(stream: DataFrame, write: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, session: str | None = None) -> StreamingQuery:
    """Each micro-batch of nodes through ingest; write gets nodes, edges and the batch's number, so that it can write each once."""

    def batch(df: DataFrame, number: int) -> None:
        nodes, edges = ingest.ingest(df, session)
        write(nodes, edges, number)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).start()


def token_bucket(stream: DataFrame, rate: float = 5.0, burst: float = 10.0) -> DataFrame:
    """(key, ts, allowed) for a stream of (key string, ts timestamp): burst tokens at first, rate a second after."""

    def limited(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        left, last = state.get if state.exists else (burst, None)
        for rows in batches:
            rows = rows.sort_values("ts")
            allowed = []
            for t in rows["ts"].map(lambda x: x.timestamp()):
                left = burst if last is None else min(burst, left + max(0.0, t - last) * rate)
                last = t if last is None else max(last, t)
                allowed.append(left >= 1)
                left -= left >= 1
            yield pd.DataFrame({"key": rows["key"], "ts": rows["ts"], "allowed": allowed})
        state.update((float(left), last))

    return stream.groupBy("key").applyInPandasWithState(limited, "key string, ts timestamp, allowed boolean", "left double, last double", "append", "NoTimeout")
