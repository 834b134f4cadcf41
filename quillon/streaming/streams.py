"""The stateless rules on a stream, and fetching once per time to live."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quillon.operators.docgraph import DAY
from quillon.sources.scratch import shared_path

#: Seconds from 1870 to 1970. A watermark begins at 1970, and what is before it is late: times are counted from 1870 instead, up to 2162 (pandas holds nanoseconds).
EARLIEST = 3_155_673_600


def read_parquet_stream(like: DataFrame, path: str, max_files: int | None = None) -> DataFrame:
    """A stream over the Parquet files below a folder, with the schema of ``like``."""
    reader = like.sparkSession.readStream.schema(like.schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def run_once(stream: DataFrame, rule: Callable[[DataFrame], DataFrame], name: str, batches: list[dict] | None = None) -> DataFrame:
    """Applies a rule to all that is there, as a stream with exactly-once output, and returns what was written.

    Rules are those of ``operators.access`` and ``functions.transforms``: column expressions and joins with static tables, which hold no
    state and so give the same rows as on a batch; or one with state. ``batches`` gets a row for each batch: ``batch``, ``rows`` read, and of its state ``keys`` held and ``late`` rows dropped.
    """
    spark = stream.sparkSession
    out, mark = shared_path(spark, name), shared_path(spark, f"{name}-offsets")
    changed = rule(stream)
    query: StreamingQuery = changed.writeStream.format("parquet").option("checkpointLocation", mark).option("path", out).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    if batches is not None:
        for p in query.recentProgress:
            batches.append({"batch": p.batchId, "rows": p.numInputRows, "keys": sum(s.numRowsTotal for s in p.stateOperators), "late": sum(s.numRowsDroppedByWatermark for s in p.stateOperators)})
    return spark.read.schema(changed.schema).parquet(out)


def first_per_ttl(stream: DataFrame, key: str, seconds: str = "t", ttl: float = DAY, delay: str = "0 seconds") -> DataFrame:
    """``(key, seconds)`` of every fetch: the first access of each key, and then the first one more than a time to live after the last fetch.

    The last fetch of each key is Spark's state, until the watermark, which runs ``delay`` behind the latest access, is past its time to live: from then on
    the key's next access fetches whether or not it is known. An access that comes when the watermark is past it is late: it is dropped, and counted by ``run_once``. Accesses of one
    batch are put in order by time, so where none is late and none comes after a fetch of a later batch that it precedes, the fetches are those of ``docgraph.replay`` however accesses fall into batches; an access older than
    the last fetch is a hit. Of a key's accesses in one batch only the times are held. Rows without a time are no accesses.
    """
    own = stream.select(key, seconds).where(F.col(seconds).isNotNull())
    timed = own.withColumn("_time", F.timestamp_seconds(F.col(seconds) + EARLIEST)).withWatermark("_time", delay)

    def run(of, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        times = np.sort(np.concatenate([f[seconds].to_numpy() for f in frames]))
        last, found = state.get[0] if state.exists else None, []
        at = 0 if last is None else int(np.searchsorted(times, last + ttl, side="right"))
        while at < len(times):
            last = times[at].item()
            found.append(at)
            at = int(np.searchsorted(times, last + ttl, side="right"))
        ends = int((last + ttl + EARLIEST) * 1000) + 1
        if ends > state.getCurrentWatermarkMs():
            state.update((last,))
            state.setTimeoutTimestamp(ends)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({key: pd.Series([of[0]] * len(found), dtype=object), seconds: times[found]})

    kind = T.StructType([T.StructField("last", own.schema[seconds].dataType)])
    return timed.groupBy(key).applyInPandasWithState(run, own.schema, kind, "append", "EventTimeTimeout")
