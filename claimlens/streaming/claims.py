"""Claims as a stream: which of them were seen before, by a state that forgets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructType

from ..functions.text import cache_key

#: The state store that state with a time to live needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 24 * 60 * 60 * 1000
SEEN = "claim_id string, key string, at timestamp, status string, by string"


class ClaimMemory(StatefulProcessor):
    """One entry for each claim key: who was verified, when, and until when that holds.

    A claim is a miss if there is no entry, expired if its time is past the entry's end, else a hit; misses and expired ones
    become the entry.  The store drops an entry keep_ms after it was last written, by the clock, whether or not the
    key comes again, so the state holds what came in that time and no more.
    """

    def __init__(self, ttl_ms: int, keep_ms: int) -> None:
        self.ttl_ms, self.keep_ms = ttl_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", StructType().add("by", StringType()).add("ends_ms", LongType()), self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.entry.get() if self.entry.exists() else None
        changed = False
        for part in rows:  # a chunk at a time, however many rows the key has
            out = []
            for claim, at in sorted(zip(part["claim_id"], part["at"]), key=lambda r: (r[1], r[0])):
                ms = int(at.timestamp() * 1000)
                status = "miss" if held is None else "expired" if ms > held[1] else "hit"
                if status != "hit":
                    held, changed = (claim, ms + self.ttl_ms), True
                out.append((claim, key[0], at, status, held[0]))
            yield pd.DataFrame(out, columns=["claim_id", "key", "at", "status", "by"])
        if changed:
            self.entry.update(held)

    def close(self) -> None:
        pass


def remembered(claims: DataFrame, ttl_days: float = 90, keep_days: float | None = None) -> DataFrame:
    """claim_id, key, at, status (hit, miss, expired) and by, the claim whose verdict holds, of a stream (claim_id, text, at).

    Rows of one key in one chunk count in order of time.  keep_days bounds the state by the clock; twice ttl_days
    without it, so that an entry that has expired is still known as such for a while.  Sets the session's state store, and
    no batches without data, which it needs.
    """
    claims.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    # State that goes by the clock always asks for another batch, so that a run over what is available would not end.
    claims.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    keep = 2 * ttl_days if keep_days is None else keep_days
    keyed = claims.select(F.col("claim_id").cast("string").alias("claim_id"), cache_key(F.col("text")).alias("key"), F.col("at").cast("timestamp").alias("at"))
    memory = ClaimMemory(round(ttl_days * DAY_MS), max(1, round(keep * DAY_MS)))
    return keyed.groupBy("key").transformWithStateInPandas(statefulProcessor=memory, outputStructType=SEEN, outputMode="append", timeMode="processingTime")
