"""Sessions that grow while they are read: a stateful compaction loop and sinks that resume."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "session_id string, segment long, n_events long, tokens long"
STATE = "segment long, n_events long, tokens long"


def _loop(window: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        segment, n, tokens = state.get if state.exists else (0, 0, 0)
        out = []
        for b in batches:
            for cost in b.sort_values(["ts", "event_id"])["cost"].fillna(0).astype(int):
                if tokens > window:
                    out.append((key[0], segment, n, tokens))
                    segment, n, tokens = segment + 1, 0, 0
                n, tokens = n + 1, tokens + int(cost)
        state.update((segment, n, tokens))
        yield pd.DataFrame(out, columns=["session_id", "segment", "n_events", "tokens"])

    return run


def compactions(events: DataFrame, window: int) -> DataFrame:
    """A row for every segment of a session that has passed the window; the open segment stays in the state.

    ``events`` (streaming): session_id, event_id, ts, cost. Late rows are never dropped: they join the open segment.
    """
    return events.select("session_id", "event_id", "ts", "cost").groupBy("session_id").applyInPandasWithState(_loop(window), OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def append_new(packets: DataFrame, path: str, keys: list[str]) -> int:
    """Append rows whose keys are not yet at ``path`` (JSON lines); returns how many. Runs again without repeats."""
    spark = packets.sparkSession
    try:
        done = spark.read.json(path).select(*keys).distinct()
        new = packets.join(done, keys, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e) and "UNRESOLVED" not in str(e):
            raise
        new = packets
    from packetloom.runtime import cut

    new = cut(new)
    new.write.mode("append").json(path)
    return new.count()


def last_records(records: DataFrame, key: str, seq: str) -> DataFrame:
    """The last record of each key."""
    cols = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(seq)).alias("r")).select(key, "r.*")
