"""Keyed state over event streams: the batch operators' results, batch by batch.

Each key keeps one number between batches: the time of its last write, the last
start, or the end of its cooldown. Rows of a batch are put in order of (t, id);
rows that come in a later batch than a later event of their key are taken as
they come. State stays until the stream's checkpoint is cleared.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.storage import shared_dir


def _with_state(events: DataFrame, out: str, step: Callable[[int | None, pd.DataFrame], tuple[int | None, pd.DataFrame]]) -> DataFrame:
    """step(state, rows in order) to (state, rows), for each key and batch. Its rows come in Arrow batches; they are sorted together, as state goes by time."""
    kinds = dict(events.dtypes)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["t", "id"], kind="stable", ignore_index=True)
        before = state.get[0] if state.exists else None
        after, found = step(before, rows)
        if after is not None:
            state.update((int(after),))
        found.insert(0, "key", key[0])
        yield found

    return events.groupBy("key").applyInPandasWithState(run, f"key {kinds['key']}, id {kinds['id']}, {out}", "value long", "append", GroupStateTimeout.NoTimeout)


def ttl_cache(events: DataFrame, ttl_us: int) -> DataFrame:
    """events(key, id, t) to (key, id, hit)."""

    def step(at: int | None, rows: pd.DataFrame) -> tuple[int | None, pd.DataFrame]:
        hits = []
        for t in rows["t"].tolist():
            hit = at is not None and t - at <= ttl_us
            at = at if hit else t
            hits.append(hit)
        return at, pd.DataFrame({"id": rows["id"], "hit": hits})

    return _with_state(events.select("key", "id", "t"), "hit boolean", step)


def throttle(events: DataFrame, gap_us: int) -> DataFrame:
    """events(key, id, t) to (key, id, start)."""

    def step(last: int | None, rows: pd.DataFrame) -> tuple[int | None, pd.DataFrame]:
        starts = []
        for t in rows["t"].tolist():
            last = t if last is None else max(t, last + gap_us)
            starts.append(last)
        return last, pd.DataFrame({"id": rows["id"], "start": starts})

    return _with_state(events.select("key", "id", "t"), "start long", step)


def cooldown(events: DataFrame, default_us: int = 60_000_000, most_us: int = 300_000_000) -> DataFrame:
    """events(key, id, t, limited, retry_us) to (key, id, cooling)."""

    def step(until: int | None, rows: pd.DataFrame) -> tuple[int | None, pd.DataFrame]:
        cooling = []
        for t, limited, retry in zip(rows["t"].tolist(), rows["limited"].tolist(), rows["retry_us"].tolist(), strict=True):
            cooling.append(until is not None and until > t)
            if limited:
                until = t + min(default_us if pd.isna(retry) else int(retry), most_us)
        return until, pd.DataFrame({"id": rows["id"], "cooling": cooling})

    return _with_state(events.select("key", "id", "t", "limited", "retry_us"), "cooling boolean", step)


def drain(stream: DataFrame) -> DataFrame:
    """Run a stream over all that its source has now, and give what it wrote."""
    folder = f"{shared_dir(stream.sparkSession)}/siltstone/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
