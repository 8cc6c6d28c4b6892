"""Keyed state over event logs: TTL caches, throttles, cooldowns, offline flags, eviction."""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.storage import materialize


def micros(ts: str = "ts") -> F.Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _in_order(events: DataFrame, key: str, schema: str, run) -> DataFrame:
    """run(key, columns) over each key's rows in order of (t, id), as batches pass by; it may be called several times for a key.

    Rows are dealt by key and sorted, not collected, so a key of any size takes
    the memory of one batch and of the state that run keeps.
    """

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = run()
        for batch in found:
            if batch.num_rows:
                yield step(batch)

    return events.repartition(key).sortWithinPartitions(key, "t", "id").mapInArrow(batches, schema)


def _key_runs(batch: pa.RecordBatch, key: str) -> Iterator[tuple[object, int, int]]:
    values = batch.column(batch.schema.get_field_index(key)).to_pylist()
    start = 0
    for i in range(1, len(values) + 1):
        if i == len(values) or values[i] != values[start]:
            yield values[start], start, i
            start = i


def ttl_cache(events: DataFrame, ttl_us: int) -> DataFrame:
    """events(key, id, t) with hit: whether the key's last write is at most ttl_us old. A miss writes; a hit refreshes nothing.

    The time of the last write is all the state; the next write is found by
    bisection, so the work is that of the misses.
    """

    def run():
        now: list = [None, None]  # key, time of its last write

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            times = batch.column(batch.schema.get_field_index("t")).to_numpy()
            hit = np.ones(batch.num_rows, bool)
            for key, a, b in _key_runs(batch, "key"):
                at = now[1] if now[1] is not None and now[0] == key else None
                i = a if at is None else a + int(np.searchsorted(times[a:b], at + ttl_us, side="right"))
                while i < b:
                    hit[i], at = False, int(times[i])
                    i = i + 1 + int(np.searchsorted(times[i + 1 : b], at + ttl_us, side="right"))
                now[:] = key, at
            return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("key")), batch.column(batch.schema.get_field_index("id")), pa.array(hit)], names=["key", "id", "hit"])

        return step

    return _in_order(events.select("key", "id", "t"), "key", f"key {dict(events.dtypes)['key']}, id {dict(events.dtypes)['id']}, hit boolean", run)


def throttle(events: DataFrame, gap_us: int) -> DataFrame:
    """events(key, id, t) with start: requests of a key start at least gap_us apart, in order. A running maximum, not a loop."""
    order = W.partitionBy("key").orderBy("t", "id")
    i = F.row_number().over(order).cast("bigint") - 1
    ahead = F.max(F.col("t") - F.col("i") * gap_us).over(order.rowsBetween(W.unboundedPreceding, 0))
    return events.withColumn("i", i).withColumn("start", F.col("i") * gap_us + ahead).drop("i")


def cooldown(events: DataFrame, default_us: int = 60_000_000, most_us: int = 300_000_000) -> DataFrame:
    """events(key, id, t, limited, retry_us) with cooling: whether the key's last limit before this event still holds. The last one wins."""
    until = F.when(F.col("limited"), F.col("t") + F.least(F.coalesce("retry_us", F.lit(default_us)), F.lit(most_us)))
    before = W.partitionBy("key").orderBy("t", "id").rowsBetween(W.unboundedPreceding, -1)
    return events.withColumn("cooling", F.coalesce(F.last(until, ignorenulls=True).over(before) > F.col("t"), F.lit(False)))


def offline(events: DataFrame, scope: list[str], span_us: int = 2_000_000, hold_us: int = 10_000_000) -> DataFrame:
    """events(id, t, host, failed) with offline: two hosts failing within span_us set the flag for hold_us; a success clears it.

    scope: columns of independent logs, such as the client; state never crosses them.
    """
    order = W.partitionBy(*scope).orderBy("t", "id")
    told = events.where(F.col("failed") & F.col("host").isNotNull())
    # the last failure of another host: before the present run of this one's
    before_run = F.when(F.lag("host").over(order) != F.col("host"), F.lag("t").over(order))
    other = F.last(before_run, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    peers = W.partitionBy(*scope, "t")
    both = F.coalesce(other >= F.col("t") - span_us, F.lit(False)) | (F.min("host").over(peers) != F.max("host").over(peers))
    told = told.withColumn("_two", both)
    rest = events.where(~(F.col("failed") & F.col("host").isNotNull())).withColumn("_two", F.lit(False))
    until = F.when(F.col("_two"), F.col("t") + hold_us).when(~F.col("failed"), F.lit(0))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    return told.unionByName(rest).withColumn("offline", F.coalesce(F.last(until, ignorenulls=True).over(before) > F.col("t"), F.lit(False))).drop("_two")


def evicting_cache(events: DataFrame, scope: str, capacity: int, ttl_us: int, recent: bool = False) -> DataFrame:
    """events(scope, id, t, key) with hit and size for caches of bounded size, the oldest write leaving first, before every write.

    recent: a hit moves its entry to the end, so the least recently used one
    leaves. Sequential by nature, so one task per cache; scope keeps caches
    apart, and the cache is all that is in memory.
    """

    def run():
        now: list = [None, OrderedDict()]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            keys, times = column("key").to_pylist(), column("t").to_pylist()
            hits, sizes = [], []
            for name, a, b in _key_runs(batch, scope):
                if name != now[0] or not now[1]:
                    now[:] = name, OrderedDict()
                cache = now[1]
                for key, t in zip(keys[a:b], times[a:b], strict=True):
                    hit = key in cache and t - cache[key] <= ttl_us
                    if not hit:
                        while len(cache) >= capacity:
                            cache.popitem(last=False)
                        cache.pop(key, None)
                        cache[key] = t
                    elif recent:
                        cache.move_to_end(key)
                    hits.append(hit)
                    sizes.append(len(cache))
            return pa.RecordBatch.from_arrays([column(scope), column("id"), pa.array(hits, pa.bool_()), pa.array(sizes, pa.int64())], names=[scope, "id", "hit", "size"])

        return step

    return _in_order(events.select(scope, "id", "t", "key"), scope, f"{scope} {dict(events.dtypes)[scope]}, id long, hit boolean, size long", run)


def newest_half(entries: DataFrame, at: str, size: str, most: int, key: str = "key") -> DataFrame:
    """entries as they are if their sizes sum to at most `most`, else the newer half of them; ties by key.

    Entries are counted by time before the running count, so only times, not
    entries, pass one window.
    """
    total = entries.agg(F.coalesce(F.sum(size), F.lit(0)).alias("_total"), F.count("*").alias("_all"))
    per = entries.groupBy(F.col(at).alias("_at")).agg(F.count("*").alias("_n"))
    newer = per.withColumn("_before", F.sum("_n").over(W.orderBy(F.desc("_at")).rowsBetween(W.unboundedPreceding, 0)) - F.col("_n"))
    placed = entries.join(newer, entries[at] == newer["_at"]).crossJoin(F.broadcast(total))  # one row
    rank = F.col("_before") + F.row_number().over(W.partitionBy("_at").orderBy(F.col(key)))
    return placed.withColumn("_rank", rank).where((F.col("_total") <= most) | (F.col("_rank") <= F.ceil(F.col("_all") / 2))).select(*entries.columns)


def flatten_threads(nodes: DataFrame) -> DataFrame:
    """nodes(thread, id, parent, ord, text) with depth and path, children below their parents in order; sort by path to list a thread.

    Paths double in length each round, so a thread of any depth takes the
    logarithm of it in rounds, each a join of narrow rows. A node whose parent
    isn't there is a root; parents that go round in a circle raise ValueError.
    """
    own = F.array(F.struct("ord", "id"))
    there = nodes.select(F.col("thread").alias("_t"), F.col("id").alias("_p")).distinct()
    start = nodes.join(there, (F.col("thread") == F.col("_t")) & (F.col("parent") == F.col("_p")), "left")
    state = materialize(start.select("thread", "id", F.col("_p").alias("up"), F.when(F.col("_p").isNull(), 0).otherwise(1).alias("depth"), own.alias("path")))
    rounds, most = 0, math.ceil(math.log2(nodes.count() + 2)) + 1
    while not (pending := state.where("up IS NOT NULL")).isEmpty():
        rounds += 1
        if rounds > most:
            raise ValueError("parents that go round in a circle")
        above = state.select(F.col("thread").alias("_t"), F.col("id").alias("_p"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("path").alias("_path"))
        longer = pending.join(above, (F.col("thread") == F.col("_t")) & (F.col("up") == F.col("_p"))).select("thread", "id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), F.concat("_path", "path").alias("path"))
        state = materialize(state.where("up IS NULL").unionByName(longer))
    return nodes.join(state.select("thread", "id", "depth", "path"), ["thread", "id"])
