"""The either-key rule inside a stream, with bounded state (ST2).

A record is stored if neither of its two keys was taken by a stored record (M1). The table-backed sink
(``ingest_stream``) keeps that rule over all history; here a stateful operator holds the taken keys themselves, for
``lateness`` of event time after the record that took them. Rows are grouped by ``scope``, a column such that rows of
different scopes never share a key (the site or the group that ids and urls belong to); each scope's rows
of a round, which ``maxFilesPerTrigger`` bounds, are taken in the order of the ``ordinal`` columns (null first).

A call of the function and a call of the state store cost more than a row does, so scopes are dealt into ``BUCKETS``
groups by hash. What the scopes of a group have taken is one value of the store, which comes with the group's rows and goes
back with its answer. It holds keys of the last ``lateness`` (and up to as long again), each with its scope.

Rows later than the watermark are dropped by Spark, as everywhere in event-time processing. A null key is never
taken; rows without an event time are not late and take their keys until the next expiry. The result equals that of
the two-key sink wherever no key comes back after ``lateness``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Groups that the scopes are dealt into. Part of the checkpoint: a stream goes on with the number it began with.
BUCKETS = 1024


def _rule(ordinal: list[str], numbers: set[str], lateness_ms: int):
    """The rule for a group of scopes. Its state, as JSON: ``taken`` (key -> the event time, in ms, until which it is
    taken) and ``due`` (when the state is looked through)."""
    def place(row) -> list:
        return [(row[c] is not None, Decimal(row[c]) if c in numbers and row[c] is not None else row[c]) for c in ordinal]

    def fn(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = json.loads(state.get[0]) if state.exists else {"taken": {}, "due": []}
        taken, due, now, kept = known["taken"], set(known["due"]), state.getCurrentWatermarkMs(), []
        rows = [] if state.hasTimedOut else [r for pdf in frames for r in pdf["_in"]]
        for r in sorted(rows, key=lambda r: place(r["row"])):
            keys = [r[c] for c in ("key1", "key2") if r[c] is not None]
            if any(k in taken for k in keys):
                continue
            at = int(r["at_ms"]) if r["at_ms"] is not None else now
            for k in keys:
                taken[k] = at + lateness_ms
            # looked through once for each ``lateness`` of event time
            if keys:
                due.add((at // lateness_ms + 2) * lateness_ms)
            kept.append(r["row"])
        if any(t <= now for t in due):
            taken, due = {k: until for k, until in taken.items() if until > now}, {t for t in due if t > now}
        if due:
            state.update((json.dumps({"taken": taken, "due": sorted(due)}),))
            state.setTimeoutTimestamp(min(due))
        elif state.exists:
            state.remove()
        if kept:
            yield pd.DataFrame({"row": kept})
    return fn


def either_key(stream: DataFrame, scope: str, key1: list[str], key2: list[str], ordinal: list[str],
               event_time: str, lateness_seconds: int) -> DataFrame:
    """``stream`` without the rows whose first or second key an earlier row of it has taken. For a query in
    append mode; watermark and state store are set here."""
    spark = stream.sparkSession
    if spark.conf.get(_PROVIDER, None) != _ROCKS:  # the store that keeps its states on disk
        spark.conf.set(_PROVIDER, _ROCKS)
    scoped = F.col(scope).cast("string").alias("scope")

    def set_(which: int, cols: list[str]):
        missing = F.greatest(*[F.isnull(c).cast("int") for c in [*cols, cols[0]]]).cast("boolean")
        return F.when(~missing, F.to_json(F.struct(F.lit(which).alias("which"), scoped, F.struct(*cols).alias("key"))))

    # a UTC wall clock is an instant up to a constant, which changes no difference of times
    at = F.col(event_time).cast("timestamp")
    # numbers go through pandas as text: with nulls among them they would turn into floats there
    numbers = {f.name for f in stream.schema.fields if isinstance(f.dataType, T.NumericType)}
    row = F.struct(*[F.col(c).cast("string").alias(c) if c in numbers else F.col(c) for c in stream.columns])
    out = T.StructType([T.StructField(f.name, T.StringType() if f.name in numbers else f.dataType) for f in stream.schema.fields])
    rows = stream.withColumn("_at", at).withWatermark("_at", f"{lateness_seconds} seconds").select(
        F.struct(row.alias("row"), set_(1, key1).alias("key1"), set_(2, key2).alias("key2"),
                 F.unix_millis("_at").cast("string").alias("at_ms")).alias("_in"),
        F.pmod(F.xxhash64(scoped), F.lit(BUCKETS)).alias("_bucket"), "_at")
    return rows.groupBy("_bucket").applyInPandasWithState(
        _rule(ordinal, numbers, lateness_seconds * 1000), T.StructType([T.StructField("row", out)]), "state string", "append",
        GroupStateTimeout.EventTimeTimeout).select(*[F.col(f"row.{f.name}").cast(f.dataType).alias(f.name) for f in stream.schema.fields])
