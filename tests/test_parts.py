"""Tables kept in parts: partial rewrites (M3 M4 M7), stored keys (ST1), batches; the streams on them (ST2)."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agora.operators import ingest
from agora.session import scratch_path
from agora.sources.parts import MERGED, BatchTable, IdTable, KeyTable
from agora.streaming import ingest_stream as S
from agora.streaming.either_key import either_key
from tests import models

ROWS = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType()),
                     T.StructField("stamp", T.TimestampNTZType())])


def files(table):
    return {p: sorted((f, os.stat(os.path.join(e[0].removeprefix("file:"), f)).st_mtime_ns)
                      for e in entries for f in os.listdir(e[0].removeprefix("file:")) if f.endswith(".parquet"))
            for p, entries in table.manifest()["parts"].items()}


def test_update_rewrites_only_what_it_touches(spark):
    table = IdTable(spark, scratch_path(spark, "t"), ROWS, "id", span=100)
    table.append(spark.range(1000).select("id", F.col("id").cast("string").alias("v"),
                                          F.lit(None).cast("timestamp_ntz").alias("stamp")))
    before = files(table)
    assert len(before) == 10
    at = dt.datetime(2024, 1, 2, 3)
    new = spark.createDataFrame([(5, None, at), (420, "x", at), (99999, "gone", at)], ROWS)
    assert sorted(table.update(new)) == ["0", "4"]
    after = files(table)
    assert {p for p in before if before[p] != after[p]} == {"0", "4"}
    got = {r["id"]: (r["v"], r["stamp"]) for r in table.read().collect()}
    assert len(got) == 1000 and got[5] == (None, at) and got[420] == ("x", at) and got[421] == ("421", None)
    assert table.remove(spark.createDataFrame([(421,), (-7,)], "id long")) == ["4"]
    assert 421 not in {r["id"] for r in table.read().collect()} and table.read().count() == 999
    table.remove(spark.range(100, 200))  # a part without rows is gone
    assert "1" not in table.manifest()["parts"] and table.read().count() == 899


def test_a_failed_update_leaves_the_table(spark):
    table = IdTable(spark, scratch_path(spark, "t"), ROWS, "id", span=10)
    table.append(spark.range(30).select("id", F.lit("a").alias("v"), F.lit(None).cast("timestamp_ntz").alias("stamp")))
    before = table.manifest()
    bad = spark.range(5).select("id", F.raise_error(F.lit("lost")).cast("string").alias("v"))
    with pytest.raises(Exception):
        table.update(bad)
    assert table.manifest() == before and table.read().count() == 30
    assert IdTable(spark, scratch_path(spark, "t"), ROWS, "id").read().count() == 0


KEYS = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.LongType())])


def test_keys_survive_splits_and_merges(spark):
    table = KeyTable(spark, scratch_path(spark, "k"), KEYS, part_bytes=4000, most_files=3)
    stored, rng = set(), random.Random(1)
    for batch in range(12):
        table.tend(batch)
        new = [(f"k{rng.randrange(10**6)}", rng.choice((1, 2, None))) for _ in range(60)]
        table.add(spark.createDataFrame(new, KEYS), batch)
        table.add(spark.createDataFrame(new, KEYS), batch)  # the round runs again
        stored |= {k for k in new if k[1] is not None}
    manifest = table.manifest()["parts"]
    assert len(manifest) > 2 and any(e[1] == MERGED for es in manifest.values() for e in es)
    # parts cover all endings once
    assert sum(2.0 ** -int(p.split("-")[0]) for p in manifest) == 1.0
    assert sorted(map(tuple, table.read().collect())) == sorted(stored)
    some = rng.sample(sorted(stored), 3)
    found, size = table.lookup(spark.createDataFrame(some + [("none", 1), ("null", None)], KEYS), 99)
    assert set(some) <= set(map(tuple, found.collect()))
    assert 0 < size < sum(e[2] for es in manifest.values() for e in es)
    own = set(map(tuple, table.lookup(spark.createDataFrame(new, KEYS), 11)[0].collect()))
    assert not own & (set(new) - (stored - set(new)))  # what the round itself stored is not seen by it


def test_batches_are_merged_and_replaced(spark):
    table = BatchTable(spark, scratch_path(spark, "b"), KEYS, most=3)
    for batch in range(9):
        for _ in range(2):
            table.put(spark.createDataFrame([(f"r{batch}", i) for i in range(batch + 1)], KEYS), batch)
    table.put(spark.createDataFrame([], KEYS), 9)
    assert table.read().count() == 45
    assert len(table.manifest()["parts"]["0"]) <= 6


def _run(spark, rounds, sink):
    schema = "ordinal long, k1 string, k2 string"
    landing, ckpt = scratch_path(spark, "landing"), scratch_path(spark, "ckpt")
    for rows in rounds:
        S.land_files(spark.createDataFrame(rows, schema), landing, n_files=1)
    return S.run_ingest_stream(spark, landing, spark.createDataFrame([], schema).schema, "", ckpt, lambda d: d, sink,
                               max_files_per_trigger=1)


def feed(rounds, per, keys, seed=3):
    rng = random.Random(seed)
    return [[(r * 1000 + i, None if rng.random() < 0.1 else f"a{rng.randrange(keys)}", f"b{rng.randrange(keys)}")
             for i in range(per)] for r in range(rounds)]


def test_indexed_sink_is_sequential(spark):
    rounds = feed(4, 40, 90)
    store = scratch_path(spark, "store")
    _run(spark, [*rounds, rounds[0]], S.indexed_sink(store, [["k1"], ["k2"]], "ordinal", part_bytes=1500,
                                                     most_files=2, most_batches=2))
    schema = spark.createDataFrame([], "ordinal long, k1 string, k2 string").schema
    got = sorted(r["ordinal"] for r in S.stored_rows(spark, store, schema).collect())
    assert got == sorted(models.sequential_two_key([x for r in rounds for x in r]))


def test_bytes_read_do_not_grow_with_history(spark):
    store, metrics = scratch_path(spark, "store"), []
    sink = S.indexed_sink(store, [["k1"], ["k2"]], "ordinal", metrics, part_bytes=6000, most_files=4)
    rng = random.Random(8)
    for batch in range(10):  # large rounds build the history, small ones are measured
        n = 400 if batch % 2 == 0 else 2
        rows = [(batch * 10_000 + i, f"a{rng.randrange(10**9)}", f"b{rng.randrange(10**9)}") for i in range(n)]
        sink(spark.createDataFrame(rows, "ordinal long, k1 string, k2 string"), batch)
    small = [m["key_bytes_read"] for m in metrics if m["inserted"] == 2]
    history = sum(e[2] for es in KeyTable(spark, f"{store}/key1", KEYS).manifest()["parts"].values() for e in es)
    assert len(small) == 5 and small[-1] <= 2 * small[0] and small[-1] < history


def test_a_replayed_round_changes_nothing(spark):
    rounds, store = feed(2, 30, 50), scratch_path(spark, "store")
    sink = S.indexed_sink(store, [["k1"], ["k2"]], "ordinal", part_bytes=1500, most_files=2)
    schema = "ordinal long, k1 string, k2 string"
    for batch, rows in ((0, rounds[0]), (1, rounds[1]), (1, rounds[1])):
        sink(spark.createDataFrame(rows, schema), batch)
    got = S.stored_rows(spark, store, spark.createDataFrame([], schema).schema)
    assert sorted(r["ordinal"] for r in got.collect()) == sorted(models.sequential_two_key(rounds[0] + rounds[1]))


# ---------------------------------------------------------------- either key in operator state
EVENT = "ordinal long, site string, k1 string, k2 string, ts timestamp_ntz"


def _either(spark, rounds, lateness):
    landing, out = scratch_path(spark, "landing"), scratch_path(spark, "out")
    for rows in rounds:
        S.land_files(spark.createDataFrame(rows, EVENT), landing, n_files=1)
    schema = spark.createDataFrame([], EVENT).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing)
    kept = either_key(stream, "site", ["k1"], ["k2"], ["ordinal"], "ts", lateness)
    q = (kept.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "ckpt"))
         .outputMode("append").trigger(availableNow=True).start(out))
    q.awaitTermination()
    state = [p["stateOperators"][0]["numRowsTotal"] for p in map(dict, q.recentProgress) if p.get("stateOperators")]
    return sorted(r["ordinal"] for r in spark.read.schema(schema).parquet(out).collect()), state


def test_either_key_is_sequential_over_rounds(spark):
    rng, at = random.Random(6), dt.datetime(2024, 1, 1)
    rounds = [[(r * 100 + i, s := rng.choice("xy"), None if rng.random() < 0.2 else f"{s}a{rng.randrange(25)}",
                f"{s}b{rng.randrange(25)}", at + dt.timedelta(minutes=r)) for i in range(40)] for r in range(3)]
    got, _ = _either(spark, [*rounds, rounds[1]], 86400)
    assert got == sorted(models.sequential_two_key([(o, a, b) for r in rounds for o, _, a, b, _ in r]))


def test_either_key_forgets_behind_the_watermark(spark):
    at = dt.datetime(2024, 1, 1)
    day = lambda r: at + dt.timedelta(days=r)
    rounds = [[(r * 100 + i, "x", f"a{r}.{i}", f"b{r}.{i}", day(r)) for i in range(20)] for r in range(8)]
    rounds.append([(900, "x", "a0.0", "b9", day(9))])      # taken nine days ago: free again
    rounds.append([(901, "x", "a0.0", "b10", day(9))])     # taken just now
    rounds.append([(902, "x", "new", "new", day(0))])      # later than the watermark
    got, state = _either(spark, rounds, 86400)
    assert got == [o for r in rounds[:8] for o, *_ in r] + [900]
    assert max(state) <= 2 * 20 * 5  # two keys a record, of the last days only


def test_either_key_calls_no_function_for_every_scope(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, f"s{i % 3000}", f"a{i % 2}", None, at) for i in range(9000)]  # scopes may hold equal keys
    got, state = _either(spark, [rows], 86400)
    assert got == sorted({(s, a): o for o, s, a, _, _ in reversed(rows)}.values())
    assert max(state) <= 1024  # not one state for each of 3000 scopes


def test_either_key_keeps_whole_numbers(spark):
    schema, landing, out = "id long, site string, k long, ts timestamp_ntz", *[scratch_path(spark, n) for n in ("in", "out")]
    at = dt.datetime(2024, 1, 1)
    rows = [(2**60 + 1, "x", 2**60 + 1, at), (None, "x", None, at), (2**60 + 3, "x", 2**60 + 1, at)]
    S.land_round(spark.createDataFrame(rows, schema).repartition(3), landing)
    kept = either_key(spark.readStream.schema(schema).parquet(landing), "site", ["k"], ["id"], ["id"], "ts", 86400)
    (kept.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "ckpt")).outputMode("append")
     .trigger(availableNow=True).start(out).awaitTermination())
    assert {tuple(r) for r in spark.read.schema(schema).parquet(out).collect()} == set(rows[:2])
