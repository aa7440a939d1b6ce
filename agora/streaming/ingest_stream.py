"""Incremental ingest with Structured Streaming (ST1-ST4).

    readStream (file source over landed files, ``maxFilesPerTrigger`` bounds a
    round) -> stateless preparation (e.g. page extraction) -> foreachBatch:
    de-duplicating insert against everything already stored (exact, unbounded:
    the history lives in the table, not in operator state) -> write the batch's
    rows into its own ``_batch=<id>`` partition.

A replayed micro-batch overwrites only its own partition and ignores its own
earlier output when de-duplicating, so a retry after a failure is idempotent.
``indexed_sink`` does the same against a key table that is read only where the batch has keys, so
that a round does not read the history.
``trigger(availableNow=True)`` processes what has landed and stops (ST4: "no new
input" ends the run). Checkpoints and the store live in the shared folder.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agora.operators import ingest
from agora.operators.stats import run_counters
from agora.sources.parts import BatchTable, KeyTable

log = logging.getLogger(__name__)

BATCH_COL = "_batch"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def read_store(spark: SparkSession, store: str, rows: T.StructType) -> DataFrame | None:
    """The stored rows (of schema ``rows``) with their batch number; read with the
    declared schema, as batches without rows leave no files to infer one from."""
    if not _exists(spark, store):
        return None
    return spark.read.schema(T.StructType([*rows.fields, T.StructField(BATCH_COL, T.IntegerType())])).parquet(store)


def _stored_before(batch: DataFrame, store: str, batch_id: int) -> DataFrame | None:
    stored = read_store(batch.sparkSession, store, batch.schema)
    if stored is None:
        return None
    return stored.filter(F.col(BATCH_COL) != F.lit(int(batch_id))).drop(BATCH_COL)


def _write_batch(df: DataFrame, store: str, batch_id: int, metrics: list | None = None) -> None:
    """Write the batch's rows; A10: the inserted count is observed during the write."""
    out, obs = run_counters(df, f"inserted_{batch_id}_{id(df)}", inserted=F.count(F.lit(1)))
    (out.withColumn(BATCH_COL, F.lit(int(batch_id)))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(BATCH_COL).parquet(store))
    if metrics is not None:
        metrics.append({"batch_id": int(batch_id), **obs.get})


def one_key_sink(store: str, key_cols: list[str], ordinal: str, metrics: list | None = None
                 ) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: first-wins insert on one unique key (M2 + ST2)."""
    def process(batch: DataFrame, batch_id: int) -> None:
        inserted, _ = ingest.insert_one_key(_stored_before(batch, store, batch_id), batch, key_cols, ordinal)
        _write_batch(inserted, store, batch_id, metrics)
    return process


def two_key_sink(store: str, key1: list[str], key2: list[str], ordinal: str,
                 metrics: list | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: first-wins insert on two unique keys (M1 + ST2).

    Rows sharing an ordinal are told apart by their content, so different records are
    all offered to the two-key rule and a re-scrape in the same round is ignored by it.
    """
    def process(batch: DataFrame, batch_id: int) -> None:
        inserted, _, _ = ingest.insert_two_keys(_stored_before(batch, store, batch_id), batch, key1, key2, ordinal)
        _write_batch(inserted, store, batch_id, metrics)
    return process


def indexed_sink(store: str, keys: list[list[str]], ordinal: str, metrics: list | None = None,
                 part_bytes: int = 64 << 20, most_files: int = 16, most_batches: int = 32,
                 ) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: first-wins insert on one or two unique keys (M1 M2 + ST2), equal to the sinks above.

    ``store``/rows holds the rows of each batch (``stored_rows`` reads them), ``store``/key1 and key2 the stored
    keys by hash. A round reads the parts that its keys fall in: at most as many as it has keys, each of about
    ``part_bytes`` however long the history is. A replayed round ignores and replaces what it stored before.
    """
    def process(batch: DataFrame, batch_id: int) -> None:
        spark, names = batch.sparkSession, batch.columns
        rows = ingest.cut_lineage(batch)   # prepared once
        tables = [KeyTable(spark, f"{store}/key{i}", T.StructType([batch.schema[c] for c in cols]), part_bytes, most_files)
                  for i, cols in enumerate(keys, 1)]
        found, read = [], 0
        for table, cols in zip(tables, keys):
            table.tend(batch_id)
            stored, size = table.lookup(rows.select(*cols), batch_id)
            found.append(stored)
            read += size
        if len(keys) == 1:
            inserted, _ = ingest.insert_one_key(found[0], rows, keys[0], ordinal)
        else:
            taken = [d.select(ingest.key_col(*cols).alias(f"_k{i}")) for i, (d, cols) in enumerate(zip(found, keys), 1)]
            inserted, _, _ = ingest.insert_two_keys(None, rows, *keys, ordinal, taken=tuple(taken))
        inserted = ingest.cut_lineage(inserted.select(*names))
        BatchTable(spark, f"{store}/rows", batch.schema, most_batches).put(inserted, batch_id)
        for table, cols in zip(tables, keys):
            table.add(inserted.select(*cols), batch_id)
        if metrics is not None:
            metrics.append({"batch_id": int(batch_id), "inserted": inserted.count(), "key_bytes_read": read})
    return process


def stored_rows(spark: SparkSession, store: str, schema: T.StructType) -> DataFrame:
    """What ``indexed_sink`` has stored."""
    return BatchTable(spark, f"{store}/rows", schema).read()


def run_ingest_stream(spark: SparkSession, source_dir: str, schema, store: str,
                      checkpoint: str, prepare: Callable[[DataFrame], DataFrame],
                      sink: Callable[[DataFrame, int], None],
                      max_files_per_trigger: int | None = None, fmt: str = "parquet") -> dict:
    """Run the incremental ingest until everything landed so far is stored."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    stream = prepare(reader.load(source_dir))
    q = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    progress = q.recentProgress
    return {"batches": len(progress),
            "input_rows": sum(int(p.get("numInputRows", 0)) for p in progress)}


def dedup_within_watermark(stream: DataFrame, key_cols: list[str], event_time: str,
                           lateness: str) -> DataFrame:
    """ST2, bounded variant: drop repeats of a key seen within ``lateness`` of event
    time, with operator state bounded by the watermark. Use it when a bound on
    lateness is acceptable and one key identifies a record; the exact, unbounded
    rule (and the either-key rule) is the table-backed sink above."""
    # watermarks need TIMESTAMP; a UTC wall-clock NTZ column is cast (a constant
    # zone offset does not change lateness)
    if dict(stream.dtypes).get(event_time) == "timestamp_ntz":
        wm = "_event_ts"
        stream = stream.withColumn(wm, F.col(event_time).cast("timestamp"))
    else:
        wm = event_time
    out = stream.withWatermark(wm, lateness).dropDuplicatesWithinWatermark(key_cols)
    return out.drop("_event_ts") if wm == "_event_ts" else out


def land_files(df: DataFrame, landing: str, n_files: int, copies: int = 1) -> None:
    """Write ``df`` as ``n_files`` files per copy into ``landing`` (a replayed
    feed: every copy after the first is a re-scrape of the same records)."""
    for _ in range(copies):
        df.repartition(n_files).write.mode("append").parquet(landing)


def land_round(df: DataFrame, landing: str) -> None:
    """Write ``df`` into ``landing`` in as many files as its partitions: one round of a stream that is run after
    each landing. No task holds the whole round."""
    df.write.mode("append").parquet(landing)
