"""A ledger of model answers (UDF1, UDF4): an answered prompt is never sent again.

Answers are stored under a key of what was asked, in Parquet below the shared folder. Prompts whose key is stored are
not sent; equal prompts are sent once. A task holds few prompts and its answers become part of the
ledger when it ends (Hadoop's committer version 2), so a lost executor, a failed task or a failed job
repeats only the prompts of tasks that had not ended. A call that failed is not stored: its prompt is asked
again by the next run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agora.operators import annotate
from agora.operators.ingest import cut_lineage
from agora.session import ship_package
from agora.sources import sinks

#: Prompts that a task sends at least, about: what a lost task asks again. Where these make more than ``TASKS`` tasks
#: a core, a task sends more, so that tasks and files of the ledger do not grow with the prompts.
PER_TASK, TASKS = 8, 16
LEDGER = T.StructType([T.StructField(c, T.StringType()) for c in ("key", "answer", "run")])


def prompt_key(annotator: str) -> Column:
    """What the same annotator would be asked again."""
    return F.sha2(F.concat_ws("\x1f", F.lit(annotator), "system", "user"), 256)


def read_ledger(spark, path: str) -> DataFrame:
    """key, answer, run: one row a key (two attempts of a task may both have stored theirs)."""
    if not sinks.exists(spark, path):
        return spark.createDataFrame([], LEDGER)
    rows = spark.read.schema(LEDGER).parquet(path)
    return rows.groupBy("key").agg(F.min(F.struct("run", "answer")).alias("r")).select("key", "r.answer", "r.run")


def annotate_with_ledger(prompts: DataFrame, path: str, annotator: str = "offline", options: dict | None = None,
                         retry: dict | None = None, run: str = "", per_task: int | None = None,
                         concurrency: int | None = None) -> DataFrame:
    """(batch_id, system, user, n_items) -> (batch_id, n_items, answer, run), answers from the ledger at ``path``
    after the prompts that it lacks were sent, ``per_task`` a task (``None``: few, within a bounded number of tasks). ``run`` is stored with new answers. ``concurrency`` bounds the calls at
    once: the prompts then go in jobs of so many tasks."""
    spark = prompts.sparkSession
    ship_package(spark)
    factory, opts, rkw = annotate.factory_of(annotator), dict(options or {}), dict(retry or {})
    asked = cut_lineage(prompts.select("batch_id", "n_items", "system", "user", prompt_key(annotator).alias("key")))

    @F.pandas_udf(T.StringType())
    def call(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        fn = factory(**opts)
        for system, user in it:
            yield pd.Series([annotate.call_with_retry(fn, s, u, **rkw) for s, u in zip(system, user)], dtype=object)

    call = call.asNondeterministic()
    new = cut_lineage(asked.join(read_ledger(spark, path).select("key"), "key", "left_anti")
                      .groupBy("key").agg(F.first("system").alias("system"), F.first("user").alias("user")))
    count = new.count()
    if per_task is None:
        per_task = max(PER_TASK, -(-count // (TASKS * spark.sparkContext.defaultParallelism)))
    tasks = -(-count // per_task)
    wave = min(tasks, int(concurrency or tasks))
    waves = -(-tasks // wave) if tasks else 0
    for i in range(waves):
        part = new if waves == 1 else new.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == i)
        with annotate.small_batches(spark, annotate.CALL_PROMPTS):
            (part.repartition(max(1, wave), "key").select("key", call(F.col("system"), F.col("user")).alias("answer"))
             .where("answer IS NOT NULL").withColumn("run", F.lit(run)).write.mode("append")
             .option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path))
    return cut_lineage(asked.join(read_ledger(spark, path), "key", "left").select("batch_id", "n_items", "answer", "run"))
