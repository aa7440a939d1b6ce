"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.session import scratch_path, ship_package

#: Characters (or bytes) that a task handles at once in numpy.
BATCH_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch: texts and pages are long, and a task holds a batch in both the JVM and Python.
BATCH_ROWS = 1024


def prepared(spark: SparkSession) -> None:
    """Make the package importable in the executors' Python workers, and bound what they hold."""
    ship_package(spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Spark's own setting that frees a query's shuffle files when it ends.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the cluster's shared folder and read it back: fixes its rows, cuts its
    lineage, frees the shuffle files behind it and survives the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_FREE)
    spark.conf.set(_FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREE, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def fix_split(spark: SparkSession) -> None:
    """Cut stored tables the same way in each scan of this session: by itself Spark cuts by the cores
    that are registered at that moment, which change as executors come and go."""
    least = "spark.sql.files.minPartitionNum"
    if spark.conf.get(least, None) is None:
        cores = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
        # few executors may have come yet
        spark.conf.set(least, max(int(cores or spark.sparkContext.defaultParallelism), shuffle_parts(spark)))


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` plus ``_row``, a number for each row. A file scan yields the same rows in the same
    partitions each time (``fix_split``), so the number is stable when a task is run again, and the same in
    another scan of the table; repeated rows and null ids stay apart. ``docs`` must be a stored
    table (or a projection of one), as everywhere in this subpackage."""
    fix_split(docs.sparkSession)
    return docs.select(F.monotonically_increasing_id().alias("_row"),
                       *[F.col(c) for c in columns])


def numbered(docs: DataFrame) -> DataFrame:
    """``doc``, a struct of all columns (so that their names clash with nothing), and ``_row`` as in ``keyed``."""
    fix_split(docs.sparkSession)
    return docs.select(F.monotonically_increasing_id().alias("_row"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def chunked(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes add up to ``limit`` at most (a
    larger item stands alone)."""
    start, total, i = 0, 0, -1
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if i >= start:
        yield start, i + 1
