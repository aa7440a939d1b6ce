"""CSV / JSON export sinks (SNK1-SNK4) and the store's table I/O (SRC1, SRC2).

Each entity is written by Spark as a directory of part files (one task per
partition, no driver collect). CSV gets a header, UTF-8, NULL as an empty
field and arrays as JSON text; JSON is JSON Lines with non-ASCII kept and NULL
fields written out.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agora import schemas
from agora.operators.export import normalize


def _is_dir(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def output_paths(base_path: str, file_format: str = "csv", spark: SparkSession | None = None,
                 ) -> dict[str, str]:
    """SNK3: ``<dir>/<stem>_{posts,comments,groups,all}.<fmt>``.

    A directory (existing, or written with a trailing slash) or a name without
    a stem gets the default stem.
    """
    base = base_path.rstrip("/") if base_path not in ("/",) else base_path
    stem = os.path.splitext(os.path.basename(base))[0]
    is_dir = base_path.endswith("/") or not stem or (spark is not None and _is_dir(spark, base))
    if is_dir:
        base_dir, stem = base, schemas.EXPORT_DEFAULT_BASE
    else:
        base_dir = os.path.dirname(base) or "."
    return {e: f"{base_dir}/{stem}_{schemas.EXPORT_SUFFIX[e]}.{file_format}"
            for e in schemas.EXPORT_ENTITIES}


def csv_ready(df: DataFrame) -> DataFrame:
    """The CSV source cannot hold arrays/structs/maps: write them as JSON text."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_entity(df: DataFrame, path: str, file_format: str, entity: str,
                 mode: str = "errorifexists") -> None:
    shaped = normalize(df, entity) if entity != "combined" else df
    if file_format == "csv":
        # RFC 4180: quotes are doubled, not backslash-escaped
        (csv_ready(shaped).write.mode(mode).option("header", True).option("encoding", "UTF-8")
         .option("escape", '"').option("nullValue", "").csv(path))
    elif file_format == "json":
        (shaped.write.mode(mode).option("ignoreNullFields", False)
         .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").json(path))
    else:
        raise ValueError(f"unsupported export format {file_format!r}")


def export(data: dict, base_path: str, file_format: str = "csv",
           spark: SparkSession | None = None, mode: str = "errorifexists") -> dict[str, str]:
    """Write every non-empty entity of ``data``; returns entity -> path written.

    SNK4: an entity with no rows is skipped; if nothing has rows, nothing is
    written. ``isEmpty`` stops at the first row found.
    """
    frames = {k: v for k, v in data.items() if v is not None}
    if not frames:
        return {}
    spark = spark or next(iter(frames.values())).sparkSession
    paths = output_paths(base_path, file_format, spark)
    written = {}
    for entity, df in frames.items():
        if df.isEmpty():
            continue
        write_entity(df, paths[entity], file_format, entity, mode)
        written[entity] = paths[entity]
    return written


def read_back(spark: SparkSession, path: str, file_format: str, schema) -> DataFrame:
    if file_format == "csv":
        return spark.read.schema(schema).option("header", True).option("encoding", "UTF-8") \
            .option("escape", '"').option("multiLine", True).csv(path)
    return spark.read.schema(schema).json(path)


# ---------------------------------------------------------------- store tables
def bootstrap(spark: SparkSession, root: str) -> dict[str, str]:
    """SRC1: create each table as an empty parquet dataset if absent."""
    out = {}
    for name, schema in schemas.TABLES.items():
        path = f"{root.rstrip('/')}/{name}"
        if not exists(spark, path):
            spark.createDataFrame([], schema).write.parquet(path)
        out[name] = path
    return out


def tables_present(spark: SparkSession, root: str) -> bool:
    """SRC1 start-up check: every table exists."""
    return all(exists(spark, f"{root.rstrip('/')}/{n}") for n in schemas.TABLES)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """SRC2: scan a store table with its declared schema."""
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{root.rstrip('/')}/{name}")


def typed_read(df: DataFrame) -> DataFrame:
    """Rows stored the legacy way (keyword lists as JSON text, possibly encoded
    twice; flags as 0/1 integers) -> the typed table columns. Bad keyword JSON
    gives an empty list."""
    from agora.functions.answers import keywords_from_text
    out = df
    for c in ("ai_keywords", "ai_comment_keywords"):
        if c in df.columns and not isinstance(df.schema[c].dataType, T.ArrayType):
            out = out.withColumn(c, keywords_from_text(F.col(c).cast("string")))
    for c in ("ai_is_potential_idea", "is_processed_by_ai", "is_processed_by_ai_comment"):
        if c in df.columns and not isinstance(df.schema[c].dataType, T.BooleanType):
            out = out.withColumn(c, F.col(c).cast("int") != 0)
    return out


# ---------------------------------------------------------------- snapshots (M3 M4 M7)
POINTER = "_CURRENT"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_snapshot(df: DataFrame, root: str, table: str) -> str:
    """Write ``df`` as a new snapshot directory of ``table`` and switch the pointer.

    Plain Parquet has no MERGE/DELETE: an update is a join producing the new
    table, written to a fresh directory (never over a path the plan reads);
    readers follow the pointer, written to a temporary file and renamed into
    place.
    """
    import uuid
    spark = df.sparkSession
    base = f"{root.rstrip('/')}/{table}"
    path = f"{base}/snap-{uuid.uuid4().hex}"
    df.write.parquet(path)
    switch_pointer(spark, base, path)
    return path


def switch_pointer(spark: SparkSession, base: str, path: str) -> None:
    """Make ``path`` the current state of the table in ``base``: one step that replaces the pointer, or
    fails and leaves the old one."""
    import uuid
    fs, tmp = _fs(spark, f"{base}/{POINTER}.{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, True)
    out.writeUTF(path)
    out.close()
    _, final = _fs(spark, f"{base}/{POINTER}")
    jvm = spark.sparkContext._jvm
    overwrite = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(overwrite, 1)
    options[0] = overwrite.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(tmp, final, options)


def read_pointer(spark: SparkSession, base: str) -> str | None:
    fs, ptr = _fs(spark, f"{base}/{POINTER}")
    if not fs.exists(ptr):
        return None
    inp = fs.open(ptr)
    try:
        return inp.readUTF()
    finally:
        inp.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, False)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    inp = fs.open(p)
    try:
        return bytes(inp.readAllBytes()).decode()
    finally:
        inp.close()


def folders(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, bytes of its files) of the folders in a folder."""
    fs, p = _fs(spark, path)
    return [(f.getPath().getName(), fs.getContentSummary(f.getPath()).getLength())
            for f in fs.listStatus(p) if f.isDirectory()]


def current_snapshot(spark: SparkSession, root: str, table: str) -> str | None:
    base = f"{root.rstrip('/')}/{table}"
    path = read_pointer(spark, base)
    if path is None:
        fs, parent = _fs(spark, base)
        if fs.exists(parent) and any(f.getPath().getName().startswith("snap-") for f in fs.listStatus(parent)):
            raise RuntimeError(f"table {table} has snapshots but no pointer to the current one")
    return path


def read_current(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The table as of its current snapshot (empty with the declared schema if none)."""
    path = current_snapshot(spark, root, table)
    if path is None:
        return spark.createDataFrame([], schemas.TABLES[table])
    return spark.read.schema(schemas.TABLES[table]).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
