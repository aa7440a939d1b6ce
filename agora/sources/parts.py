"""Tables kept in parts, so that a change reads and writes only the parts it touches.

A table is a folder of Parquet folders and a manifest that says which of them make up each part. A change writes
new folders, then a new manifest, and switches the pointer to it in one rename (``sinks.switch_pointer``): readers see
the table before or after, and folders that a change did not touch stay as they are. One writer at a time.

* ``IdTable``: rows by ranges of an id; ``update`` and ``remove`` rewrite the ranges that hold the ids (M3 M4 M7).
* ``KeyTable``: keys by hash, read only where a batch has keys (ST1). Parts that grow too large are split in two, and
  parts of many files are merged, each time one part at a time.
* ``BatchTable``: the rows that each batch of a stream stored; old batches are merged.

What a batch added stands under its number until later batches are merged over it, so a batch that is run
again replaces what it wrote before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agora.sources import sinks

#: An entry of merged folders belongs to no batch.
MERGED = -1


class _Parts:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    # a manifest: {"parts": {part: [[folder, batch, bytes], ...]}}
    def manifest(self) -> dict:
        path = sinks.read_pointer(self.spark, self.root)
        return json.loads(sinks.read_text(self.spark, path)) if path else {"parts": {}}

    def _commit(self, manifest: dict) -> None:
        path = f"{self.root}/manifest-{uuid.uuid4().hex}.json"
        sinks.write_text(self.spark, path, json.dumps(manifest))
        sinks.switch_pointer(self.spark, self.root, path)

    def _read(self, entries: Iterable[list]) -> DataFrame:
        folders = [folder for folder, *_ in entries]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else \
            self.spark.createDataFrame([], self.schema)

    def _write(self, df: DataFrame, part: Column, batch: int = MERGED) -> dict[str, list]:
        """{part: entry} of the rows, one folder a part. The rebalance keeps a part in few files and cuts a large
        one (a hot part) into several tasks."""
        folder = f"{self.root}/data-{uuid.uuid4().hex}"
        rows = df.select(*self.schema.names, part.alias("_part")).hint("rebalance", "_part")
        rows.write.partitionBy("_part").parquet(folder)
        return {name.removeprefix("_part="): [f"{folder}/{name}", batch, size]
                for name, size in sinks.folders(self.spark, folder) if name.startswith("_part=")}

    def read(self) -> DataFrame:
        return self._read(e for entries in self.manifest()["parts"].values() for e in entries)


class IdTable(_Parts):
    """Rows with a unique integer id, ``span`` consecutive ids a part. New rows have the largest ids, so
    annotating what is new touches the last parts only.

    Small parts share folders, so that files and folders grow with the rows and not with the parts: a write puts
    the parts of about ``rows`` ids in a row in one folder. The manifest names the folder of each part, and a row counts
    only where its part is named with the folder it stands in, so a part is rewritten alone and what
    its old folder still holds of it is not read as rows."""

    NO_ID = "__HIVE_DEFAULT_PARTITION__"

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str, span: int = 1_000_000,
                 rows: int = 100_000):
        super().__init__(spark, root, schema)
        self.key, self.span, self.bundle = key, span, max(1, rows // span)

    def _part(self, key: Column) -> Column:
        return F.floor(key / F.lit(self.span)).cast("string")

    def _write(self, df: DataFrame, part: Column, batch: int = MERGED) -> dict[str, list]:
        folder, key = f"{self.root}/data-{uuid.uuid4().hex}", F.col(self.key)
        rows = df.select(*self.schema.names, F.floor(key / F.lit(self.span * self.bundle)).alias("_bundle"))
        (rows.hint("rebalance", "_bundle").sortWithinPartitions("_bundle", self.key)
         .write.partitionBy("_bundle").parquet(folder))
        sizes = {name: size for name, size in sinks.folders(self.spark, folder) if name.startswith("_bundle=")}
        if not sizes:
            return {}
        held = self.spark.read.schema(self.schema).parquet(*[f"{folder}/{name}" for name in sizes]).select(self._part(key)).distinct()
        parts = [p for p, in held.toLocalIterator()]  # as many as the manifest gets
        home = {p: f"_bundle={int(p) // self.bundle if p is not None else self.NO_ID}" for p in parts}
        return {p if p is not None else self.NO_ID: [f"{folder}/{home[p]}", batch, sizes[home[p]]] for p in parts}

    def _rows(self, parts: dict[str, list]) -> DataFrame:
        """The rows of these parts of the manifest."""
        live = [(entry[0], part) for part, entries in parts.items() for entry in entries]
        read = self._read([folder] for folder in dict.fromkeys(folder for folder, _ in live))
        if self.bundle == 1 or not live:  # a folder is a part
            return read
        names = [("/".join(folder.split("/")[-2:]), part) for folder, part in live]
        table = self.spark.createDataFrame(names, "_home string, _name string")
        home = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+/[^/]+)/[^/]+$", 1)
        return (read.withColumns({"_home": home, "_name": F.coalesce(self._part(F.col(self.key)), F.lit(self.NO_ID))})
                .join(F.broadcast(table), ["_home", "_name"], "left_semi").select(*self.schema.names))

    def read(self) -> DataFrame:
        return self._rows(self.manifest()["parts"])

    def append(self, df: DataFrame) -> None:
        manifest = self.manifest()
        for part, entry in self._write(df, self._part(F.col(self.key))).items():
            manifest["parts"].setdefault(part, []).append(entry)
        self._commit(manifest)

    def touched(self, ids: DataFrame) -> list[str]:
        """Parts that hold any of the ids (at most the parts of the manifest)."""
        here = set(self.manifest()["parts"])
        return [p for p, in ids.select(self._part(F.col(self.key))).distinct().toLocalIterator() if p in here]

    def _rewrite(self, touched: list[str], change) -> None:
        manifest = self.manifest()
        if touched:
            old = self._rows({p: manifest["parts"][p] for p in touched})
            new = self._write(change(old), self._part(F.col(self.key)))
            for part in touched:
                manifest["parts"].pop(part)
            manifest["parts"].update({part: [entry] for part, entry in new.items()})
            self._commit(manifest)

    def update(self, changes: DataFrame) -> list[str]:
        """Give the rows whose id is in ``changes`` (ids unique) its other columns; ids that are not stored are
        ignored. Returns the parts rewritten."""
        touched = self.touched(changes)
        values = [c for c in changes.columns if c != self.key]
        new = changes.select(F.col(self.key), F.struct(*values).alias("_new"))
        value = lambda c: F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c))
        self._rewrite(touched, lambda old: old.join(new, self.key, "left").select(*[
            (value(c) if c in values else F.col(c)).alias(c) for c in self.schema.names]))
        return touched

    def remove(self, ids: DataFrame) -> list[str]:
        touched = self.touched(ids)
        self._rewrite(touched, lambda old: old.join(ids.select(self.key), self.key, "left_anti"))
        return touched


class BatchTable(_Parts):
    """The rows that each batch stored. ``most`` batches stand apart before they are merged; ``merge`` is what
    merging does to rows besides (partial sums are added up)."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, most: int = 32, merge=None):
        super().__init__(spark, root, schema)
        self.most, self.merge = most, merge or (lambda rows: rows)

    def put(self, df: DataFrame, batch: int) -> None:
        """Store a batch's rows in place of what the same batch stored before. The batches before it are
        finished (a stream runs them one by one), so they may be merged."""
        manifest = self.manifest()
        entries = [e for e in manifest["parts"].get("0", []) if e[1] != batch]
        single = [e for e in entries if e[1] != MERGED]
        if len(single) >= self.most:  # each row is merged once; merged folders stay as they are
            entries = [e for e in entries if e[1] == MERGED] + list(
                self._write(self.merge(self._read(single)), F.lit("0")).values())
        manifest["parts"]["0"] = entries + list(self._write(df, F.lit("0"), batch).values())
        self._commit(manifest)


class KeyTable(_Parts):
    """Keys (``schema``; a key with a null column is no key) in parts of about ``part_bytes``. A part is named
    ``<depth>-<value>``: it holds the keys whose hash ends in the ``depth`` bits of ``value``."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, part_bytes: int = 64 << 20,
                 most_files: int = 16):
        super().__init__(spark, root, schema)
        self.part_bytes, self.most_files = part_bytes, most_files

    def _hash(self) -> Column:
        return F.xxhash64(*self.schema.names)

    def _parted(self, keys: DataFrame, parts: Iterable[str]) -> DataFrame:
        """``keys`` with ``_part``. Every ending of the deepest part is a slot; their table grows with the parts."""
        known = [tuple(map(int, p.split("-"))) for p in parts] or [(0, 0)]
        deepest = max(d for d, _ in known)
        slots = [(v + (i << d), f"{d}-{v}") for d, v in known for i in range(1 << (deepest - d))]
        table = self.spark.createDataFrame(slots, "_slot long, _part string")
        set_ = keys.select(*self.schema.names).na.drop()
        return (set_.withColumn("_slot", self._hash().bitwiseAND(F.lit((1 << deepest) - 1)))
                .join(F.broadcast(table), "_slot").drop("_slot"))

    def lookup(self, keys: DataFrame, batch: int) -> tuple[DataFrame, int]:
        """(the stored keys of the parts that ``keys`` fall in, but for what ``batch`` itself stored; bytes read)."""
        parts = self.manifest()["parts"]
        wanted = [p for p, in self._parted(keys, parts).select("_part").distinct().toLocalIterator()]
        entries = [e for p in wanted for e in parts.get(p, []) if e[1] != batch]
        return self._read(entries), sum(e[2] for e in entries)

    def add(self, keys: DataFrame, batch: int) -> None:
        manifest = self.manifest()
        if not manifest["parts"]:
            manifest["parts"]["0-0"] = []
        parts = {p: [e for e in entries if e[1] != batch] for p, entries in manifest["parts"].items()}
        for part, entry in self._write(self._parted(keys, parts), F.col("_part"), batch).items():
            parts[part].append(entry)
        self._commit({"parts": parts})

    def tend(self, batch: int) -> None:
        """Split parts that are too large and merge parts of too many files, as far as they are from batches
        before ``batch``; parts that are neither stay untouched. A split part is read once for each doubling."""
        manifest, changed = self.manifest(), False
        for part, entries in list(manifest["parts"].items()):
            old, own = [e for e in entries if e[1] != batch], [e for e in entries if e[1] == batch]
            depth, value = map(int, part.split("-"))
            if own or depth >= 24:
                continue
            if sum(e[2] for e in old) > self.part_bytes:
                halves = [f"{depth + 1}-{value}", f"{depth + 1}-{value + (1 << depth)}"]
                upper = self._hash().bitwiseAND(F.lit(1 << depth)) != 0
                new = self._write(self._read(old), F.when(upper, halves[1]).otherwise(halves[0]))
                del manifest["parts"][part]
                manifest["parts"].update({h: [new[h]] if h in new else [] for h in halves})
            elif len(old) > self.most_files:
                manifest["parts"][part] = list(self._write(self._read(old), F.lit(part)).values())
            else:
                continue
            changed = True
        if changed:
            self._commit(manifest)
