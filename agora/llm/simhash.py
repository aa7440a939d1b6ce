"""SimHash near-duplicates with pivot distance tables.

A text's fingerprint has a bit set when over half of its word shingles have it set
in their XXH64. Two fingerprints link at ``max_bits`` or fewer differing bits.

Pairs are compared inside cells only: the 64 bits are cut into ``blocks`` blocks, and
two fingerprints with at most ``max_bits`` differing bits agree in at least
``blocks - max_bits`` of them, so they meet under one choice of that many blocks. In a
cell each fingerprint has its row of the pivot table, the Hamming distances to
``PIVOTS`` reference fingerprints; by the triangle inequality a pair whose rows
differ by more than ``max_bits`` in any coordinate cannot link and is discarded, and
only the survivors are verified by their own distance. (The cells are needed because
distances to random references of 64 bits all lie near 32: as the only index they
discard too little.) A cell of many fingerprints is dealt over tiles of bounded
size. A task emits, for each member of a cell, one link to its component there, never
all pairs, which keeps every component whole.

Results: one row per input row. A null text is empty and has fingerprint zero, which
links like any other. ``component_id`` is the smallest non-null doc_id reachable (null if
there is none). Rows with equal fingerprints are one node, so copies cost nothing.
Repeated rows stay. Other columns are ignored. No rows give no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.common import keyed, materialize, numbered, prepared
from agora.llm.components import components

SEED = 42
SHINGLE = 4
MAX_BITS = 4
BLOCKS = 7
#: Reference fingerprints of the pivot table.
PIVOTS = 32
#: Fingerprints that one part of a crowded cell holds, about.
PART = 512
_AT_ONCE = 1 << 15


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """The fingerprint of a text's UTF-8 bytes, as a signed 64-bit integer."""
    words = (text or b"").lower().split()  # ASCII only, as bytes
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    last = ends[size - 1:] or ends[-1:]
    n = len(last)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _AT_ONCE):
        digests = b"".join([xxhash.xxh64_digest(joined[s:e - 1], SEED)
                            for s, e in zip(starts[at:at + _AT_ONCE], last[at:at + _AT_ONCE])])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """_row, doc_id, fp long."""
    prepared(docs.sparkSession)
    rows = keyed(docs, "doc_id", "text").select("_row", "doc_id", F.col("text").cast("binary").alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py(), size) for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("doc_id"), fps],
                                             ["_row", "doc_id", "fp"])

    return rows.mapInArrow(hashed, "_row long, doc_id long, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """``n`` reference fingerprints: the hashes of the numbers 1 to n."""
    return np.array([xxhash.xxh64_intdigest(str(i), SEED) for i in range(1, n + 1)], np.uint64)


def choices(blocks: int = BLOCKS, max_bits: int = MAX_BITS) -> list[int]:
    """A mask (signed) for each choice of ``blocks - max_bits`` blocks."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [sum(1 << b for b in range(lo, hi)) for lo, hi in itertools.pairwise(cuts)]
    masks = [sum(c) for c in itertools.combinations(parts, blocks - max_bits)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def linked(cell: np.ndarray, fps: np.ndarray, max_bits: int, refs: np.ndarray) -> np.ndarray:
    """For each row the index of a row that it is linked to, through others of its
    cell or itself. Rows of a cell are adjacent; all its pairs are compared, but for
    those that are joined already."""
    n = len(fps)
    label = np.arange(n)
    if not n:
        return label
    # a row's cell ends before this index
    end = np.append(np.flatnonzero(np.diff(cell)) + 1, n)[np.cumsum(np.append(0, np.diff(cell) != 0))]
    table = np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)
    active, step = np.arange(n), 1
    while len(active := active[active + step < end[active]]):
        i, j = active, active + step
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        for k in range(0, len(refs), 8):  # discard by the largest coordinate difference
            near = (np.abs(table[i, k:k + 8] - table[j, k:k + 8]) <= max_bits).all(axis=1)
            i, j = i[near], j[near]
        near = np.bitwise_count(fps[i] ^ fps[j]) <= max_bits
        i, j = i[near], j[near]
        if len(i):
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while (up := parent.get(x, x)) != x:
                    x = up
                return x

            for p, q in zip(label[i].tolist(), label[j].tolist()):
                p, q = root(p), root(q)
                if p != q:
                    parent[max(p, q)] = min(p, q)
            new = np.arange(n)
            for x in parent:
                new[x] = root(x)
            label = new[label]
        step += 1
    return label


def links(distinct: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``: not all pairs, but enough
    that their components are those of all pairs."""
    masks = choices(blocks, max_bits)
    cells = distinct.select("fp", F.posexplode(F.array(
        *[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "cell"))
    # stored, so that a crowded cell is a key that Spark can split in the join
    crowd = materialize(cells.groupBy("choice", "cell").agg(F.count("*").alias("n")).where("n > 1"), "simhash")
    parts = F.ceil(F.col("n") / PART).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    met = cells.join(crowd, ["choice", "cell"]).withColumn("parts", parts).withColumn("own", own)
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(
        F.array_remove(F.sequence(F.lit(0), F.col("parts") - 1), F.col("own")))
    tiles = (met.withColumn("other", F.explode(others))
             .select(F.xxhash64("choice", "cell", F.least("own", "other"), F.greatest("own", "other"))
                     .alias("tile"), "fp"))
    refs = pivots()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                if sum(b.num_rows for b in held) < _AT_ONCE:
                    continue
            if not held:
                break
            tile, fps = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("tile", "fp"))
            # the last tile may go on in the next batch
            done = int(np.searchsorted(tile, tile[-1])) if batch is not None else len(tile)
            held = [pa.RecordBatch.from_arrays([pa.array(tile[done:]), pa.array(fps[done:])], ["tile", "fp"])]
            label = linked(tile[:done], fps[:done].view(np.uint64), max_bits, refs)
            at = np.flatnonzero(label != np.arange(done))
            yield pa.RecordBatch.from_arrays([pa.array(fps[at]), pa.array(fps[label[at]])], ["a", "b"])

    return (tiles.repartition("tile").sortWithinPartitions("tile", "fp")
            .mapInArrow(compare, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """_row, doc_id, fingerprint string, component_id, component (a fingerprint that
    stands for it) for every row of ``docs``."""
    fps = materialize(fingerprints(docs, size), "simhash")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(distinct, max_bits), "a", "b")
    classes = materialize(distinct.join(found, distinct["fp"] == found["id"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")), "simhash")
    # stored before the join with it, so that Spark can split a hot component
    least = materialize(classes.groupBy("component").agg(F.min("first").alias("component_id")), "simhash")
    named = classes.join(least, "component").select("fp", "component", "component_id")
    return fps.join(named, "fp").select(
        "_row", "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id", "component")


def one_of_each(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with
    the smallest doc_id (null last; then the first stored)."""
    kept = (near_duplicates(docs, size, max_bits).groupBy("component")
            .agg(F.min_by("_row", F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("_row"))
            .select("_row"))
    return numbered(docs).join(kept, "_row", "left_semi").select("doc.*")
