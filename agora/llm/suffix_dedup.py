"""Repeated passages by the groups that a depth-limited radix sort of suffixes would form.

Every byte covered by a ``depth``-byte string that also starts elsewhere (in any text, the
same one included) is removed. A radix sort by most-significant-digit passes through ``depth`` bytes
would leave exactly the repeated windows in its last groups. Only the groups are needed, so no suffix is
put in order: the passes here group by 64-bit hashes of parts of a window, and what is alone in its group
after a pass is done:

1. *First digit.* Each window of ``depth`` bytes holds a minimizer, the ``KMER``-byte string of
   smallest hash in it. Neighbouring windows with one minimizer form a stretch, the
   unit that is sorted: only about 1.5 % of all suffixes become rows. Equal windows have
   equal minimizers at equal offsets, so a stretch whose minimizer occurs once is done.
2. *Whole stretch.* Stretches equal as a whole hold equal windows only: all are repeated.
3. *Core digit.* Of the other stretches (and of one in each group of equal ones), the windows are taken in blocks of ``BLOCK`` neighbouring
   offsets by the bytes they all share; blocks alone in their group are done.
4. *Last digit.* The windows of the blocks that are left, by all their bytes.

Groups are counted with partial aggregates and joined back (never gathered), so a
passage that a third of all texts share is no hot task. Digits are compared by 64-bit hashes
within the group of an equal minimizer.

Results: one row per input row; a null text is empty; texts under ``depth`` bytes lose
nothing; repeated rows are separate texts, so all their windows repeat. Texts of any
length are cut into overlapping segments, with the same result. No rows give no rows.
Other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.common import BATCH_CHARS, chunked, keyed, materialize, numbered, prepared, release

DEPTH = 200
KMER = 64
BLOCK = 16
#: Bits for a position in the packed (hash, position) that minimizers are chosen by.
_POS = 22
#: Bits for the minimizer's offset and for the number of windows of a stretch, and the most that they hold.
_SPAN = 16
_COUNT = (1 << _SPAN) - 1
_TABLE = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) | 1 for b in range(256)], np.uint64)


def _hash_all(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k``-byte string, by joining hashes of halves."""
    h, have, out, got = _TABLE[data], 1, None, 0
    while True:
        if k & have:
            if out is None:
                out, got = h, have
            else:
                n = len(out) - have if len(out) > have else 0
                out = h[:n] * np.uint64(0x9E3779B97F4A7C15 + 2 * have) + out[have:have + n]
                got += have
        if have * 2 > k:
            break
        h = h[:-have] * np.uint64(0xD6E8FEB86659FD93 + 2 * have) + h[have:]
        have *= 2
    out = out ^ (out >> np.uint64(32))
    out = out * np.uint64(0xFF51AFD7ED558CCD)
    return out ^ (out >> np.uint64(29))


def _slide_min(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[:len(v) - (width - have)], v[width - have:]) if width > have else v


def stretches(texts: list[bytes], depth: int = DEPTH, kmer: int = KMER):
    """Of texts joined end to end: the index of the text, then the first window's start, the
    minimizer's place and the number of windows of each stretch, in joined positions."""
    lengths = np.array([len(t) for t in texts])
    joined = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(lengths)
    if not len(joined) or lengths.max() < depth:
        none = np.empty(0, np.int64)
        return none, none, none, none
    h = _hash_all(joined, kmer)
    order = (h >> np.uint64(_POS) << np.uint64(_POS)) | np.arange(len(h), dtype=np.uint64)
    least = _slide_min(order, depth - kmer + 1)
    starts = np.arange(len(least))
    owner = np.repeat(np.arange(len(texts)), lengths)[:len(least)]
    inside = starts + depth <= ends[owner]
    starts, owner = starts[inside], owner[inside]
    at = (least[inside] & np.uint64((1 << _POS) - 1)).astype(np.int64)
    new = np.flatnonzero(np.append(True, (np.diff(at) != 0) | (np.diff(starts) != 1)))
    return owner[new], starts[new], at[new], np.diff(np.append(new, len(starts)))


def _digest(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([xxhash.xxh3_64_digest(p) for p in parts]), ">i8").astype(np.int64)


def _segments(rows, depth: int):
    """(row, base, bytes): long texts in segments whose windows are disjoint."""
    for row, text in rows:
        for base in range(0, max(len(text) - depth + 1, 0), BATCH_CHARS):
            yield row, base, text[base:base + BATCH_CHARS + depth - 1]


def _scan(docs: DataFrame, depth: int) -> DataFrame:
    """First digit: _row, span (start, minimizer's offset and windows, packed), hk of the minimizer,
    hs of the whole stretch."""
    kmer = min(KMER, depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("_row").to_pylist(), (t.as_py() or b"" for t in batch.column("text")))
            segments = list(_segments(rows, depth))
            for lo, hi in chunked((len(s[2]) for s in segments), BATCH_CHARS):
                part = segments[lo:hi]
                owner, first, at, n = stretches([s[2] for s in part], depth, kmer)
                if not len(owner):
                    continue
                joined = b"".join([s[2] for s in part])
                begin = np.cumsum([0] + [len(s[2]) for s in part])[owner]
                row, base = (np.array([s[i] for s in part], np.int64)[owner] for i in (0, 1))
                span = (base + first - begin) << 2 * _SPAN | (at - first) << _SPAN | n
                hk = _digest([joined[a:a + kmer] for a in at.tolist()])
                hs = _digest([joined[f:e] for f, e in zip(first.tolist(), (first + n + depth - 1).tolist())])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (row, span, hk, hs)],
                                                 ["_row", "span", "hk", "hs"])

    return docs.mapInArrow(run, "_row long, span long, hk long, hs long")


def _blocks(rest: DataFrame, docs: DataFrame, depth: int) -> DataFrame:
    """Core digit of each block of windows: _row, hk, block, core hash, and of its windows the offset
    of the first, its start and the hashes."""
    grouped = rest.groupBy("_row").agg(F.collect_list(F.struct("span", "hk")).alias("left"))
    joined = docs.join(grouped, "_row").select("_row", "text", F.col("left.span").alias("span"),
                                               F.col("left.hk").alias("hk"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in range(batch.num_rows):
                row, text, spans, hks = (batch.column(c)[one].as_py() for c in ("_row", "text", "span", "hk"))
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for span, hk in zip(spans, hks):
                    first, off, n = span >> 2 * _SPAN, span >> _SPAN & _COUNT, span & _COUNT
                    at = first + off
                    for block in range((off - n + 1) // BLOCK, off // BLOCK + 1):
                        top, low = min(off, block * BLOCK + BLOCK - 1), max(off - n + 1, block * BLOCK)
                        core = text[at - block * BLOCK:at - block * BLOCK - BLOCK + 1 + depth]
                        hashes = _digest([text[at - d:at - d + depth] for d in range(top, low - 1, -1)])
                        for column, value in zip(out, (hk, block, xxhash.xxh3_64_intdigest(core) - (1 << 63),
                                                       top, at - top, hashes.tolist())):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(out[0]), pa.int64()), pa.array(out[0], pa.int64()),
                     pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32()),
                     pa.array(out[4], pa.int64()), pa.array(out[5], pa.list_(pa.int64()))],
                    ["_row", "hk", "block", "core", "off", "start", "windows"])

    return joined.mapInArrow(
        run, "_row long, hk long, block int, core long, off int, start long, windows array<long>")


def _repeated(df: DataFrame, *by: str) -> DataFrame:
    """Keys of more than one row. Stored, so that a join with them has a shuffle on both sides
    and nothing between: Spark can then split a key of very many rows."""
    return materialize(df.groupBy(*by).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"), "suffixes")


def repeated_spans(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(_row, lo, hi) byte ranges whose union is what to remove. ``docs``: _row, text binary."""
    if not 0 < depth <= _COUNT + KMER - 1:
        raise ValueError(f"depth must be 1 to {_COUNT + KMER - 1}")
    prepared(docs.sparkSession)
    scanned = materialize(_scan(docs, depth), "suffixes")
    left = materialize(scanned.join(_repeated(scanned, "hk"), "hk", "left_semi"), "suffixes")
    release(scanned)
    whole = _repeated(left, "hk", "hs").withColumn("whole", F.lit(True))
    sorted_ = materialize(left.join(whole, ["hk", "hs"], "left")
                          .select("_row", "span", "hk", "hs", F.coalesce("whole", F.lit(False)).alias("whole")),
                          "suffixes")
    release(left)
    first = F.shiftright("span", 2 * _SPAN)
    spans = sorted_.where("whole").select(
        "_row", first.alias("lo"), (first + F.col("span").bitwiseAND(F.lit(_COUNT)) + (depth - 1)).alias("hi"))
    # what is left is compared among itself and with one of each group of whole stretches
    rest = sorted_.where("not whole").select("_row", "span", "hk")
    one = (sorted_.where("whole").groupBy("hk", "hs").agg(F.min(F.struct("_row", "span")).alias("one"))
           .select("one._row", "one.span", "hk").join(rest.select("hk").distinct(), "hk", "left_semi"))
    rest = rest.unionByName(one)
    blocks = materialize(_blocks(rest, docs, depth), "suffixes")
    open_ = blocks.join(_repeated(blocks, "hk", "block", "core"), ["hk", "block", "core"], "left_semi")
    windows = open_.select("_row", "hk", "off", "start", F.posexplode("windows").alias("i", "hw")).select(
        "_row", "hk", (F.col("off") - F.col("i")).alias("off"), (F.col("start") + F.col("i")).alias("lo"), "hw")
    windows = materialize(windows, "suffixes")
    release(blocks)
    ends = materialize(windows.join(_repeated(windows, "hk", "off", "hw"), ["hk", "off", "hw"], "left_semi").select(
        "_row", "lo", (F.col("lo") + depth).alias("hi")), "suffixes")
    release(windows)
    return spans.unionByName(ends)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def remove_repeats(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """_row, doc_id, n_bytes, n_removed, n_spans, kept (binary: the bytes that are left)."""
    rows = keyed(docs, "doc_id", "text").select(
        "_row", "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    spans = repeated_spans(rows.select("_row", "text"), depth)
    grouped = spans.groupBy("_row").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")).select(
        "_row", F.col("spans.lo").alias("lo"), F.col("spans.hi").alias("hi"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, runs, kept = [], [], []
            for text, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("text", "lo", "hi"))):
                gone = merged(list(zip(lo or (), hi or ())))
                edges = [0, *itertools.chain(*gone), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                removed.append(len(text) - len(kept[-1]))
                runs.append(len(gone))
            sizes = [len(k) + r for k, r in zip(kept, removed)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("doc_id"), pa.array(sizes, pa.int64()),
                 pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
                ["_row", "doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.join(grouped, "_row", "left").mapInArrow(
        cut, "_row long, doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def without_repeats(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text`` (characters of which only some
    bytes are left go too) and ``n_chars`` counted anew; no row is lost."""
    left = remove_repeats(docs, depth).select("_row", F.col("kept").cast("string").alias("kept"))
    # what is no character any more becomes U+FFFD, which goes
    clean = F.coalesce(F.try_validate_utf8("kept"), F.replace(F.make_valid_utf8("kept"), F.lit("\ufffd"), F.lit("")))
    # the texts themselves need not travel again
    bare = numbered(docs.withColumn("text", F.when(F.col("text").isNotNull(), F.lit(""))))
    out = bare.join(left, "_row").select("doc", clean.alias("kept"))
    new = {"text": F.when(F.col("doc.text").isNotNull(), F.col("kept")),
           "n_chars": F.length("kept").cast("long")}
    return out.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans",
                        F.sha2("kept", 256).alias("kept_sha256"))
