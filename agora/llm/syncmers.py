"""Document fingerprints from closed syncmers.

Of all ``K``-character strings of a text, those are anchors whose smallest inner
``S``-character string (by hash) is the first or the last one. Whether a string is an anchor
depends on nothing outside it, so an edit moves anchors but changes only those it touches, and every
``K - S + 1`` neighbouring strings hold one. The fingerprint is the anchors' 24-bit hashes in text
order, each as four characters. Two fingerprints are compared by position: equal anchors are
paired in order of occurrence, the longest chain that rises in both texts is kept, and the
likeness is the share of anchors in it (Dice). All texts take the same strings, short ones too.

Results: one row per input row. A null text is empty and has an empty fingerprint; another text
without anchors has one, the hash of all of it. Two empty fingerprints are
alike by 1, an empty and another by 0. The next document is that of the next smaller doc_id (null
last; repeated ids in stored order), after the last the first; a single one is its own next.
No rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.common import BATCH_CHARS, chunked, keyed, prepared, shuffle_parts

K = 16
S = 9
_SECRET = 42


def _joined_hashes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``S``- and every ``K``-character string, from those of their parts."""
    h = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    one = h
    join = lambda a, b, by: a[:len(b) - by] * np.uint64(0xD6E8FEB86659FD93 + 2 * by) + b[by:]
    for have in (1, 2, 4):
        h = join(h, h, have)
    small, big = join(h, one, 8), join(h, h, 8)
    small = (small ^ (small >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    big = (big ^ (big >> np.uint64(31))) * np.uint64(0xC4CEB9FE1A85EC53)
    return small, big >> np.uint64(40)


def _anchored(texts: list[str]) -> list[np.ndarray]:
    """Anchors (24-bit hashes in order) of texts that are handled at once."""
    sizes = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    if len(codes) < K:
        return [np.empty(0, np.uint32) for _ in texts]
    small, big = _joined_hashes(codes)
    width, least, have = K - S + 1, small, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    least = np.minimum(least[:len(big)], least[width - have:width - have + len(big)])
    at = np.flatnonzero((small[:len(big)] == least) | (small[width - 1:width - 1 + len(big)] == least))
    ends = np.cumsum(sizes)
    owner = np.searchsorted(ends, at, side="right")
    inside = at + K <= ends[owner]
    at, owner = at[inside], owner[inside]
    return np.split(big[at].astype(np.uint32), np.searchsorted(owner, np.arange(1, len(texts))))


def anchors(texts: list[str]) -> list[np.ndarray]:
    segments = [(i, t[lo:lo + BATCH_CHARS + K - 1]) for i, t in enumerate(texts)
                for lo in range(0, max(len(t) - K + 1, 1), BATCH_CHARS)]
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for lo, hi in chunked((len(s) for _, s in segments), BATCH_CHARS):
        for (i, _), a in zip(segments[lo:hi], _anchored([s for _, s in segments[lo:hi]])):
            found[i].append(a)
    one = lambda t: xxhash.xxh64_intdigest(t.encode(), _SECRET) >> 40
    out = []
    for text, parts in zip(texts, found):
        a = np.concatenate(parts)
        out.append(a if len(a) or not text else np.array([one(text)], np.uint32))
    return out


def written(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()).decode()


def _occurrences(a: np.ndarray) -> np.ndarray:
    order = np.argsort(a, kind="stable")
    first = np.append(True, np.diff(a[order]) != 0)
    at = np.arange(len(a))
    nth = np.empty(len(a), np.int64)
    nth[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return a.astype(np.int64) << 32 | nth


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of anchors in the longest chain of equal ones that rises in both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    _, i, j = np.intersect1d(_occurrences(a), _occurrences(b), assume_unique=True, return_indices=True)
    j = j[np.argsort(i)]
    if len(j) > 1 and (np.diff(j) < 0).any():
        tops: list[int] = []
        for x in j.tolist():
            k = bisect_left(tops, x)
            tops[k:k + 1] = [x]
        chain = len(tops)
    else:
        chain = len(j)
    return 2 * chain / (len(a) + len(b))


def _ordered(docs: DataFrame) -> DataFrame:
    """_row, doc_id, text, bucket, extra: sorted by falling doc_id within buckets of neighbours,
    each bucket followed by a copy (``extra``) of the document that comes next."""
    spark = docs.sparkSession
    rows = (keyed(docs, "doc_id", "text")
            .withColumn("text", F.coalesce("text", F.lit("")))
            .withColumn("at", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))))
    parts = shuffle_parts(spark) * 4
    # buckets are ranges of (falling doc_id, row): rows of one id are cut too
    rows = rows.withColumn("place", F.struct(F.bitwise_not("at").alias("at"), "_row"))
    heads = sorted(tuple(r["head"]) for r in rows.select("place").repartitionByRange(parts, "place")
                   .groupBy(F.spark_partition_id()).agg(F.min("place").alias("head")).collect())  # one a bucket
    side = max(1, int(len(heads) ** 0.5))
    heads_of = lambda some: F.array(*[F.struct(F.lit(a).cast("long").alias("at"), F.lit(r).cast("long").alias("_row"))
                                      for a, r in some]).cast("array<struct<at:long,_row:long>>")
    upto = lambda some: F.size(F.filter(some, lambda head: head <= F.col("place")))
    above = F.greatest(F.lit(0), upto(heads_of(heads[::side])) - 1) * side
    bucket = above + upto(F.slice(heads_of(heads), above + 1, side)) - 1
    rows = rows.withColumn("bucket", bucket)
    before = [(r, (i or len(heads)) - 1) for i, (_, r) in enumerate(heads)]  # the first follows the last
    ends = F.broadcast(spark.createDataFrame(before, "_row long, before int"))  # a row for each bucket
    own = F.struct(F.col("bucket"), F.lit(False).alias("extra"))
    copy = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("extra"))
    placed = rows.join(ends, "_row", "left").withColumn(
        "to", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, copy))))
    return (placed.select("_row", "doc_id", "text", "at", "to.bucket", "to.extra")
            .repartition(shuffle_parts(spark), "bucket")
            .sortWithinPartitions("bucket", "extra", F.desc("at"), "_row")
            .select("_row", "doc_id", "text", "bucket", "extra"))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    prepared(docs.sparkSession)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = pa.schema(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(),
                                   pa.float64(), pa.float64()]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the document before, whose next has yet to come
        for batch in batches:
            texts = batch.column("text").to_pylist()
            own = list(zip(batch.column("doc_id").to_pylist(), texts, anchors(texts),
                           batch.column("extra").to_pylist()))
            pairs = []
            for now in own:
                if held is not None and not held[3]:
                    pairs.append((held, now))
                held = now
            edited = [a[1][:len(a[1]) - len(a[1]) // 3] + b[1][:len(a[1]) // 3] for a, b in pairs]
            out: dict[str, list] = {n: [] for n in names}
            for (a, b), text, marks in zip(pairs, edited, anchors(edited)):
                for n, v in zip(names, (a[0], len(a[1]), hashlib.sha256(text.encode()).hexdigest(),
                                        written(a[2]), written(marks), likeness(a[2], marks),
                                        likeness(a[2], b[2]))):
                    out[n].append(v)
            yield pa.RecordBatch.from_pydict(out, schema)

    return _ordered(docs).mapInArrow(
        compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                 "edited_fingerprint string, near_edited double, near_next double")
