"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over characters cuts texts into chunks, so equal passages of different texts
give equal chunks wherever they stand. Chunks are counted by a 128-bit digest. The texts of chunks that
occur again are sent on once a task (a Bloom filter of their digests tells most of them) and encoded once each;
their ids are joined to all places of the chunk (a chunk of very many texts splits as a skewed
join side), and whole texts travel once, to the ids of their shared chunks. All other chunks
are encoded where they are. A cut may run through a token, so the ids on both
sides of every joint are encoded anew between two places where a text can always be cut (see
``tokens.safe_cut``), and what they replace must agree with the chunks' own ids; where it
doesn't, the chunk is encoded again. The ids are therefore those of the whole text.

Results: one row per input row with ids (little-endian unsigned 32-bit) and ``decoded``, the
text that the ids stand for. A null text is empty and has no ids. Repeated rows share their
chunks. No rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm import bloom, tokens
from agora.llm.common import keyed, materialize, prepared, release

#: Characters that a cut is decided by; a cut falls after one place in so many, about.
WINDOW = 16
MEAN = 1024
LEAST, MOST = 64, 1 << 14
#: Digests that a task remembers to have sent.
SENT = 1 << 18


def cuts(text: str) -> list[int]:
    """Edges of the chunks of a text, from 0 to its length."""
    n = len(text)
    if n <= LEAST:
        return [0, n] if n else [0]
    h = np.frombuffer(text.encode("utf-32-le"), np.uint32) * np.uint32(0x9E3779B1)
    have = 1
    while have < WINDOW:
        h = h[:-have] * np.uint32(0x85EBCA6B + 2 * have) + h[have:]
        have *= 2
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    out = [0]
    for at in (np.flatnonzero(h < np.uint32((1 << 32) // MEAN)) + WINDOW).tolist() + [n]:
        while at - out[-1] > MOST:
            out.append(out[-1] + MOST)
        if at - out[-1] >= LEAST or at == n:
            out.append(at)
    return out


def digest(chunk: str) -> tuple[int, int]:
    d = hashlib.blake2b(chunk.encode(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _next_safe(text: str, at: int) -> int:
    """The first place from ``at`` where the text can be cut, or its end."""
    n = len(text)
    while 0 <= (at := text.find(" ", at)) < n:
        if at and text[at - 1].isascii() and text[at - 1].isalnum():
            return at
        at += 1
    return n


def stitched(text: str, edges: list[int], known: dict[int, list[int]], encode) -> list[int]:
    """The ids of the whole text; ``known``: ids of some chunks by their place."""
    if len(edges) < 2:
        return []
    if len(edges) == 2:
        return known[0] if 0 in known else encode(text)
    repairs: list[tuple[int, int]] = []  # (lo, hi) around the joints
    for p in edges[1:-1]:
        lo, hi = tokens.safe_cut(text, p, 0), _next_safe(text, p)
        if repairs and lo < repairs[-1][1]:
            repairs[-1] = (repairs[-1][0], max(hi, repairs[-1][1]))
        else:
            repairs.append((lo, hi))
    out: list[int] = []
    done, r = 0, 0  # the text before ``done`` is encoded
    for k, (begin, end) in enumerate(zip(edges, edges[1:])):
        lo = max(begin, done)
        while r < len(repairs) and repairs[r][1] <= lo and repairs[r][0] < lo:
            r += 1
        hi = min(end, repairs[r][0]) if r < len(repairs) else end
        if lo < hi:  # a part of this chunk stands as it is
            ids = known[k] if k in known else encode(text[begin:end])
            head, tail = encode(text[begin:lo]), encode(text[hi:end])
            if ids[:len(head)] == head and ids[len(ids) - len(tail):] == tail:
                out += ids[len(head):len(ids) - len(tail)]
            else:
                out += encode(text[lo:hi])
            done = hi
        if r < len(repairs) and done == repairs[r][0] and repairs[r][0] < end:
            out += encode(text[repairs[r][0]:repairs[r][1]])
            done = repairs[r][1]
            r += 1
        elif r < len(repairs) and done == repairs[r][0] == end:  # the joint needs no repair before it
            out += encode(text[repairs[r][0]:repairs[r][1]])
            done = repairs[r][1]
            r += 1
    return out


def _chunks(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for row, text in zip(batch.column("_row").to_pylist(), batch.column("text").to_pylist()):
                edges = cuts(text)
                for i, (a, b) in enumerate(zip(edges, edges[1:])):
                    for column, value in zip(out, (row, i, *digest(text[a:b]))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()),
                                              pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())],
                                             ["_row", "nth", "d1", "d2"])

    return docs.select("_row", "text").mapInArrow(run, "_row long, nth int, d1 long, d2 long")


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """_row, doc_id, ids binary, decoded string."""
    spark = docs.sparkSession
    prepared(spark)
    shared = tokens.share(spark, path)
    rows = keyed(docs, "doc_id", "text").select("_row", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chunks = materialize(_chunks(rows), "chunks")
    again = materialize(chunks.groupBy("d1", "d2").agg(F.count("*").alias("n")).where("n > 1").select("d1", "d2"), "chunks")
    # the same joins at every size: what is small on a small table is not on a large one
    shared_chunks = materialize(chunks.join(again.hint("merge"), ["d1", "d2"], "left_semi"), "chunks")
    release(chunks)
    known = bloom.build(again.select("d1"))

    def export(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            out: tuple[list, ...] = ([], [], [])
            for text in batch.column("text").to_pylist():
                edges = cuts(text)
                own = [digest(text[a:b]) for a, b in zip(edges, edges[1:])]
                for i in np.flatnonzero(bloom.passes(known.value, np.array([d for d, _ in own], np.int64))).tolist():
                    if own[i] not in sent:
                        if len(sent) >= SENT:
                            sent.clear()  # some go again, which the next step does not mind
                        sent.add(own[i])
                        for column, value in zip(out, (*own[i], text[edges[i]:edges[i + 1]])):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                                              pa.array(out[2], pa.string())], ["d1", "d2", "text"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = tokens.codec(shared)
        for batch in batches:
            ids = [np.array(codec.encode(t), codec.dtype).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("d1"), batch.column("d2"), pa.array(ids, pa.binary())],
                                             ["d1", "d2", "ids"])

    texts = (rows.select("text").mapInArrow(export, "d1 long, d2 long, text string")
             .groupBy("d1", "d2").agg(F.first("text").alias("text")).join(again.hint("merge"), ["d1", "d2"], "left_semi"))
    exported = materialize(texts.mapInArrow(encode, "d1 long, d2 long, ids binary"), "chunks")
    release(again)
    taken = (shared_chunks.join(exported.hint("merge"), ["d1", "d2"]).groupBy("_row")
             .agg(F.collect_list(F.struct("nth", "ids")).alias("known")))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = tokens.codec(shared)
        for batch in batches:
            lists, decoded = [], []
            for text, known in zip(batch.column("text").to_pylist(), batch.column("known").to_pylist()):
                have = {w["nth"]: np.frombuffer(w["ids"], codec.dtype).tolist() for w in known or ()}
                ids = stitched(text, cuts(text), have, codec.encode)
                lists.append(np.array(ids, "<u4").tobytes())
                decoded.append(codec.decode(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("doc_id"), pa.array(lists, pa.binary()),
                 pa.array(decoded, pa.string())], ["_row", "doc_id", "ids", "decoded"])

    return rows.join(taken.hint("merge"), "_row", "left").mapInArrow(
        finish, "_row long, doc_id long, ids binary, decoded string")


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
