"""Findings of round 4: what a query leaves on disk."""

from __future__ import annotations

import glob
import os
import random
import time

import numpy as np
import pyarrow as pa
import pytest

from agora.operators import keyword_index
from agora.session import scratch_path


def _posts(spark, rows):
    return spark.createDataFrame(rows, "internal_post_id long, post_content_raw string")


def _comments(spark, rows):
    return spark.createDataFrame(rows, "internal_post_id long, comment_id long, comment_text string")


def _shuffle_blocks(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
    return {b for b in blocks.split() if b.startswith("shuffle_")}


def test_a_posting_takes_few_bytes(spark):
    """two ids of eight bytes were stored for each posting."""
    random.seed(4)
    texts = [" ".join("".join(random.choices("etaoinsrhl", k=random.randint(2, 8))) for _ in range(10)) for _ in range(20_000)]
    postings = sum(len({t[i:i + 3] for i in range(len(t) - 2)}) for t in texts)
    comments = _comments(spark, [(i // 3, i * 7 + 10 ** 9, t) for i, t in enumerate(texts)]).repartition(2)
    path = keyword_index.build(_posts(spark, []), comments, scratch_path(spark, "grams"))
    assert sum(os.path.getsize(f) for f in glob.glob(f"{path.removeprefix('file:')}/part=*/*.parquet")) < 3 * postings


def test_the_build_leaves_no_shuffle_files(spark):
    """they stayed on disk while the search made its own."""
    before = _shuffle_blocks(spark)
    comments = _comments(spark, [(i, i, f"text {i}") for i in range(50)]).repartition(3, "comment_id")
    keyword_index.build(_posts(spark, [(1, "a post")]), comments, scratch_path(spark, "grams"))
    until = time.time() + 20
    while (left := _shuffle_blocks(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left


def test_numbers_and_ids_survive_the_packing():
    values = np.array([0, 1, 127, 128, 129, 16383, 16384, 2 ** 32, 2 ** 63, 2 ** 64 - 1, 5], np.uint64)
    data, sizes = keyword_index._varints(values)
    assert sizes.tolist() == [1, 1, 1, 2, 2, 2, 3, 5, 10, 10, 1] and (keyword_index._numbers(data.tobytes()) == values).all()
    assert len(keyword_index._numbers(b"")) == 0
    for ids in ([], [None], [None, None], [5], [-3, None, 7, 7, None], [2 ** 63 - 1, -2 ** 63, 0, 2 ** 63 - 1]):
        got, known = keyword_index._ids(keyword_index._ids_bytes(pa.array(ids, pa.int64())))
        assert [int(i) if k else None for i, k in zip(got, known)] == ids


@pytest.mark.parametrize("batch", [1, 2, 3, 10_000])
def test_candidates_do_not_depend_on_the_segments(spark, monkeypatch, batch):
    """Texts in pieces, cut between segments; ids that repeat or are null."""
    monkeypatch.setattr(keyword_index, "PIECE", 7)
    rows = [(5, 1, "a few words and the needle is here"), (5, 2, "the need of a dleed eedle"), (6, 3, "needl"), (6, 4, "eedle"),
            (7, None, "needle"), (None, 8, "needle"), (8, 9, "NEEDLEneedle"), (8, 9, "NEEDLEneedle"), (9, 10, None), (9, 11, ""),
            (-4, 12, "xneedlex"), (11, 13, "dle nee edl eed"), (12, 14, "dle nee edl")]
    posts = [(20, "in the needle"), (20, "other"), (21, "need le"), (None, "needle"), (22, None), (23, "nee"), (23, "needle")]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        path = keyword_index.build(_posts(spark, posts).coalesce(1), _comments(spark, rows).coalesce(1), scratch_path(spark, "grams"))
        found = {r[0] for r in keyword_index.candidates(spark, path, "Needle").collect()}
        got = {(*r[:2], r["gram"]) for r in keyword_index.postings(_comments(spark, rows), "comment_text", "internal_post_id", "comment_id").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found - {None} == {5, 7, 8, -4, 20, 23, 11}  # 11 has the four trigrams, though not together
    assert got == {(p, c, t.lower()[i:i + 3]) for p, c, t in rows if t for i in range(len(t) - 2)}
