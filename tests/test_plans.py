"""Physical-plan properties that matter at scale, read from ``explain`` output."""

import pytest

from __spark_entry__ import queries
from agora.operators import ingest, search
from agora.sources import bindings as B
from tests.conftest import SMALL

# queries whose functions run jobs while building the plan (checkpoints, writes,
# streams): their final plans read materialized data, so they are skipped here
EAGER = {"ingest_posts_two_key", "groups_add", "groups_upsert", "sink_csv_roundtrip",
         "sink_json_roundtrip", "stream_ingest", "stream_pages_ingest", "batch_fixed",
         "batch_tokens", "batch_stats", "prompts", "annotate_posts", "annotate_posts_apply",
         "annotate_comments", "ingest_pages", "ingest_shared_ordinals", "batch_blocks", "batch_block_tree",
         "stream_pages_indexed", "stream_either_key", "annotate_two_passes", "annotate_ledger", "annotate_rejects",
         "export_layout", "store_bootstrap", "stats_incremental", "stats_incremental_categories", "search_keyword_indexed"}
# the training-data operators write their steps as tables
OPERATORS = {n for n in queries() if n[:2] == "op" and n[2:3].isdigit()} | {"pipeline"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    jvm = df.sparkSession.sparkContext._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", sorted(set(queries()) - EAGER - OPERATORS))
def test_no_cartesian_or_nested_loop(spark, name):
    p = plan(queries()[name](spark, SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_search_pushes_filters_and_prunes(spark):
    from agora.session import scratch_path
    path = scratch_path(spark, "t-posts-table")
    B.posts_b1(spark, SMALL).write.parquet(path)                 # a stored posts table
    posts = spark.read.parquet(path)
    df = search.search_posts(posts, B.comments_b1(spark, SMALL), category="1-URGENT",
                             start_date="1996-01-01", keyword="ring").select(
        "internal_post_id", "comment_count")
    f = formatted(df)
    scan = [blk for blk in f.split("\n\n") if path.split("/")[-1] in blk and "Scan" in blk][0]
    assert "EqualTo(ai_category,1-URGENT)" in scan
    assert "GreaterThanOrEqual(posted_at" in scan
    assert "EqualTo(is_processed_by_ai,true)" in scan or "is_processed_by_ai" in scan
    assert "ai_reasoning" not in scan and "post_image_url" not in scan      # pruned
    part_scan = [blk for blk in f.split("\n\n") if "part.parquet" in blk][0]
    assert "p_retailprice" not in part_scan and "p_brand" not in part_scan


def test_comment_activity_aggregates_partially(spark):
    p = plan(search.comment_activity(B.comments_b1(spark, SMALL), keyword="x"))
    assert "partial_count" in p and "partial_max" in p             # bool_or runs as max


def test_first_per_key_aggregates_partially(spark):
    df = spark.range(100).selectExpr("id % 3 AS k", "id AS ordinal")
    p = plan(ingest.first_per_key(df, df.k, "ordinal"))
    assert "partial_min_by" in p


def test_cap_uses_map_side_group_limit(spark):
    df = spark.range(1000).selectExpr("id % 2 AS g", "id AS ordinal")
    p = plan(ingest.cap_per_group(df, ["g"], "ordinal", 5))
    assert "WindowGroupLimit" in p


def test_prefilter_is_a_semi_join_or_absent(spark):
    posts, comments = B.posts_b1(spark, SMALL), B.comments_b1(spark, SMALL)
    small = plan(search.search_posts(posts, comments, category="1-URGENT", keyword="ring"))
    assert "LeftSemi" in small
    plain = plan(search.search_posts(posts, comments, category="1-URGENT", keyword="ring",
                                     prefilter=False))
    assert "LeftSemi" not in plain and "partial_count" in plain
