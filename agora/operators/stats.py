"""Summary statistics over the store.

The source runs six separate scans; here the counters that share a table share
one aggregate: posts give total + unannotated in one pass, comments give total +
average-per-commented-post in one two-level aggregate (partial aggregation runs
map-side, so a post holding a third of all comments costs one row per task).
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from agora import schemas

log = logging.getLogger(__name__)


def post_counts(posts: DataFrame) -> DataFrame:
    """A1 + A3 in one pass."""
    return posts.agg(
        F.count(F.lit(1)).alias("total_posts"),
        F.count_if(~F.col("is_processed_by_ai")).alias("unprocessed_posts"),
    )


def comment_counts(comments: DataFrame) -> DataFrame:
    """A4 + A5: total comments and the average comment count of commented posts.

    ``avg`` is left unrounded (rounding is display only); an empty table gives 0.
    A NULL post id forms its own group, as in the source.
    """
    per_post = comments.groupBy("internal_post_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("comment_id").alias("n_ids"))
    return per_post.agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).cast("bigint").alias("total_comments"),
        F.coalesce(F.avg("n_ids"), F.lit(0.0)).alias("avg_comments_per_post"),
    )


def overview(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """A1 A3 A4 A5 as one row: posts and per-post comment counts are unioned and
    reduced by ONE global aggregate (no join)."""
    p = posts.select(F.lit(True).alias("_post"), (~F.col("is_processed_by_ai")).alias("_unp"),
                     F.lit(None).cast("bigint").alias("_rows"),
                     F.lit(None).cast("bigint").alias("_ids"))
    c = comments.groupBy("internal_post_id").agg(
        F.count(F.lit(1)).alias("_rows"), F.count("comment_id").alias("_ids")).select(
        F.lit(False).alias("_post"), F.lit(None).cast("boolean").alias("_unp"), "_rows", "_ids")
    return p.unionByName(c).agg(
        F.count_if(F.col("_post")).alias("total_posts"),
        F.count_if(F.col("_post") & F.col("_unp")).alias("unprocessed_posts"),
        F.coalesce(F.sum("_rows"), F.lit(0)).cast("bigint").alias("total_comments"),
        F.coalesce(F.avg("_ids"), F.lit(0.0)).alias("avg_comments_per_post"))


def posts_per_category(posts: DataFrame) -> DataFrame:
    """A2: posts per category (NULL is a category), most frequent first."""
    return (posts.groupBy("ai_category").agg(F.count(F.lit(1)).alias("post_count"))
            .orderBy(F.col("post_count").desc(), F.col("ai_category").asc_nulls_first()))


def top_authors(posts: DataFrame, k: int = 5) -> DataFrame:
    """The k authors with most posts (NULL author is a group); ties by name."""
    return (posts.groupBy("post_author_name").agg(F.count(F.lit(1)).alias("post_count"))
            .orderBy(F.col("post_count").desc(), F.col("post_author_name").asc_nulls_first())
            .limit(int(k)))


def distinct_values(posts: DataFrame, field: str) -> DataFrame:
    """Distinct non-NULL values of an allow-listed field, as strings.

    The flag is rendered as 0/1, the way the source prints it. Unknown field ->
    empty result.
    """
    if field not in schemas.ALLOWED_FILTER_FIELDS:
        log.warning("field %s is not allowed for distinct values", field)
        return posts.sparkSession.createDataFrame([], "value string")
    c = F.col(field)
    if field == "ai_is_potential_idea":
        c = c.cast("int")
    return posts.filter(F.col(field).isNotNull()).select(c.cast("string").alias("value")).distinct()


def all_statistics(posts: DataFrame, comments: DataFrame, k: int = 5) -> dict[str, DataFrame]:
    """Every statistic, as DataFrames (categories are free text, so their number
    is not bounded): ``overview`` of one row, ``posts_per_category``, ``top_authors``."""
    return {"overview": overview(posts, comments), "posts_per_category": posts_per_category(posts),
            "top_authors": top_authors(posts, k)}


def run_counters(df: DataFrame, name: str, **exprs) -> tuple[DataFrame, Observation]:
    """A10: run counters observed while the real job runs, no extra count job."""
    obs = Observation(name)
    metrics = [e.alias(k) for k, e in exprs.items()] or [F.count(F.lit(1)).alias("rows")]
    return df.observe(obs, *metrics), obs


def batch_statistics(batches: DataFrame) -> DataFrame:
    """Number of batches and tokens per batch from (batch_id, tokens) rows."""
    per = batches.groupBy("batch_id").agg(F.sum("tokens").alias("batch_tokens"),
                                          F.count(F.lit(1)).alias("batch_posts"))
    return per.agg(F.count(F.lit(1)).alias("n_batches"),
                   F.coalesce(F.sum("batch_tokens"), F.lit(0)).cast("bigint").alias("total_tokens"),
                   F.max("batch_tokens").alias("max_batch_tokens"),
                   F.avg("batch_tokens").alias("avg_batch_tokens"))
