"""Export shaping: per-entity column order (P4), combined records (P3, U1) and the
entity selector (U2).

The filtered posts plan is defined once; comments are all comments of the
matching posts via one semi-join (no per-post query). ``combined`` is a
``unionByName`` of the three projections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agora import schemas
from agora.operators import search
from agora.operators.ingest import cut_lineage


def normalize(df: DataFrame, entity: str) -> DataFrame:
    """Essential columns first in declared order, then all others sorted by name."""
    essential = [c for c in schemas.ESSENTIAL_FIELDS.get(entity, ()) if c in df.columns]
    rest = sorted(c for c in df.columns if c not in essential)
    missing = [c for c in schemas.ESSENTIAL_FIELDS.get(entity, ()) if c not in df.columns]
    cols = [F.col(c) for c in essential] + [F.lit(None).cast("string").alias(c) for c in missing]
    return df.select(*cols, *[F.col(c) for c in rest])


def _combined_frame(df: DataFrame) -> DataFrame:
    return df.select(*[
        (F.col(c) if c in df.columns else F.lit(None)).alias(c) for c in schemas.COMBINED_FIELDS
    ])


def combined_posts(posts: DataFrame) -> DataFrame:
    return _combined_frame(posts.select(
        F.lit("post").alias("record_type"),
        F.col("internal_post_id").alias("id"),
        F.col("post_author_name").alias("author"),
        F.col("post_content_raw").alias("content"),
        F.col("posted_at").alias("timestamp"),
        F.col("ai_category").alias("category"),
        F.col("post_url").alias("url"),
        F.lit(None).cast("bigint").alias("post_id"),
        F.lit(None).cast("string").alias("name")))


def combined_comments(comments: DataFrame) -> DataFrame:
    # The comment's own time and its post id (the source read absent keys here).
    return _combined_frame(comments.select(
        F.lit("comment").alias("record_type"),
        F.col("comment_id").alias("id"),
        F.col("commenter_name").alias("author"),
        F.col("comment_text").alias("content"),
        F.col("commented_at").alias("timestamp"),
        F.lit(None).cast("string").alias("category"),
        F.lit(None).cast("string").alias("url"),
        F.col("internal_post_id").alias("post_id"),
        F.lit(None).cast("string").alias("name")))


def combined_groups(groups: DataFrame) -> DataFrame:
    return _combined_frame(groups.select(
        F.lit("group").alias("record_type"),
        F.col("group_id").alias("id"),
        F.lit(None).cast("string").alias("author"),
        F.lit(None).cast("string").alias("content"),
        F.lit(None).cast(T.TimestampNTZType()).alias("timestamp"),
        F.lit(None).cast("string").alias("category"),
        F.col("group_url").alias("url"),
        F.lit(None).cast("bigint").alias("post_id"),
        F.col("group_name").alias("name")))


def combined(groups: DataFrame | None, posts: DataFrame | None,
             comments: DataFrame | None) -> DataFrame | None:
    """Groups, then posts, then comments, as one record set (UNION ALL)."""
    parts = []
    if groups is not None:
        parts.append(combined_groups(groups))
    if posts is not None:
        parts.append(combined_posts(posts))
    if comments is not None:
        parts.append(combined_comments(comments))
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def fetch_for_export(posts: DataFrame, comments: DataFrame, groups: DataFrame,
                     filters: dict | None = None, entity: str = "posts",
                     materialize: bool | None = None) -> dict:
    """The DataFrames to export for ``entity`` in posts / comments / groups / all.

    Returns ``{"posts", "comments", "groups", "combined"}`` -> DataFrame or None.
    With ``materialize`` the selected posts and their comments are written once
    to the shared checkpoint folder, so several writes (one per entity, plus
    the empty checks) reuse them instead of re-running the search. By default
    this happens whenever comments are exported: the selected posts then feed
    two consumers (the posts output and the comments semi-join), which Spark
    would otherwise compute twice (their column sets differ, so no exchange is
    reused).
    """
    if materialize is None:
        materialize = entity in ("comments", "all")
    if entity not in ("posts", "comments", "groups", "all"):
        raise ValueError(f"unknown entity {entity!r}")
    filters = {k: v for k, v in (filters or {}).items() if v is not None and v != ""}
    out = {"posts": None, "comments": None, "groups": None, "combined": None}
    selected = None
    if entity in ("posts", "comments", "all"):
        selected = search.search_posts(posts, comments, order=False, **filters)
        if materialize:
            selected = cut_lineage(selected)
    if entity in ("groups", "all"):
        out["groups"] = groups
    if entity in ("posts", "all"):
        out["posts"] = selected
    if entity in ("comments", "all"):
        out["comments"] = search.comments_of(selected, comments)
        if materialize:
            out["comments"] = cut_lineage(out["comments"])
    out["combined"] = combined(out["groups"], out["posts"], out["comments"])
    return out
