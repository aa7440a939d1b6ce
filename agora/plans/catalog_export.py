"""Registered export and sink queries (P3 P4 U1 U2 SNK1-SNK4)."""

from __future__ import annotations

from agora import schemas
from agora.operators import export
from agora.plans import sql_bindings as SB
from agora.plans.registry import register
from agora.session import scratch_path
from agora.sources import bindings as B
from agora.sources import sinks

FILTERS = {"category": "3-MEDIUM", "min_comments": 2, "keyword": "o"}

_SELECTED = """,
sel AS (
  SELECT p.* FROM b1_posts p
  WHERE p.is_processed_by_ai AND p.ai_category = '3-MEDIUM'
    AND (p.post_content_raw ILIKE '%o%'
         OR EXISTS (SELECT 1 FROM b1_comments c WHERE c.internal_post_id = p.internal_post_id
                    AND c.comment_text ILIKE '%o%'))
    AND (SELECT count(*) FROM b1_comments c
         WHERE c.internal_post_id = p.internal_post_id) >= 2)
"""

_COMBINED_SQL = SB.with_(SB.B1) + _SELECTED + """
SELECT 'group' AS record_type, group_id AS id, CAST(NULL AS VARCHAR) AS author,
       CAST(NULL AS VARCHAR) AS content, CAST(NULL AS TIMESTAMP) AS "timestamp",
       CAST(NULL AS VARCHAR) AS category, group_url AS url, CAST(NULL AS BIGINT) AS post_id,
       group_name AS name
FROM b1_groups
UNION ALL
SELECT 'post', internal_post_id, post_author_name, post_content_raw, posted_at, ai_category,
       post_url, NULL, NULL FROM sel
UNION ALL
SELECT 'comment', comment_id, commenter_name, comment_text, commented_at, NULL, NULL,
       internal_post_id, NULL
FROM b1_comments WHERE internal_post_id IN (SELECT internal_post_id FROM sel)"""

POST_EXPORT_COLS = list(schemas.ESSENTIAL_FIELDS["posts"]) + [
    "ai_is_potential_idea", "comment_count", "external_post_id", "group_id", "internal_post_id"]
COMMENT_EXPORT_COLS = list(schemas.ESSENTIAL_FIELDS["comments"]) + [
    "comment_scraped_at", "external_comment_id", "internal_post_id"]


def _data(spark, sf_dir, entity, materialize=None):
    return export.fetch_for_export(B.posts_b1(spark, sf_dir), B.comments_b1(spark, sf_dir),
                                   B.groups_b1(spark, sf_dir), FILTERS, entity, materialize)


@register("export_posts", SB.with_(SB.B1) + _SELECTED + """
SELECT post_url, post_author_name, post_content_raw, posted_at, ai_category,
       ai_is_potential_idea,
       (SELECT count(*) FROM b1_comments c WHERE c.internal_post_id = sel.internal_post_id)
         AS comment_count,
       external_post_id, group_id, internal_post_id
FROM sel""")
def q_export_posts(spark, sf_dir):
    df = export.normalize(_data(spark, sf_dir, "posts")["posts"], "posts")
    return df.select(*POST_EXPORT_COLS)


@register("export_comments", SB.with_(SB.B1) + _SELECTED + """
SELECT comment_id, commenter_name, comment_text, comment_scraped_at, external_comment_id,
       internal_post_id
FROM b1_comments WHERE internal_post_id IN (SELECT internal_post_id FROM sel)""")
def q_export_comments(spark, sf_dir):
    df = export.normalize(_data(spark, sf_dir, "comments")["comments"], "comments")
    return df.select(*COMMENT_EXPORT_COLS)


@register("export_groups", SB.with_(SB.B1_GROUPS) + """
SELECT group_id, group_name, group_url FROM b1_groups""")
def q_export_groups(spark, sf_dir):
    df = export.normalize(_data(spark, sf_dir, "groups")["groups"], "groups")
    return df.select("group_id", "group_name", "group_url")


@register("export_combined", _COMBINED_SQL)
def q_export_combined(spark, sf_dir):
    return _data(spark, sf_dir, "all")["combined"]


def _roundtrip(spark, sf_dir, fmt):
    data = _data(spark, sf_dir, "all", materialize=True)
    base = scratch_path(spark, f"export-{fmt}") + "/"
    written = sinks.export(data, base, fmt, spark)
    schema = data["combined"].schema
    return sinks.read_back(spark, written["combined"], fmt, schema)


@register("sink_csv_roundtrip", _COMBINED_SQL)
def q_sink_csv_roundtrip(spark, sf_dir):
    return _roundtrip(spark, sf_dir, "csv")


@register("sink_json_roundtrip", _COMBINED_SQL)
def q_sink_json_roundtrip(spark, sf_dir):
    return _roundtrip(spark, sf_dir, "json")
