"""Registered queries: one per operator group of the inventory.

Each entry is ``fn(spark, sf_dir) -> DataFrame`` over the driver tables, plus
(where SQL can express it) the equivalent DuckDB SQL used as the oracle. Column
names are aliased identically on both sides. Results carry only scalar columns
so that value comparison is exact.
"""

from __future__ import annotations

from agora.operators import search, stats
from agora.plans import sql_bindings as SB
from agora.plans.registry import register
from agora.sources import bindings as B

SEARCH_COLS = ["internal_post_id", "group_id", "post_author_name", "posted_at", "ai_category",
               "ai_is_potential_idea", "comment_count"]
_SEARCH_SQL_COLS = ", ".join(f"p.{c}" for c in SEARCH_COLS[:-1])
_COUNT_SQL = ("(SELECT count(*) FROM b1_comments c "
              "WHERE c.internal_post_id = p.internal_post_id) AS comment_count")


def _b1(spark, sf_dir):
    return B.posts_b1(spark, sf_dir), B.comments_b1(spark, sf_dir)


# ------------------------------------------------------------------ search
@register("search_category_date", SB.with_(SB.B1) + f"""
SELECT {_SEARCH_SQL_COLS}, {_COUNT_SQL}
FROM b1_posts p
WHERE p.is_processed_by_ai AND p.ai_category = '1-URGENT'
  AND p.posted_at >= TIMESTAMP '1996-01-01' AND p.posted_at < TIMESTAMP '1998-01-01'
  AND p.post_author_name ILIKE '%customer#00000%'
ORDER BY p.posted_at DESC NULLS LAST, p.internal_post_id
LIMIT 100""")
def q_search_category_date(spark, sf_dir):
    posts, comments = _b1(spark, sf_dir)
    return search.search_posts(posts, comments, category="1-URGENT", start_date="1996-01-01",
                               end_date="1997-12-31", post_author="customer#00000",
                               limit=100).select(*SEARCH_COLS)


@register("search_idea_field", SB.with_(SB.B1) + f"""
SELECT {_SEARCH_SQL_COLS}, {_COUNT_SQL}
FROM b1_posts p
WHERE p.is_processed_by_ai AND p.group_id = 3 AND p.ai_is_potential_idea = TRUE
  AND p.ai_category = '2-HIGH'""")
def q_search_idea_field(spark, sf_dir):
    posts, comments = _b1(spark, sf_dir)
    return search.search_posts(posts, comments, group_id=3, filter_field="ai_is_potential_idea",
                               filter_value="1", category="2-HIGH",
                               order=False).select(*SEARCH_COLS)


@register("search_keyword", SB.with_(SB.B1) + f"""
SELECT {_SEARCH_SQL_COLS}, {_COUNT_SQL}
FROM b1_posts p
WHERE p.is_processed_by_ai
  AND (p.post_content_raw ILIKE '%ring%'
       OR EXISTS (SELECT 1 FROM b1_comments c WHERE c.internal_post_id = p.internal_post_id
                  AND c.comment_text ILIKE '%ring%'))""")
def q_search_keyword(spark, sf_dir):
    posts, comments = _b1(spark, sf_dir)
    return search.search_posts(posts, comments, keyword="ring", order=False).select(*SEARCH_COLS)


@register("search_keyword_post_text", SB.with_(SB.B1) + f"""
SELECT {_SEARCH_SQL_COLS}, {_COUNT_SQL}
FROM b1_posts p
WHERE p.is_processed_by_ai
  AND (p.post_content_raw ILIKE '%machinery%'
       OR EXISTS (SELECT 1 FROM b1_comments c WHERE c.internal_post_id = p.internal_post_id
                  AND c.comment_text ILIKE '%machinery%'))""")
def q_search_keyword_post_text(spark, sf_dir):
    posts, comments = _b1(spark, sf_dir)
    return search.search_posts(posts, comments, keyword="MACHINERY",
                               order=False).select(*SEARCH_COLS)


@register("search_comment_author", SB.with_(SB.B1) + f"""
SELECT {_SEARCH_SQL_COLS}, {_COUNT_SQL}
FROM b1_posts p
WHERE p.is_processed_by_ai
  AND EXISTS (SELECT 1 FROM b1_comments c WHERE c.internal_post_id = p.internal_post_id
              AND c.commenter_name ILIKE '%supplier#00000001%')""")
def q_search_comment_author(spark, sf_dir):
    posts, comments = _b1(spark, sf_dir)
    return search.search_posts(posts, comments, comment_author="Supplier#00000001",
                               order=False).select(*SEARCH_COLS)


# The source's literal form: LEFT JOIN + WHERE on the joined row + GROUP BY post.
@register("search_both", SB.with_(SB.B1) + f"""
SELECT {_SEARCH_SQL_COLS}, {_COUNT_SQL}
FROM b1_posts p LEFT JOIN b1_comments cm ON p.internal_post_id = cm.internal_post_id
WHERE p.is_processed_by_ai
  AND cm.commenter_name ILIKE '%supplier#00000003%'
  AND (p.post_content_raw ILIKE '%ring%' OR cm.comment_text ILIKE '%ring%')
GROUP BY {_SEARCH_SQL_COLS}""")
def q_search_both(spark, sf_dir):
    posts, comments = _b1(spark, sf_dir)
    return search.search_posts(posts, comments, comment_author="Supplier#00000003",
                               keyword="ring", order=False).select(*SEARCH_COLS)


@register("search_comment_count", SB.with_(SB.B1) + f"""
SELECT * FROM (
  SELECT {_SEARCH_SQL_COLS}, {_COUNT_SQL}
  FROM b1_posts p WHERE p.is_processed_by_ai AND p.group_id = 7) t
WHERE comment_count >= 3 AND comment_count <= 5""")
def q_search_comment_count(spark, sf_dir):
    posts, comments = _b1(spark, sf_dir)
    return search.search_posts(posts, comments, group_id=7, min_comments=3, max_comments=5,
                               order=False).select(*SEARCH_COLS)


@register("search_no_comments", SB.with_(SB.B1) + f"""
SELECT * FROM (
  SELECT {_SEARCH_SQL_COLS}, {_COUNT_SQL}
  FROM b1_posts p WHERE p.is_processed_by_ai) t
WHERE comment_count <= 0""")
def q_search_no_comments(spark, sf_dir):
    posts, comments = _b1(spark, sf_dir)
    return search.search_posts(posts, comments, max_comments=0, order=False).select(*SEARCH_COLS)


@register("search_threads_keyword", SB.with_(SB.B3) + """
SELECT p.internal_post_id, p.post_author_name,
       (SELECT count(*) FROM b3_comments c WHERE c.internal_post_id = p.internal_post_id)
         AS comment_count
FROM b3_posts p
WHERE EXISTS (SELECT 1 FROM b3_comments c WHERE c.internal_post_id = p.internal_post_id
              AND c.commenter_name ILIKE '%assist%'
              AND (p.post_content_raw ILIKE '%the%' OR c.comment_text ILIKE '%the%'))""")
def q_search_threads_keyword(spark, sf_dir):
    posts, comments = B.posts_b3(spark, sf_dir), B.comments_b3(spark, sf_dir)
    return search.search_posts(posts, comments, comment_author="assist", keyword="the",
                               order=False).select("internal_post_id", "post_author_name",
                                                   "comment_count")


@register("post_threads", SB.with_(SB.B3) + """
SELECT p.internal_post_id, p.post_author_name, p.post_content_raw,
       c.comment_id, c.commenter_name, c.comment_text, c.comment_scraped_at
FROM b3_posts p LEFT JOIN b3_comments c ON p.internal_post_id = c.internal_post_id""")
def q_post_threads(spark, sf_dir):
    posts, comments = B.posts_b3(spark, sf_dir), B.comments_b3(spark, sf_dir)
    return search.post_threads(posts, comments).select(
        "internal_post_id", "post_author_name", "post_content_raw", "comment_id",
        "commenter_name", "comment_text", "comment_scraped_at")


@register("group_lookup", SB.with_(SB.B1_GROUPS) + """
SELECT group_id, group_name, group_url FROM b1_groups WHERE group_name = 'NATION_4'""")
def q_group_lookup(spark, sf_dir):
    return search.group_by(B.groups_b1(spark, sf_dir), name="NATION_4").select(
        "group_id", "group_name", "group_url")


# ------------------------------------------------------------------ statistics
@register("stats_overview", SB.with_(SB.B1) + """
SELECT (SELECT count(*) FROM b1_posts) AS total_posts,
       (SELECT count(*) FILTER (WHERE NOT is_processed_by_ai) FROM b1_posts) AS unprocessed_posts,
       (SELECT count(*) FROM b1_comments) AS total_comments,
       (SELECT coalesce(avg(n), 0.0) FROM (SELECT count(comment_id) AS n FROM b1_comments
                                           GROUP BY internal_post_id)) AS avg_comments_per_post""")
def q_stats_overview(spark, sf_dir):
    posts, comments = _b1(spark, sf_dir)
    return stats.overview(posts, comments)


@register("posts_per_category", SB.with_(SB.B1) + """
SELECT ai_category, count(*) AS post_count FROM b1_posts GROUP BY ai_category""")
def q_posts_per_category(spark, sf_dir):
    return stats.posts_per_category(B.posts_b1(spark, sf_dir))


@register("top_authors", SB.with_(SB.B1) + """
SELECT post_author_name, count(*) AS post_count FROM b1_posts
GROUP BY post_author_name ORDER BY post_count DESC, post_author_name ASC NULLS FIRST LIMIT 5""")
def q_top_authors(spark, sf_dir):
    return stats.top_authors(B.posts_b1(spark, sf_dir), 5)


@register("top_authors_corpus", SB.with_(SB.B2_POSTS) + """
SELECT post_author_name, count(*) AS post_count FROM b2_posts
GROUP BY post_author_name ORDER BY post_count DESC, post_author_name ASC NULLS FIRST LIMIT 5""")
def q_top_authors_corpus(spark, sf_dir):
    return stats.top_authors(B.posts_b2(spark, sf_dir), 5)


@register("avg_comments_threads", SB.with_(SB.B3) + """
SELECT (SELECT count(*) FROM b3_comments) AS total_comments,
       (SELECT coalesce(avg(n), 0.0) FROM (SELECT count(comment_id) AS n FROM b3_comments
                                           GROUP BY internal_post_id)) AS avg_comments_per_post""")
def q_avg_comments_threads(spark, sf_dir):
    return stats.comment_counts(B.comments_b3(spark, sf_dir))


@register("distinct_values", SB.with_(SB.B1) + """
SELECT DISTINCT CAST(ai_category AS VARCHAR) AS value FROM b1_posts WHERE ai_category IS NOT NULL""")
def q_distinct_values(spark, sf_dir):
    return stats.distinct_values(B.posts_b1(spark, sf_dir), "ai_category")


@register("distinct_values_flag", SB.with_(SB.B1) + """
SELECT DISTINCT CAST(CAST(ai_is_potential_idea AS INTEGER) AS VARCHAR) AS value
FROM b1_posts WHERE ai_is_potential_idea IS NOT NULL""")
def q_distinct_values_flag(spark, sf_dir):
    return stats.distinct_values(B.posts_b1(spark, sf_dir), "ai_is_potential_idea")


@register("avg_comments", SB.with_(SB.B1) + """
SELECT (SELECT count(*) FROM b1_comments) AS total_comments,
       (SELECT coalesce(avg(n), 0.0) FROM (SELECT count(comment_id) AS n FROM b1_comments
                                           GROUP BY internal_post_id)) AS avg_comments_per_post""")
def q_avg_comments(spark, sf_dir):
    return stats.comment_counts(B.comments_b1(spark, sf_dir))


@register("groups_list", SB.with_(SB.B1_GROUPS) + """
SELECT group_id, group_name, group_url FROM b1_groups ORDER BY group_name, group_id""")
def q_groups_list(spark, sf_dir):
    return search.list_groups(B.groups_b1(spark, sf_dir)).select(
        "group_id", "group_name", "group_url")


def _legacy_posts(spark, sf_dir):
    """B1 posts stored the legacy way: keyword lists as JSON text (encoded twice for
    even ids), flags as 0/1 integers."""
    from pyspark.sql import functions as F
    p = B.posts_b1(spark, sf_dir)
    once = F.to_json("ai_keywords")
    twice = F.to_json(F.array(once)).substr(F.lit(2), F.length(F.to_json(F.array(once))) - 2)
    return p.select(
        "internal_post_id",
        F.when(F.col("internal_post_id") % 2 == 0, twice).otherwise(once).alias("ai_keywords"),
        F.col("ai_is_potential_idea").cast("int").alias("ai_is_potential_idea"),
        F.col("is_processed_by_ai").cast("int").alias("is_processed_by_ai"))


@register("typed_read", SB.with_(SB.B1_POSTS) + """
SELECT internal_post_id,
       CASE WHEN is_processed_by_ai
            THEN lower(ai_sub_category) || ',' || lower(CASE WHEN is_processed_by_ai
                 THEN (SELECT o_orderstatus FROM orders WHERE o_orderkey = internal_post_id) END)
            ELSE '' END AS keywords_text,
       ai_is_potential_idea, is_processed_by_ai
FROM b1_posts""")
def q_typed_read(spark, sf_dir):
    """P1 + X15: legacy-encoded rows read back as typed columns."""
    from pyspark.sql import functions as F
    from agora.sources.sinks import typed_read
    t = typed_read(_legacy_posts(spark, sf_dir))
    return t.select("internal_post_id", F.array_join("ai_keywords", ",").alias("keywords_text"),
                    "ai_is_potential_idea", "is_processed_by_ai")
