"""Registered annotation queries (F12 F13 W1 W2 W4 X8-X15 A11 J4 J5 J8 J10 F21
UDF1-UDF5 M3 M4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from agora import schemas
from agora.operators import annotate as AN
from agora.operators import stats
from agora.plans import offline  # noqa: F401  (registers the annotator)
from agora.plans import sql_bindings as SB
from agora.plans.registry import register
from agora.sources import bindings as B

BUDGET = 2000
RUN_TS = "2024-03-01 00:00:00"


def _todo_b2(spark, sf_dir):
    return AN.unprocessed_posts(B.posts_b2(spark, sf_dir))


def _batched_b2(spark, sf_dir):
    todo = _todo_b2(spark, sf_dir).join(
        B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("internal_post_id"),
                                                   "source"), "internal_post_id")
    return AN.pack_batches(todo, "internal_post_id", "post_content_raw", F.col("source"), BUDGET)


# Next-fit packing per source over the unannotated documents, as a recursive CTE.
_BATCHES = SB.B2_POSTS + f""",
todo AS (
  SELECT internal_post_id AS doc_id, source AS shard, post_content_raw AS text,
         length(post_content_raw) // 4 + 100 AS tokens,
         row_number() OVER (PARTITION BY source ORDER BY internal_post_id) AS rn
  FROM b2_posts WHERE NOT is_processed_by_ai AND post_content_raw IS NOT NULL),
packed(shard, rn, doc_id, tokens, cur, batch_seq) AS (
  SELECT shard, rn, doc_id, tokens, tokens, CAST(0 AS BIGINT) FROM todo WHERE rn = 1
  UNION ALL
  SELECT t.shard, t.rn, t.doc_id, t.tokens,
         CASE WHEN p.cur + t.tokens > {BUDGET} THEN t.tokens ELSE p.cur + t.tokens END,
         CASE WHEN p.cur + t.tokens > {BUDGET} THEN p.batch_seq + 1 ELSE p.batch_seq END
  FROM packed p JOIN todo t ON t.shard = p.shard AND t.rn = p.rn + 1),
batched AS (
  SELECT p.shard, p.batch_seq, p.doc_id, p.tokens, t.text,
         row_number() OVER (PARTITION BY p.shard, p.batch_seq ORDER BY p.doc_id) AS pos
  FROM packed p JOIN todo t ON t.doc_id = p.doc_id)
"""


@register("unprocessed", SB.with_(SB.B2_POSTS) + """
SELECT internal_post_id, group_id FROM b2_posts
WHERE NOT is_processed_by_ai AND post_content_raw IS NOT NULL""")
def q_unprocessed(spark, sf_dir):
    return _todo_b2(spark, sf_dir).select("internal_post_id", "group_id")


@register("unprocessed_comments", SB.with_(SB.B1) + """
SELECT comment_id, internal_post_id FROM b1_comments
WHERE NOT is_processed_by_ai_comment AND comment_text IS NOT NULL""")
def q_unprocessed_comments(spark, sf_dir):
    return AN.unprocessed_comments(B.comments_b1(spark, sf_dir)).select(
        "comment_id", "internal_post_id")


@register("batch_tokens", "WITH RECURSIVE " + _BATCHES + """
SELECT doc_id AS internal_post_id, shard, batch_seq, tokens FROM batched""")
def q_batch_tokens(spark, sf_dir):
    return _batched_b2(spark, sf_dir).select("internal_post_id", "shard", "batch_seq", "tokens")


@register("batch_stats", "WITH RECURSIVE " + _BATCHES + """,
per AS (SELECT shard, batch_seq, sum(tokens) AS t FROM batched GROUP BY shard, batch_seq)
SELECT count(*) AS n_batches, CAST(sum(t) AS BIGINT) AS total_tokens,
       CAST(max(t) AS BIGINT) AS max_batch_tokens, avg(t) AS avg_batch_tokens FROM per""")
def q_batch_stats(spark, sf_dir):
    return stats.batch_statistics(_batched_b2(spark, sf_dir))


@register("batch_fixed", SB.with_(SB.B1) + """
SELECT comment_id, CAST((row_number() OVER (ORDER BY comment_id) - 1) // 5 AS BIGINT) AS chunk
FROM b1_comments WHERE NOT is_processed_by_ai_comment AND comment_text IS NOT NULL""")
def q_batch_fixed(spark, sf_dir):
    todo = AN.unprocessed_comments(B.comments_b1(spark, sf_dir))
    return AN.fixed_chunks(todo, "comment_id").select("comment_id", "chunk")


@register("prompts", "WITH RECURSIVE " + _BATCHES + """
SELECT shard || '/0/' || CAST(batch_seq AS VARCHAR) AS batch_id,
       count(*) AS n_items,
       md5('Posts:' || chr(10) || string_agg('[POST_ID_' || CAST(doc_id AS VARCHAR) || ': '
           || text || ']' || chr(10), '' ORDER BY doc_id)) AS user_md5
FROM batched GROUP BY shard, batch_seq""")
def q_prompts(spark, sf_dir):
    p = AN.build_prompts(_batched_b2(spark, sf_dir), "posts", "internal_post_id",
                         "post_content_raw")
    return p.select("batch_id", "n_items", F.md5("user").alias("user_md5"))


def _synthetic_answers(spark, sf_dir):
    """One answer per document, damaged by doc_id % 6."""
    d = B.table(spark, sf_dir, "documents")
    obj = F.to_json(F.struct(
        F.concat(F.lit("POST_ID_"), F.col("doc_id").cast("string")).alias("postId"),
        F.col("lang").alias("category"), F.lit(None).cast("string").alias("subCategory"),
        F.array(F.col("source")).alias("keywords"),
        F.substring("text", 1, 30).alias("summary"), F.lit(True).alias("isPotentialIdea"),
        F.lit("r").alias("reasoning")))
    k = F.col("doc_id") % 6
    answer = (F.when(k == 0, F.concat(F.lit("["), obj, F.lit("]")))
              .when(k == 1, F.concat(F.lit("Result:\n```json\n["), obj, F.lit("]\n```")))
              .when(k == 2, F.concat(F.lit("Here: ["), obj, F.lit("] done.")))
              .when(k == 3, F.concat(F.lit('{"data": ['), obj, F.lit("]}")))
              .when(k == 4, F.concat(F.lit("["), F.substring(obj, 1, 10)))
              .otherwise(F.lit("no answer")))
    return d.select(F.col("doc_id").cast("string").alias("batch_id"), answer.alias("answer"))


@register("parse_answers", """
SELECT CAST(doc_id AS VARCHAR) AS answer_id, doc_id AS post_id, lang AS category,
       left(text, 30) AS summary, 1 AS n_keywords
FROM documents WHERE doc_id % 6 < 4""")
def q_parse_answers(spark, sf_dir):
    r = AN.results_of(_synthetic_answers(spark, sf_dir), "posts")
    return r.filter(AN.valid_result("posts")).select(
        F.col("batch_id").alias("answer_id"), F.col("parsed_id").alias("post_id"),
        F.col("r.category").alias("category"), F.col("r.summary").alias("summary"),
        F.size("r.keywords").alias("n_keywords"))


_POST_RULE = """
res AS (
  SELECT shard, batch_seq, pos, 0 AS dup, doc_id,
         CASE WHEN doc_id % 7 = 3 THEN NULL ELSE doc_id END AS parsed_id,
         CASE WHEN length(text) < 500 THEN 'General Discussion'
              WHEN length(text) < 2000 THEN 'Question/Inquiry'
              WHEN length(text) < 10000 THEN 'Problem Statement'
              ELSE 'Project Idea' END AS category,
         left(text, 40) AS summary, length(text) % 2 = 0 AS idea
  FROM batched
  UNION ALL
  SELECT shard, batch_seq, pos, 1, doc_id, doc_id, 'Other', left(text, 40), length(text) % 2 = 0
  FROM batched WHERE doc_id % 13 = 0),
tgt AS (
  SELECT r.*,
         coalesce(r.parsed_id,
                  CASE WHEN r.summary <> '' THEN
                    (SELECT min(b.doc_id) FROM batched b
                     WHERE b.shard = r.shard AND b.batch_seq = r.batch_seq
                       AND contains(b.text, r.summary)) END) AS target,
         CASE WHEN r.parsed_id IS NOT NULL THEN 'id' ELSE 'summary' END AS matched_by
  FROM res r)
SELECT target AS internal_post_id, category AS ai_category, summary AS ai_summary,
       idea AS ai_is_potential_idea, matched_by
FROM tgt WHERE target IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY target ORDER BY pos DESC, dup DESC) = 1"""


@register("annotate_posts", "WITH RECURSIVE " + _BATCHES + "," + _POST_RULE)
def q_annotate_posts(spark, sf_dir):
    posts = B.posts_b2(spark, sf_dir)
    src = B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("internal_post_id"),
                                                     "source")
    out = AN.annotate_posts(posts.join(src, "internal_post_id"), "offline",
                            max_tokens=BUDGET, shard=F.col("source"),
                            run_ts=F.lit(RUN_TS).cast("timestamp_ntz"))
    return out["matched"].select("internal_post_id", F.col("r.category").alias("ai_category"),
                                 F.col("r.summary").alias("ai_summary"),
                                 F.col("r.isPotentialIdea").alias("ai_is_potential_idea"),
                                 "matched_by")


_POST_TARGETS = _POST_RULE.split("SELECT target AS internal_post_id")[0]


@register("annotate_posts_apply", "WITH RECURSIVE " + _BATCHES + "," + _POST_TARGETS + """,
win AS (
  SELECT target, category FROM tgt WHERE target IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY target ORDER BY pos DESC, dup DESC) = 1)
SELECT (p.is_processed_by_ai OR w.target IS NOT NULL) AS is_processed_by_ai,
       w.category AS ai_category, count(*) AS n_posts
FROM b2_posts p LEFT JOIN win w ON p.internal_post_id = w.target
GROUP BY ALL""")
def q_annotate_posts_apply(spark, sf_dir):
    """M3: the posts snapshot after the run, summarised by state and category."""
    posts = B.posts_b2(spark, sf_dir)
    src = B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("internal_post_id"),
                                                     "source")
    out = AN.annotate_posts(posts.join(src, "internal_post_id"), "offline",
                            max_tokens=BUDGET, shard=F.col("source"),
                            run_ts=F.lit(RUN_TS).cast("timestamp_ntz"))
    return out["posts"].groupBy("is_processed_by_ai", "ai_category").agg(
        F.count(F.lit(1)).alias("n_posts"))


@register("annotate_comments", SB.with_(SB.B3) + f"""
SELECT comment_id,
       {list(schemas.COMMENT_CATEGORIES)}[length(comment_text) % 8 + 1] AS ai_comment_category,
       {list(schemas.COMMENT_SENTIMENTS)}[length(comment_text) % 3 + 1] AS ai_comment_sentiment
FROM b3_comments WHERE comment_id % 9 <> 4""")
def q_annotate_comments(spark, sf_dir):
    out = AN.annotate_comments(B.comments_b3(spark, sf_dir), "offline",
                               run_ts=F.lit(RUN_TS).cast("timestamp_ntz"))
    return out["comments"].filter(F.col("ai_comment_category").isNotNull()).select(
        "comment_id", "ai_comment_category", "ai_comment_sentiment")
