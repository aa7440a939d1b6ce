"""Registered queries for rules that the other catalogs' data never reach (F10 F17 S3 P5 X2 A10
W1 with a NULL shard and small blocks, M1 M2 with shared ordinals, M7 with cascade)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from agora.functions import urls
from agora.operators import annotate as AN
from agora.operators import ingest, search, stats
from agora.plans import sql_bindings as SB
from agora.plans.registry import register
from agora.sources import bindings as B


@register("search_ideas", SB.with_(SB.B1) + """
SELECT internal_post_id, ai_category, ai_is_potential_idea, keywords_text, idea_flag FROM (
  SELECT p.*, lower(ai_sub_category) || ', ' || lower(o_orderstatus) AS keywords_text, 'Yes' AS idea_flag
  FROM b1_posts p JOIN orders ON o_orderkey = internal_post_id
  WHERE is_processed_by_ai AND ai_is_potential_idea)""")
def q_search_ideas(spark, sf_dir):
    """F10 + P5: posts flagged as ideas, as they are shown."""
    found = search.search_posts(B.posts_b1(spark, sf_dir), B.comments_b1(spark, sf_dir), is_idea=True, order=False)
    return search.typed_posts(found).select("internal_post_id", "ai_category", "ai_is_potential_idea",
                                            "keywords_text", "idea_flag")


@register("thread_positions", SB.with_(SB.B1) + """
SELECT p.internal_post_id, c.comment_id,
       CASE WHEN coalesce(p.ai_is_potential_idea, FALSE) THEN 'Yes' ELSE 'No' END AS idea_flag,
       CAST(row_number() OVER (PARTITION BY p.internal_post_id
                               ORDER BY c.comment_scraped_at NULLS LAST, c.comment_id) AS INTEGER) AS pos
FROM b1_posts p LEFT JOIN b1_comments c ON p.internal_post_id = c.internal_post_id""")
def q_thread_positions(spark, sf_dir):
    """S3: the place of each comment in its thread, taken from the order of the rows."""
    threads = search.post_threads(B.posts_b1(spark, sf_dir), B.comments_b1(spark, sf_dir))
    place = threads.withColumn("_at", F.monotonically_increasing_id())
    nth = F.row_number().over(Window.partitionBy("internal_post_id").orderBy("_at"))
    return place.withColumn("pos", nth).select("internal_post_id", "comment_id", "idea_flag", "pos")


_LINKS = ("https://forum.example.com/groups/g/posts/{0}?ref=9", "https://forum.example.com/videos/{0}/",
          "https://forum.example.com/page?story_fbid={0}&id=7", "https://forum.example.com/x?fbid={0}#c",
          "https://forum.example.com/a/1234567890{0}/b", "https://forum.example.com/photos/%20/{0}",
          "https://forum.example.com/about")


@register("record_ids", f"""
WITH l AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k FROM orders)
SELECT o_orderkey, CASE o_orderkey % {len(_LINKS)}
  WHEN 0 THEN k WHEN 1 THEN k WHEN 2 THEN k WHEN 3 THEN k WHEN 4 THEN '1234567890' || k
  ELSE NULL END AS record_id FROM l""")
def q_record_ids(spark, sf_dir):
    """Ids of links of every form, made of the order keys."""
    k = F.col("o_orderkey").cast("string")
    made = [F.concat(*[x for i, part in enumerate(link.split("{0}")) for x in ([k] if i else []) + [F.lit(part)]])
            for link in _LINKS]
    link = F.coalesce(*[F.when(F.col("o_orderkey") % len(_LINKS) == i, m) for i, m in enumerate(made)])
    return B.table(spark, sf_dir, "orders").select("o_orderkey", urls.record_id(link).alias("record_id"))


@register("group_url_forms", """
SELECT c_custkey, c_custkey % 6 IN (0, 1, 2) AS ok FROM customer""")
def q_group_url_forms(spark, sf_dir):
    """well-formed and other group urls, made of the customer keys."""
    k = F.col("c_custkey").cast("string")
    forms = [F.concat(F.lit("https://www.fb.com/groups/"), k), F.concat(F.lit("http://fb.com/groups/é-"), k, F.lit("/?x=1")),
             F.concat(F.lit("HTTPS://FB.com/Groups/a.b_"), k, F.lit("/posts/1")),
             F.concat(F.lit("https://www.fb.com/"), k), F.concat(F.lit("ftp://fb.com/groups/"), k),
             F.concat(F.lit("https://fb.com.example.org/groups/"), k)]
    url = F.coalesce(*[F.when(F.col("c_custkey") % 6 == i, f) for i, f in enumerate(forms)])
    return B.table(spark, sf_dir, "customer").select("c_custkey", urls.valid_group_url(url).alias("ok"))


@register("run_counters", SB.with_(SB.B1) + """
SELECT count(*) AS n_posts, count(ai_category) AS n_labelled,
       CAST(count(*) FILTER (WHERE NOT is_processed_by_ai) AS BIGINT) AS n_open FROM b1_posts""")
def q_run_counters(spark, sf_dir):
    """A10: counters observed while the posts are written elsewhere."""
    out, seen = stats.run_counters(B.posts_b1(spark, sf_dir), "run_counters", n_posts=F.count(F.lit(1)),
                                   n_labelled=F.count("ai_category"), n_open=F.count_if(~F.col("is_processed_by_ai")))
    out.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([seen.get], "n_posts long, n_labelled long, n_open long")


@register("groups_delete_cascade", SB.with_(SB.B1) + """,
gone AS (SELECT CAST(n_nationkey AS BIGINT) AS group_id FROM nation WHERE n_regionkey = 1)
SELECT 'group' AS kind, group_id AS id FROM b1_groups WHERE group_id NOT IN (SELECT group_id FROM gone)
UNION ALL
SELECT 'post', internal_post_id FROM b1_posts WHERE group_id NOT IN (SELECT group_id FROM gone)
UNION ALL
SELECT 'comment', comment_id FROM b1_comments WHERE internal_post_id NOT IN (
  SELECT internal_post_id FROM b1_posts WHERE group_id IN (SELECT group_id FROM gone))""")
def q_groups_delete_cascade(spark, sf_dir):
    """M7: groups of one region go with their posts and comments; what is left."""
    ids = B.table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("group_id"))
    out = ingest.remove_groups(B.groups_b1(spark, sf_dir), B.posts_b1(spark, sf_dir), ids, cascade=True,
                               comments=B.comments_b1(spark, sf_dir))
    told = [out[t].select(F.lit(kind).alias("kind"), F.col(c).alias("id")) for t, kind, c in (
        ("groups", "group", "group_id"), ("posts", "post", "internal_post_id"), ("comments", "comment", "comment_id"))]
    return told[0].unionByName(told[1]).unionByName(told[2])


@register("ingest_shared_ordinals", """
WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT 'inserted' AS status, count(*) AS n FROM k
UNION ALL SELECT 'ignored', CAST(sum(n - 1) AS BIGINT) FROM k
UNION ALL SELECT 'inserted_two', (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))
UNION ALL SELECT 'ignored_two', (SELECT count(*) FROM lineitem) - (
  SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))""")
def q_ingest_shared_ordinals(spark, sf_dir):
    """M1 M2: rows that share ordinals (one for all of a day) are neither lost nor told twice."""
    li = B.table(spark, sf_dir, "lineitem").withColumn("ordinal", F.col("l_shipdate"))
    one = ingest.insert_one_key(None, li, ["l_orderkey", "l_linenumber"], "ordinal")
    two = ingest.insert_two_keys(None, li.withColumn("none", F.lit(None).cast("string")),
                                 ["l_orderkey", "l_linenumber"], ["none"], "ordinal")[:2]
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(s).alias("status"), "n")
             for df, s in zip([*one, *two], ["inserted", "ignored", "inserted_two", "ignored_two"])]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_NEXT_FIT = """
WITH RECURSIVE todo AS (
  SELECT doc_id, {shard} AS shard, length(text) // 4 + 100 AS tokens,
         row_number() OVER (PARTITION BY {shard} ORDER BY doc_id) AS rn FROM documents),
packed(shard, rn, doc_id, cur, batch_seq) AS (
  SELECT shard, rn, doc_id, tokens, CAST(0 AS BIGINT) FROM todo WHERE rn = 1
  UNION ALL
  SELECT t.shard, t.rn, t.doc_id, CASE WHEN p.cur + t.tokens > 3000 THEN t.tokens ELSE p.cur + t.tokens END,
         CASE WHEN p.cur + t.tokens > 3000 THEN p.batch_seq + 1 ELSE p.batch_seq END
  FROM packed p JOIN todo t ON t.shard = p.shard AND t.rn = p.rn + 1)
SELECT doc_id, nullif(shard, '') AS shard, batch_seq FROM packed"""


@register("batch_blocks", _NEXT_FIT.format(shard="CASE WHEN source = 'src0' THEN '' ELSE source END"))
def q_batch_blocks(spark, sf_dir):
    """A NULL shard is a shard, and small blocks give the batches of whole shards."""
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    shard = F.when(F.col("source") != "src0", F.col("source"))
    out = AN.pack_batches(docs, "doc_id", "text", shard, 3000, block_rows=8)
    return out.select("doc_id", "shard", "batch_seq")


@register("batch_block_tree", _NEXT_FIT.format(shard="'all'"))
def q_batch_block_tree(spark, sf_dir):
    """One shard of all documents in blocks of one row, whose maps are composed as a tree of four."""
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = AN.pack_batches(docs, "doc_id", "text", F.lit("all"), 3000, block_rows=1, fan=4)
    return out.select("doc_id", "shard", "batch_seq")
