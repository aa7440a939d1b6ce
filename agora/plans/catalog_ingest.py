"""Registered ingest / table-maintenance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from agora.operators import ingest
from agora.plans import sql_bindings as SB
from agora.plans.registry import register
from agora.sources import bindings as B

STORED_BEFORE = "1998-01-01 00:00:00"


def _incoming_comments(spark, sf_dir):
    """A re-scrape of every comment: lineitem rows keyed by ``orderkey-linenumber``."""
    li = B.table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"),
                 F.col("l_linenumber").cast("string")).alias("external_comment_id"),
        F.col("l_orderkey").alias("internal_post_id"),
        "l_partkey", "l_suppkey", "l_shipdate",
        F.struct("l_shipdate", "l_partkey", "l_suppkey").alias("ordinal"))


@register("ingest_comments_dedup", SB.with_(SB.B1) + f""",
inc AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS external_comment_id,
         l_orderkey AS internal_post_id, l_partkey, l_suppkey, l_shipdate
  FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                             ORDER BY l_shipdate, l_partkey, l_suppkey) = 1)
SELECT * FROM inc
WHERE external_comment_id NOT IN (
  SELECT external_comment_id FROM b1_comments
  WHERE comment_scraped_at < TIMESTAMP '{STORED_BEFORE}')""")
def q_ingest_comments_dedup(spark, sf_dir):
    stored = B.comments_b1(spark, sf_dir).filter(
        F.col("comment_scraped_at") < F.lit(STORED_BEFORE).cast("timestamp_ntz"))
    inserted, _ = ingest.insert_one_key(stored, _incoming_comments(spark, sf_dir),
                                        ["external_comment_id"], "ordinal")
    return inserted.drop("ordinal")


def lineitem_with_ordinal(spark, sf_dir):
    li = B.table(spark, sf_dir, "lineitem")
    order = ["l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity",
             "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    return ingest.with_ordinal(li, order, "ordinal")


@register("ingest_posts_two_key", SB.two_key_first_wins(
    """SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_shipdate, l_partkey,
         l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
         l_linestatus) AS o, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem""",
    ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"],
    "SELECT o AS ordinal, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM kept"))
def q_ingest_posts_two_key(spark, sf_dir):
    """M1 on lineitem: key 1 = (orderkey, linenumber), key 2 = (partkey, suppkey)."""
    rows = lineitem_with_ordinal(spark, sf_dir)
    inserted, _, _ = ingest.insert_two_keys(None, rows, ["l_orderkey", "l_linenumber"],
                                            ["l_partkey", "l_suppkey"], "ordinal", unique=True)
    return inserted.select("ordinal", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _group_requests(spark, sf_dir):
    c = B.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("requester"),
        F.concat(F.lit(B.GROUP_URL_PREFIX), F.col("c_nationkey").cast("string")).alias("group_url"))
    s = B.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("requester"),
        F.concat(F.lit("https://groups.example.com/s/"), F.col("s_nationkey").cast("string"))
        .alias("group_url"))
    return c.unionByName(s)


@register("groups_upsert", SB.with_(SB.B1_GROUPS) + """,
req AS (
  SELECT 'c' || CAST(c_custkey AS VARCHAR) AS requester,
         'https://groups.example.com/g/' || CAST(c_nationkey AS VARCHAR) AS group_url FROM customer
  UNION ALL
  SELECT 's' || CAST(s_suppkey AS VARCHAR),
         'https://groups.example.com/s/' || CAST(s_nationkey AS VARCHAR) FROM supplier),
misses AS (
  SELECT group_url, row_number() OVER (ORDER BY group_url) AS seq
  FROM (SELECT DISTINCT group_url FROM req) u
  WHERE group_url NOT IN (SELECT group_url FROM b1_groups)),
after AS (
  SELECT group_id, group_name, group_url FROM b1_groups
  UNION ALL
  SELECT (SELECT max(group_id) FROM b1_groups) + seq, 'Group from ' || group_url, group_url
  FROM misses)
SELECT r.requester, r.group_url, a.group_id, a.group_name
FROM req r LEFT JOIN after a ON r.group_url = a.group_url""")
def q_groups_upsert(spark, sf_dir):
    resolved, after = ingest.get_or_create_groups(B.groups_b1(spark, sf_dir),
                                                  _group_requests(spark, sf_dir))
    return resolved.join(after.select("group_url", "group_name"), "group_url", "left").select(
        "requester", "group_url", "group_id", "group_name")


def _groups_with_regions(spark, sf_dir):
    """nation groups plus one (post-less) group per region, id 1000 + regionkey."""
    r = B.table(spark, sf_dir, "region").select(
        (F.col("r_regionkey") + 1000).cast("bigint").alias("group_id"),
        F.col("r_name").alias("group_name"),
        F.concat(F.lit("https://groups.example.com/r/"), F.col("r_regionkey").cast("string"))
        .alias("group_url"),
        F.lit(None).cast("timestamp_ntz").alias("last_scraped_at"))
    return B.groups_b1(spark, sf_dir).unionByName(r)


@register("groups_delete_restrict", SB.with_(SB.B1) + """,
grp AS (
  SELECT group_id FROM b1_groups
  UNION ALL SELECT CAST(r_regionkey + 1000 AS BIGINT) FROM region),
req AS (
  SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS group_id FROM nation WHERE n_regionkey = 1
  UNION SELECT CAST(r_regionkey + 1000 AS BIGINT) FROM region WHERE r_regionkey IN (1, 2)
  UNION SELECT CAST(r_regionkey + 2000 AS BIGINT) FROM region WHERE r_regionkey = 3)
SELECT group_id,
       CASE WHEN group_id NOT IN (SELECT group_id FROM grp) THEN 'unknown'
            WHEN group_id IN (SELECT group_id FROM b1_posts) THEN 'refused'
            ELSE 'removed' END AS status
FROM req""")
def q_groups_delete_restrict(spark, sf_dir):
    groups = _groups_with_regions(spark, sf_dir)
    n = B.table(spark, sf_dir, "nation")
    r = B.table(spark, sf_dir, "region")
    ids = (n.filter(F.col("n_regionkey") == 1).select(F.col("n_nationkey").alias("group_id"))
           .unionByName(r.filter(F.col("r_regionkey").isin(1, 2))
                        .select((F.col("r_regionkey") + 1000).alias("group_id")))
           .unionByName(r.filter(F.col("r_regionkey") == 3)
                        .select((F.col("r_regionkey") + 2000).alias("group_id"))))
    out = ingest.remove_groups(groups, B.posts_b1(spark, sf_dir), ids)
    return (out["removed"].withColumn("status", F.lit("removed"))
            .unionByName(out["refused"].withColumn("status", F.lit("refused")))
            .unionByName(out["unknown"].withColumn("status", F.lit("unknown"))))


@register("fk_quarantine", SB.with_(SB.B1) + """,
grp AS (SELECT b.group_id FROM b1_groups b JOIN nation ON b.group_id = n_nationkey
        WHERE n_regionkey <> 0),
badp AS (SELECT internal_post_id FROM b1_posts WHERE group_id NOT IN (SELECT group_id FROM grp))
SELECT 'post' AS kind, internal_post_id AS id FROM badp
UNION ALL
SELECT 'comment', comment_id FROM b1_comments
WHERE internal_post_id NOT IN (SELECT internal_post_id FROM b1_posts
                               WHERE group_id IN (SELECT group_id FROM grp))""")
def q_fk_quarantine(spark, sf_dir):
    n = B.table(spark, sf_dir, "nation").filter(F.col("n_regionkey") != 0)
    groups = B.groups_b1(spark, sf_dir).join(
        n.select(F.col("n_nationkey").cast("bigint").alias("group_id")), "group_id", "left_semi")
    out = ingest.fk_quarantine(groups, B.posts_b1(spark, sf_dir), B.comments_b1(spark, sf_dir))
    return (out["posts_quarantine"].select(F.lit("post").alias("kind"),
                                           F.col("internal_post_id").alias("id"))
            .unionByName(out["comments_quarantine"].select(F.lit("comment").alias("kind"),
                                                           F.col("comment_id").alias("id"))))


@register("cap_per_group", SB.with_(SB.B1_POSTS) + """
SELECT group_id, internal_post_id, posted_at FROM b1_posts
QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY posted_at, internal_post_id) <= 20""")
def q_cap_per_group(spark, sf_dir):
    p = B.posts_b1(spark, sf_dir).select(
        "group_id", "internal_post_id", "posted_at",
        F.struct("posted_at", "internal_post_id").alias("ordinal"))
    return ingest.cap_per_group(p, ["group_id"], "ordinal", 20).drop("ordinal")


def _group_adds(spark, sf_dir):
    """New-group requests: one per part (brand name, type url) after one per
    nation (existing name, new url), in that order."""
    n = B.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("ordinal"), F.col("n_name").alias("group_name"),
        F.concat(F.lit("https://groups.example.com/n/"), F.col("n_regionkey").cast("string"))
        .alias("group_url"))
    p = B.table(spark, sf_dir, "part").select(
        (F.col("p_partkey") + 1000000).alias("ordinal"),
        F.concat(F.lit("Brand "), F.col("p_brand")).alias("group_name"),
        F.concat(F.lit("https://groups.example.com/t/"), F.col("p_type")).alias("group_url"))
    return n.unionByName(p)


@register("groups_add", SB.two_key_first_wins(
    """SELECT o, group_name, group_url FROM (
         SELECT CAST(n_nationkey AS BIGINT) AS o, n_name AS group_name,
                'https://groups.example.com/n/' || CAST(n_regionkey AS VARCHAR) AS group_url
         FROM nation
         UNION ALL
         SELECT p_partkey + 1000000, 'Brand ' || p_brand,
                'https://groups.example.com/t/' || p_type FROM part) r
       WHERE group_name NOT IN (SELECT n_name FROM nation)
         AND group_url NOT IN (SELECT 'https://groups.example.com/g/' || CAST(n_nationkey AS VARCHAR)
                               FROM nation)""",
    ["group_name"], ["group_url"],
    """SELECT (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY o) AS group_id,
              group_name, group_url FROM kept"""))
def q_groups_add(spark, sf_dir):
    groups = B.groups_b1(spark, sf_dir)
    after, _ = ingest.add_groups(groups, _group_adds(spark, sf_dir), "ordinal")
    return after.join(groups.select("group_id"), "group_id", "left_anti").select(
        "group_id", "group_name", "group_url")
