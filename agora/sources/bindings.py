"""Bindings of the driver's parquet tables to the discussion store.

The benchmark data has no discussion tables; these views give the store's three
tables (and the raw inputs of ingest / annotation / extraction) a stand-in that
grows with the data:

* B1 relational: groups <- nation; posts <- orders x customer;
  comments <- lineitem x part x supplier (one comment per (orderkey, linenumber)).
* B2 corpus:     posts <- documents, annotation state <- labels.
* B3 threads:    conversations, turn 0 = post, later turns = comments.
* B4 pages:      pages(page_id, url, html) for extraction.
* B5 stream:     events (id, author, category, time).

Every function is a lazy plan; Catalyst prunes the columns a query does not use
and pushes filters into the parquet scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agora import schemas

GROUP_URL_PREFIX = "https://groups.example.com/g/"
IDEA_PRICE_THRESHOLD = 400000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _null(type_name: str) -> Column:
    return F.lit(None).cast(type_name)


def conform(df: DataFrame, schema) -> DataFrame:
    """Select a table's columns in schema order, filling absent ones with NULL."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


# ---------------------------------------------------------------- B1 relational
def groups_b1(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return conform(n.select(
        F.col("n_nationkey").cast("bigint").alias("group_id"),
        F.col("n_name").alias("group_name"),
        F.concat(F.lit(GROUP_URL_PREFIX), F.col("n_nationkey").cast("string")).alias("group_url"),
    ), schemas.GROUPS)


def posts_b1(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    processed = F.col("o_orderstatus") != F.lit("P")
    df = o.join(c, o.o_custkey == c.c_custkey, "inner").select(
        F.col("o_orderkey").alias("internal_post_id"),
        F.col("c_nationkey").cast("bigint").alias("group_id"),
        F.concat(F.lit("op"), F.col("o_orderkey").cast("string")).alias("external_post_id"),
        F.concat(F.lit(GROUP_URL_PREFIX), F.col("c_nationkey").cast("string"),
                 F.lit("/posts/"), F.col("o_orderkey").cast("string")).alias("post_url"),
        F.concat(F.col("o_orderpriority"), F.lit(" order from the "),
                 F.col("c_mktsegment"), F.lit(" segment")).alias("post_content_raw"),
        F.col("c_name").alias("post_author_name"),
        F.col("o_orderdate").alias("posted_at"),
        F.col("o_orderdate").alias("scraped_at"),
        F.when(processed, F.col("o_orderpriority")).alias("ai_category"),
        F.when(processed, F.col("c_mktsegment")).alias("ai_sub_category"),
        F.when(processed, F.array(F.lower(F.col("c_mktsegment")),
                                  F.lower(F.col("o_orderstatus")))).alias("ai_keywords"),
        F.when(processed, F.col("o_totalprice") > F.lit(IDEA_PRICE_THRESHOLD))
         .alias("ai_is_potential_idea"),
        processed.alias("is_processed_by_ai"),
        F.when(processed, F.col("o_orderdate")).alias("last_ai_processing_at"),
    )
    return conform(df, schemas.POSTS)


def lineitem_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lineitem per (orderkey, linenumber): the first by (shipdate, part, supplier,
    status). Rows tied on all four give identical comment rows, so the choice is
    deterministic in everything the binding emits.

    ``min(struct)`` aggregates partially before the shuffle, so duplicates of a
    hot key collapse map-side instead of landing in one task.
    """
    li = table(spark, sf_dir, "lineitem")
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_linestatus"]
    first = (li.groupBy("l_orderkey", "l_linenumber")
             .agg(F.min(F.struct(*order)).alias("r")))
    return first.select("l_orderkey", "l_linenumber", *[F.col(f"r.{c}").alias(c) for c in order])


def comments_b1(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = lineitem_first(spark, sf_dir)
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    df = (li.join(p, li.l_partkey == p.p_partkey, "inner")
          .join(s, li.l_suppkey == s.s_suppkey, "inner")
          .select(
              (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("comment_id"),
              F.col("l_orderkey").alias("internal_post_id"),
              F.col("s_name").alias("commenter_name"),
              F.concat(F.col("p_name"), F.lit(" ("), F.col("p_type"), F.lit(")"))
               .alias("comment_text"),
              F.concat(F.col("l_orderkey").cast("string"), F.lit("-"),
                       F.col("l_linenumber").cast("string")).alias("external_comment_id"),
              F.col("l_shipdate").alias("comment_scraped_at"),
              F.col("l_shipdate").alias("commented_at"),
              (F.col("l_linestatus") == F.lit("F")).alias("is_processed_by_ai_comment"),
          ))
    return conform(df, schemas.COMMENTS)


# ---------------------------------------------------------------- B2 corpus
def posts_b2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as posts; a document with a label row counts as annotated."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    df = d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("internal_post_id"),
        F.regexp_extract("source", r"(\d+)$", 1).cast("bigint").alias("group_id"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("external_post_id"),
        F.concat(F.lit("https://docs.example.com/"), F.col("source"), F.lit("/"),
                 F.col("doc_id").cast("string")).alias("post_url"),
        F.col("text").alias("post_content_raw"),
        F.col("lang").alias("post_author_name"),
        (F.col("quality") == 1).alias("ai_is_potential_idea"),
        F.col("quality").isNotNull().alias("is_processed_by_ai"),
    )
    return conform(df, schemas.POSTS)


# ---------------------------------------------------------------- B3 threads
def posts_b3(spark: SparkSession, sf_dir: str) -> DataFrame:
    cv = table(spark, sf_dir, "conversations")
    df = cv.filter(F.col("turn") == 0).select(
        F.col("conv_id").alias("internal_post_id"),
        F.lit(0).cast("bigint").alias("group_id"),
        F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("external_post_id"),
        F.col("text").alias("post_content_raw"),
        F.col("role").alias("post_author_name"),
        F.lit(True).alias("is_processed_by_ai"),
    )
    return conform(df, schemas.POSTS)


def comments_b3(spark: SparkSession, sf_dir: str) -> DataFrame:
    cv = table(spark, sf_dir, "conversations")
    df = cv.filter(F.col("turn") > 0).select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("comment_id"),
        F.col("conv_id").alias("internal_post_id"),
        F.col("role").alias("commenter_name"),
        F.col("text").alias("comment_text"),
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
         .alias("external_comment_id"),
        # turn order stands in for scrape time: turn t -> epoch + t seconds
        F.make_timestamp_ntz(F.lit(1970), F.lit(1), F.lit(1), F.lit(0), F.lit(0),
                             F.col("turn").cast("decimal(16,6)")).alias("comment_scraped_at"),
        F.lit(False).alias("is_processed_by_ai_comment"),
    )
    return conform(df, schemas.COMMENTS)


# ---------------------------------------------------------------- B4 / B5
def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")
