"""Registered streaming queries (ST1-ST4, S6) — each equals its batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from agora.operators import extract
from agora.plans import sql_bindings as SB
from agora.plans.catalog_extract import _POSTS_SQL as POSTS_SQL
from agora.plans.registry import register
from agora.session import scratch_path
from agora.sources import bindings as B
from agora.streaming import ingest_stream as S
from agora.streaming.either_key import either_key

HOST = "example."
SCRAPE_TS = "2024-02-01 00:00:00"


def _event_posts(df):
    """An event is a post: id, author, category, time."""
    return df.select(
        F.col("event_id").alias("internal_post_id"),
        F.concat(F.lit("ev"), F.col("event_id").cast("string")).alias("external_post_id"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("post_author_name"),
        F.col("event_type").alias("ai_category"),
        F.col("ts").alias("posted_at"),
        F.struct("ts", "event_id").alias("ordinal"))


@register("stream_ingest", """
SELECT event_id AS internal_post_id, 'ev' || CAST(event_id AS VARCHAR) AS external_post_id,
       'user_' || CAST(user_id AS VARCHAR) AS post_author_name, event_type AS ai_category,
       ts AS posted_at
FROM events""")
def q_stream_ingest(spark, sf_dir):
    """ST1 + ST2 + ST4: every event lands twice (a re-scrape) in 16 files; the
    stream reads 4 files per round and stores each record once."""
    events = B.events(spark, sf_dir)
    landing = scratch_path(spark, "landing-events")
    S.land_files(events, landing, n_files=8, copies=2)
    store = scratch_path(spark, "store-events")
    S.run_ingest_stream(spark, landing, events.schema, store,
                        scratch_path(spark, "ckpt-events"), _event_posts,
                        S.one_key_sink(store, ["external_post_id"], "ordinal"),
                        max_files_per_trigger=4)
    return spark.read.parquet(store).drop(S.BATCH_COL, "ordinal")


def _page_records(df):
    posts = extract.extract_pages(df, HOST, base_ts=F.lit(SCRAPE_TS).cast("timestamp_ntz"),
                                  fields=("post_author_name", "content_text"))
    return posts.withColumn("ordinal", F.col("page_id"))


ROUNDS = 2


@register("stream_pages_ingest", SB.two_key_first_wins(
    f"SELECT (page_id % {ROUNDS}) * 1000000000 + page_id AS o, * FROM ({POSTS_SQL}) r",
    ["external_post_id"], ["post_url"],
    "SELECT b.page_id, b.external_post_id, b.post_url, b.post_author_name, b.content_text "
    "FROM kept k JOIN base b ON k.o = b.o"))
def q_stream_pages_ingest(spark, sf_dir):
    """ST1 on pages: extraction inside the stream, two-key (id, url) insert per round. Each file is
    a round and holds the pages of one remainder; then all of them land again."""
    pages = B.pages(spark, sf_dir)
    landing = scratch_path(spark, "landing-pages")
    for _ in range(2):
        for r in range(ROUNDS):
            S.land_files(pages.where(F.col("page_id") % ROUNDS == r), landing, n_files=1)
    store = scratch_path(spark, "store-pages")
    S.run_ingest_stream(spark, landing, pages.schema, store, scratch_path(spark, "ckpt-pages"),
                        _page_records,
                        S.two_key_sink(store, ["external_post_id"], ["post_url"], "ordinal"),
                        max_files_per_trigger=1)
    return spark.read.parquet(store).select("page_id", "external_post_id", "post_url",
                                            "post_author_name", "content_text")


@register("stream_pages_indexed", SB.two_key_first_wins(
    f"SELECT (page_id % {ROUNDS}) * 1000000000 + page_id AS o, * FROM ({POSTS_SQL}) r",
    ["external_post_id"], ["post_url"],
    "SELECT b.page_id, b.external_post_id, b.post_url, b.post_author_name, b.content_text "
    "FROM kept k JOIN base b ON k.o = b.o"))
def q_stream_pages_indexed(spark, sf_dir):
    """stream_pages_ingest with the stored keys in a key table: a round reads no history but the parts its
    keys fall in; parts this small are split and merged all the time."""
    pages = B.pages(spark, sf_dir)
    landing = scratch_path(spark, "landing-pages")
    for _ in range(2):
        for r in range(ROUNDS):
            S.land_files(pages.where(F.col("page_id") % ROUNDS == r), landing, n_files=1)
    store = scratch_path(spark, "store-pages")
    S.run_ingest_stream(spark, landing, pages.schema, store, scratch_path(spark, "ckpt-pages"), _page_records,
                        S.indexed_sink(store, [["external_post_id"], ["post_url"]], "ordinal",
                                       part_bytes=16 << 10, most_files=2, most_batches=2),
                        max_files_per_trigger=1)
    return S.stored_rows(spark, store, _page_records(pages).schema).select(
        "page_id", "external_post_id", "post_url", "post_author_name", "content_text")


# two keys of a visit: one event of a type per user and day, one event per user and hour
_VISIT = ["event_id", "user_id", "event_type", "ts"]
TIME_ROUNDS = 3


def _visits(events):
    return events.select(*_VISIT, F.to_date("ts").alias("day"), F.date_trunc("hour", "ts").alias("hour"))


def _by_time(events):
    """The events in rounds of rising time, then the last round and the first one again."""
    lo, hi = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))),
                        F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    nth = F.floor((at - F.lit(lo)) * TIME_ROUNDS / F.lit(hi - lo + 1))
    for r in [*range(TIME_ROUNDS), TIME_ROUNDS - 1, 0]:
        yield events.where(nth == r)


@register("stream_either_key", SB.two_key_first_wins(
    "SELECT row_number() OVER (ORDER BY ts, event_id) AS o, event_id, user_id, event_type, ts, "
    "user_id AS same_user, CAST(ts AS DATE) AS day, date_trunc('hour', ts) AS hour FROM events",
    ["user_id", "event_type", "day"], ["same_user", "hour"],
    "SELECT b.event_id, b.user_id, b.event_type, b.ts FROM kept k JOIN base b ON k.o = b.o"))
def q_stream_either_key(spark, sf_dir):
    """ST2 inside the stream: both keys in the state of a stateful operator, bounded by the watermark. Keys hold
    the day, so two days of lateness lose none; landing the first and last rounds again stores nothing."""
    events = B.events(spark, sf_dir)
    landing = scratch_path(spark, "landing-visits")
    store, checkpoint = scratch_path(spark, "store-visits"), scratch_path(spark, "ckpt-visits")
    # one batch a round, as in a stream that runs on: a batch without rows after each would move the watermark early
    no_data = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(no_data)
    spark.conf.set(no_data, "false")
    try:
        for part in _by_time(events):
            S.land_round(part, landing)
            visits = _visits(spark.readStream.schema(events.schema).parquet(landing))
            kept = either_key(visits, "user_id", ["user_id", "event_type", "day"], ["user_id", "hour"], ["ts", "event_id"],
                              "ts", lateness_seconds=2 * 86400).select(*_VISIT)
            (kept.writeStream.format("parquet").option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).outputMode("append").start(store).awaitTermination())
    finally:
        spark.conf.set(no_data, before)
    return spark.read.schema(kept.schema).parquet(store)
