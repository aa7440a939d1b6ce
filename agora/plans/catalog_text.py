"""Registered scalar-function queries: urls and ids (X1-X4 F16 F17), time text."""

from __future__ import annotations

from pyspark.sql import functions as F

from agora.functions import timeparse, urls
from agora.plans import sql_bindings as SB
from agora.plans.registry import register
from agora.sources import bindings as B

HOST = "example.com"


@register("canonical_url", r"""
SELECT page_id,
       CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+')
            THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*[^?#]*)', 1) END
         AS canonical_url,
       coalesce(strpos(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)),
                       'example.com') > 0, FALSE) AS on_host
FROM pages""")
def q_canonical_url(spark, sf_dir):
    p = B.pages(spark, sf_dir)
    return p.select("page_id", urls.canonical_url(F.col("url")).alias("canonical_url"),
                    urls.host_matches(F.col("url"), HOST).alias("on_host"))


@register("record_id", r"""
WITH u AS (
  SELECT page_id, url,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(url, '\?([^#]*)', 1) AS query,
         coalesce(strpos(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)),
                         'example.com') > 0, FALSE) AS on_host
  FROM pages),
c AS (
  SELECT page_id, url, on_host,
         regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*[^?#]*)', 1) AS post_url,
         coalesce(
           nullif(regexp_extract(path, '/(\d{10,})', 1), ''),
           CASE WHEN regexp_extract(path, '^(?:[^/]*/)*?en/([^/]*)', 1) SIMILAR TO '[a-zA-Z0-9._-]+'
                THEN regexp_extract(path, '^(?:[^/]*/)*?en/([^/]*)', 1) END) AS digits_or_seg
  FROM u)
SELECT page_id,
       CASE WHEN on_host THEN post_url END AS post_url,
       CASE WHEN on_host THEN digits_or_seg END AS lang_segment_or_digits
FROM c""")
def q_record_id(spark, sf_dir):
    """X2 applied to the page urls; the 'en' language segment stands in for the
    posts segment of a permalink (same rule, different segment name)."""
    p = B.pages(spark, sf_dir)
    on_host = urls.host_matches(F.col("url"), HOST)
    path = F.try_parse_url(F.col("url"), F.lit("PATH"))
    seg = urls._segment_after(path, "en")
    digits = F.nullif(F.regexp_extract(path, r"/(\d{10,})", 1), F.lit(""))
    return p.select(
        "page_id",
        F.when(on_host, urls.canonical_url(F.col("url"))).alias("post_url"),
        F.when(on_host, F.coalesce(digits, seg)).alias("lang_segment_or_digits"))


_IDENT = SB.url_identity_sql("url", HOST, "strpos(html, '<abbr') > 0", "page_id")


@register("post_identity", f"""
SELECT page_id, {_IDENT["post_url"]} AS post_url, {_IDENT["post_id"]} AS post_id,
       {_IDENT["is_candidate"]} AS is_candidate
FROM pages""")
def q_post_identity(spark, sf_dir):
    """Full permalink identity (X1+X2+X3+F16) of every page."""
    p = B.pages(spark, sf_dir)
    ident = urls.post_identity(F.col("url"), HOST, F.col("html").contains("<abbr"),
                               F.col("page_id"))
    return p.select("page_id", *[v.alias(k) for k, v in ident.items()])


# event_id % 8 picks the printed form; the expected value is ts at the printed precision.
_FORMS = 8


def _time_texts(spark, sf_dir):
    e = B.events(spark, sf_dir).select("event_id", "ts")
    k = F.col("event_id") % _FORMS
    n = (F.col("event_id") % 5 + 1).cast("int")
    ts = F.col("ts")
    base = (F.when(k == 3, ts + F.make_dt_interval(F.lit(0), n))
            .when(k == 4, ts + F.make_dt_interval(F.lit(1)))
            .otherwise(ts + F.make_dt_interval(F.lit(2))))
    text = (F.when(k == 0, F.concat(F.date_format(ts + F.make_dt_interval(F.lit(0), F.lit(2)),
                                                  "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
            .when(k == 1, F.date_format(ts, "MMMM d, yyyy 'at' h:mm a"))
            .when(k == 2, F.date_format(ts, "MMMM d 'at' h:mm a"))
            .when(k == 3, F.concat(n.cast("string"), F.lit(" hrs ago")))
            .when(k == 4, F.concat(F.lit("Yesterday at "), F.date_format(ts, "h:mm a")))
            .when(k == 5, F.date_format(ts, "yyyy-MM-dd"))
            .when(k == 6, F.lit("Just now"))
            .otherwise(F.lit("sometime soon")))
    return e.select("event_id", text.alias("time_text"), base.alias("base_ts"),
                    F.when(k == 6, ts).alias("now_ts"))


@register("parse_time_text", """
SELECT event_id,
       CASE event_id % 8
         WHEN 0 THEN date_trunc('second', ts)
         WHEN 1 THEN date_trunc('minute', ts)
         WHEN 2 THEN date_trunc('minute', ts)
         WHEN 3 THEN ts
         WHEN 4 THEN date_trunc('minute', ts)
         WHEN 5 THEN date_trunc('day', ts)
         WHEN 6 THEN ts + INTERVAL 2 DAY
         ELSE NULL END AS parsed_at,
       event_id % 8 = 5 AS date_arg_ok
FROM events""")
def q_parse_time_text(spark, sf_dir):
    t = _time_texts(spark, sf_dir)
    return t.select("event_id",
                    timeparse.parse_time_text(F.col("time_text"), F.col("base_ts")).alias("parsed_at"),
                    timeparse.valid_date_arg(F.col("time_text")).alias("date_arg_ok"))


@register("valid_group_url", r"""
SELECT page_id,
       regexp_matches(replace(url, 'example.com', 'facebook.com/groups'),
                      '(?i)^https?://(www\.)?(facebook\.com|fb\.com)/groups/[\w.-]+/?.*$') AS ok
FROM pages""")
def q_valid_group_url(spark, sf_dir):
    """F17 on page urls rewritten to the group-url shape (host -> group path)."""
    p = B.pages(spark, sf_dir)
    u = F.replace(F.col("url"), F.lit("example.com"), F.lit("facebook.com/groups"))
    return p.select("page_id", urls.valid_group_url(u).alias("ok"))
