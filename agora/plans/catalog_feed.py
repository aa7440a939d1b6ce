"""Extraction of feed elements: pages written from the given tables, so that every field's true value is known.

Each customer is a page and each order of it a comment. What a field looks like on the page (which of the
accepted forms, or none) depends on the row, so all branches of E1, E4-E6, E9, F16, X4, X5 and X7 occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora import schemas
from agora.operators import extract
from agora.plans.registry import register
from agora.sources import bindings as B

HOST = "forum.example"
SCRAPE_TS = "2024-02-01 12:00:00"
_SITE = "https://www.forum.example"


def _pick(by: Column, *forms) -> Column:
    """The form whose number is ``by`` modulo their count."""
    out = F.lit("")
    for i, form in enumerate(forms):
        out = F.when(by % len(forms) == i, form if isinstance(form, Column) else F.lit(form)).otherwise(out)
    return out


def _written(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def feed_pages(spark, sf_dir) -> DataFrame:
    """page_id, url, html."""
    n, text = F.col("o_orderkey"), F.col("o_orderpriority")
    name = _written('<a href="/user/', n.cast("string"), '/"><span>Clerk <b>', (n % 1000).cast("string"), "</b></span></a>")
    comment = _written(
        '<li><div role="article" aria-label="Comment by ', n.cast("string"), '"',
        F.when(n % 3 == 1, _written(' data-commentid="d', n.cast("string"), '"')).otherwise(""), ">",
        F.when(n % 2 == 0, _written('<a role="link" href="#"><svg><image xlink:href="https://pic.example/o', n.cast("string"),
                                    '.png"></image></svg></a>'))
        .otherwise(_written('<img alt="profile picture of C" src="https://pic.example/o', n.cast("string"), '.jpg">')), name,
        _pick(n, _written('<div data-ad-preview="message"><span>', text, " &amp; ", n.cast("string"), "</span></div>"),
              _written('<div dir="auto" style="text-align: start;">', text, "</div>"),
              _written('<div class="xtq9sad a xmjcpbm">Clerk</div><div><p>x</p><span dir="auto">instead ', n.cast("string"),
                       "</span></div><div>other</div>"), ""),
        F.when(n % 3 == 0, _written(f'<a href="{_SITE}/groups/g/posts/1/?comment_id=', n.cast("string"), '&amp;r=1">link</a>'))
        .otherwise(""),
        _pick(n, '<abbr title="3 days ago">3d</abbr>',
              '<a href="#c" aria-label="Comment permalink"><i>2 hrs</i></a>', "", '<abbr title="someday">?</abbr>', ""),
        "</div></li>")
    comments = (B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), n.alias("n"), comment.alias("c"))
                .groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "c"))),
                                                           lambda x: x["c"]), "").alias("comments")))
    k = F.col("c_custkey")
    at = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), k.cast("int"))
    said = _pick(k, _written('<abbr title="', F.date_format(at, "MMMM d, yyyy 'at' h:mm a"), '">some time</abbr>'),
                 _written(f'<a href="{_SITE}/groups/g/posts/9/"><span data-lexical-text="true">', (k % 20 + 1).cast("string"),
                          " hrs ago</span></a>"),
                 _written(f'<a href="{_SITE}/photos/1" title="no time" aria-label="Photo of a page">Yesterday at 5:00 PM</a>'
                          f'<a href="{_SITE}/photos/2">2 hrs ago</a>'), "")
    image = _pick(k, _written('<img class="a x168nmei" src="https://img.example/', k.cast("string"), '.jpg">'),
                  _written('<div style="color: red; background-image: url(&quot;https://img.example/b', k.cast("string"),
                           '.jpg&quot;)"></div>'), "")
    page = _written(
        '<html><body><div id="top"><div role="article"><div><svg><image xlink:href="https://pic.example/', k.cast("string"),
        '.png"></image></svg></div><h2><a role="link" href="#"><strong>', F.col("c_name"), "</strong></a></h2>", said,
        '<div data-ad-preview="message"><div>Segment <b>', F.col("c_mktsegment"), "</b></div>",
        '<div><div role="button">See more</div></div><div>balance &lt;', F.col("c_acctbal").cast("decimal(12,2)").cast("string"),
        "&gt;</div></div>", image, "<ul>", F.coalesce("comments", F.lit("")), "</ul></div></div></body></html>")
    url = _pick(k, _written(f"{_SITE}/groups/g/posts/", k.cast("string"), "/?ref=x#top"),
                _written(f"{_SITE}/watch/?v=v", k.cast("string")), _written("https://other.test/x/", k.cast("string")))
    # the comments of a page are long: a plan's estimate of them is far too low for a broadcast
    rows = B.table(spark, sf_dir, "customer").join(comments.hint("merge"), F.col("k") == k, "left")
    return rows.select(k.alias("page_id"), url.alias("url"), page.alias("html"))


def _records(spark, sf_dir) -> DataFrame:
    return extract.extract_pages(feed_pages(spark, sf_dir), HOST, base_ts=F.lit(SCRAPE_TS).cast("timestamp_ntz"),
                                 rules=schemas.FEED_RULES)


_POSTS = f"""
WITH t AS (
  SELECT *, c_custkey AS k, 'Segment ' || c_mktsegment || chr(10) || 'balance <' || CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR)
           || '>' AS content_text, TIMESTAMP '2024-01-01' + INTERVAL (c_custkey) MINUTE AS moment FROM customer),
-- the first time element of a page is its own, else that of a comment
own AS (SELECT o_custkey, arg_min(CASE o_orderkey % 5 WHEN 0 THEN '3 days ago' ELSE 'someday' END, o_orderkey) AS title
        FROM orders WHERE o_orderkey % 5 IN (0, 3) GROUP BY o_custkey),
s AS (
  SELECT t.*, o_custkey IS NOT NULL AS marked, k IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 1) AS linked,
    CASE WHEN k % 4 = 0 THEN strftime(moment, '%B %-d, %Y at %-I:%M %p') WHEN title IS NOT NULL THEN title
         WHEN k % 4 = 1 THEN (k % 20 + 1) || ' hrs ago' END AS direct
  FROM t LEFT JOIN own ON k = o_custkey),
p AS (
  SELECT k AS page_id,
    CASE k % 3 WHEN 0 THEN '{_SITE}/groups/g/posts/' || k || '/' WHEN 1 THEN '{_SITE}/watch/' END AS post_url,
    CASE k % 3 WHEN 0 THEN CAST(k AS VARCHAR) WHEN 1 THEN 'v' || k
      ELSE 'generated_' || substr(sha256(c_name || '|' || content_text || '|' || coalesce(direct, '')), 1, 12) END AS external_post_id,
    c_name AS post_author_name, 'https://pic.example/' || k || '.png' AS post_author_profile_pic_url, content_text,
    CASE k % 3 WHEN 0 THEN 'https://img.example/' || k || '.jpg' WHEN 1 THEN 'https://img.example/b' || k || '.jpg' END
      AS post_image_url,
    -- without one, the links of the page and its comments are tried in order
    CASE WHEN direct IS NOT NULL THEN direct WHEN k % 4 = 2 THEN 'Yesterday at 5:00 PM' WHEN linked THEN '2 hrs' END AS time_text,
    CASE WHEN k % 4 = 0 THEN moment WHEN direct = '3 days ago' THEN TIMESTAMP '{SCRAPE_TS}' - INTERVAL 3 DAY
         WHEN direct = 'someday' THEN NULL WHEN k % 4 = 1 THEN TIMESTAMP '{SCRAPE_TS}' - INTERVAL (k % 20 + 1) HOUR
         WHEN k % 4 = 2 THEN TIMESTAMP '2024-01-31 17:00:00' WHEN linked THEN TIMESTAMP '{SCRAPE_TS}' - INTERVAL 2 HOUR END
      AS posted_at
  FROM s
  -- off the site a page counts only with a time marker: its own, or that of a comment
  WHERE k % 3 <> 2 OR k % 4 < 2 OR marked)"""


@register("extract_feed_pages", _POSTS + """
SELECT * FROM p""")
def q_extract_feed_pages(spark, sf_dir):
    """E1-E5, E7, E9, F16, X2, X3, X5, X7 on feed elements, through the selectors of the feed's own format."""
    return _records(spark, sf_dir).select("page_id", "post_url", "external_post_id", "post_author_name",
                                          "post_author_profile_pic_url", "content_text", "post_image_url", "time_text",
                                          "posted_at")


@register("extract_feed_comments", _POSTS + f""",
c AS (
  SELECT p.page_id, p.external_post_id, o.o_orderkey AS n,
    CAST(row_number() OVER (PARTITION BY p.page_id ORDER BY o.o_orderkey) - 1 AS INTEGER) AS pos,
    'Clerk ' || (o.o_orderkey % 1000) AS commenter_name,
    'https://pic.example/o' || o.o_orderkey || CASE WHEN o.o_orderkey % 2 = 0 THEN '.png' ELSE '.jpg' END
      AS commenter_profile_pic_url,
    CASE o.o_orderkey % 4 WHEN 0 THEN o.o_orderpriority || ' & ' || o.o_orderkey WHEN 1 THEN o.o_orderpriority
                          WHEN 2 THEN 'instead ' || o.o_orderkey END AS comment_text,
    CASE o.o_orderkey % 5 WHEN 0 THEN '3 days ago' WHEN 1 THEN 'Comment permalink' WHEN 3 THEN 'someday' END AS time_text
  FROM p JOIN orders o ON p.page_id = o.o_custkey)
SELECT page_id, external_post_id, pos, commenter_name, commenter_profile_pic_url, comment_text,
  CASE n % 3 WHEN 0 THEN CAST(n AS VARCHAR) WHEN 1 THEN 'd' || n
    ELSE 'bs_fallback_' || substr(sha256(commenter_name || '|' || coalesce(comment_text, '') || '|' || coalesce(time_text, '')
                                         || '|' || external_post_id), 1, 12) END AS external_comment_id,
  CASE WHEN n % 5 = 0 THEN TIMESTAMP '{SCRAPE_TS}' - INTERVAL 3 DAY END AS commented_at
FROM c""")
def q_extract_feed_comments(spark, sf_dir):
    """All three sources of a comment's id, its time and its text."""
    return extract.explode_comments(_records(spark, sf_dir)).select(
        "page_id", "external_post_id", "pos", "commenter_name", "commenter_profile_pic_url", "comment_text",
        "external_comment_id", "commented_at")
