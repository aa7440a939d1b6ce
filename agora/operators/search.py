"""Post search, comment threads and point lookups.

``search_posts`` answers the source application's search: annotated posts,
optionally narrowed by group, an allow-listed field, category, date range,
post author, comment author, keyword (post text or any comment), comment-count
bounds and the idea flag, newest first, with an optional limit.

Plan shape: ONE aggregation over the comments (partial aggregation before the
shuffle) yields, per post, the total comment count and the existence flags the
comment predicates need; it is left-joined once to the filtered posts. The
post predicates are pushed into the posts scan by Catalyst. For selective
searches a size-checked broadcast of the matching post ids filters the comments
before that aggregation. No per-post loop, no second pass over the comments,
no join fan-out.
"""

from __future__ import annotations

import datetime as _dt
import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora import schemas
from agora.functions.text import ilike_contains

log = logging.getLogger(__name__)

def _present(v) -> bool:
    """a search argument counts when it is neither None nor empty; blanks are a
    value like any other (they match texts that hold them)."""
    return v is not None and v != ""


def parse_day(value: str) -> _dt.date:
    """Parse a ``YYYY-MM-DD`` day; single-digit month/day are accepted."""
    return _dt.datetime.strptime(value.strip(), "%Y-%m-%d").date()


def _ts_lit(d: _dt.date) -> Column:
    # A folded literal of the column's type, so the bound reaches the parquet scan.
    return F.lit(d.strftime("%Y-%m-%d 00:00:00")).cast("timestamp_ntz")


def field_equals(field: str | None, value) -> Column | None:
    """equality on an allow-listed field; unknown field -> warned, ignored."""
    if not field or value is None:
        return None
    if field not in schemas.ALLOWED_FILTER_FIELDS:
        log.warning("field %s is not allowed for filtering", field)
        return None
    if field == "ai_is_potential_idea":
        try:
            iv = int(value)
        except (TypeError, ValueError):
            log.warning("invalid value for boolean field %s: %r", field, value)
            return None
        if iv not in (0, 1):
            return F.lit(False)
        return F.col(field) == F.lit(bool(iv))
    return F.col(field) == F.lit(value)


def post_predicates(*, group_id=None, filter_field=None, filter_value=None, category=None,
                    start_date=None, end_date=None, end_exclusive=False, post_author=None,
                    is_idea=False, only_processed=True) -> list[Column]:
    preds: list[Column] = []
    if only_processed:
        preds.append(F.col("is_processed_by_ai"))                              # F1
    if group_id is not None:
        preds.append(F.col("group_id") == F.lit(int(group_id)))                # F2
    fe = field_equals(filter_field, filter_value)                              # F3
    if fe is not None:
        preds.append(fe)
    if _present(category):
        preds.append(F.col("ai_category") == F.lit(category))                  # F11
    if _present(start_date):
        preds.append(F.col("posted_at") >= _ts_lit(parse_day(start_date)))    # F4
    if _present(end_date):                                                     # F5
        end = parse_day(end_date)
        bound = end if end_exclusive else end + _dt.timedelta(days=1)
        preds.append(F.col("posted_at") < _ts_lit(bound))
    if _present(post_author):
        preds.append(ilike_contains("post_author_name", post_author))          # F6
    if is_idea:
        preds.append(F.col("ai_is_potential_idea"))                            # F10
    return preds


def comment_activity(comments: DataFrame, *, comment_author=None, keyword=None) -> DataFrame:
    """Per post: total comment count (J1) and the existence flags of F7/F8.

    All flags come from the same rows in the same aggregate, so
    "one comment matches the author AND the keyword" (Q6) is exact.
    """
    aggs = [F.count(F.lit(1)).alias("comment_count")]
    author = ilike_contains("commenter_name", comment_author) if _present(comment_author) else None
    kw = ilike_contains("comment_text", keyword) if _present(keyword) else None
    if author is not None:
        aggs.append(F.bool_or(F.coalesce(author, F.lit(False))).alias("_any_author"))
    if kw is not None:
        aggs.append(F.bool_or(F.coalesce(kw, F.lit(False))).alias("_any_kw"))
    if author is not None and kw is not None:
        aggs.append(F.bool_or(F.coalesce(author & kw, F.lit(False))).alias("_any_author_kw"))
    return comments.groupBy("internal_post_id").agg(*aggs)


def search_posts(posts: DataFrame, comments: DataFrame, *, group_id=None, filter_field=None,
                 filter_value=None, category=None, start_date=None, end_date=None,
                 end_exclusive=False, post_author=None, comment_author=None, keyword=None,
                 min_comments=None, max_comments=None, is_idea=False, limit=None,
                 order=True, prefilter: bool | None = None) -> DataFrame:
    """Annotated posts matching every given filter, with ``comment_count``.

    Selective searches (a post predicate beyond F1; or as ``prefilter`` says) first filter the
    comments to the matching post ids with a semi-join: Spark broadcasts the ids
    where their measured size allows it and else splits a hot post's comments as a
    skewed join side. Otherwise all comments are aggregated, partially first.
    """
    preds = post_predicates(group_id=group_id, filter_field=filter_field,
                            filter_value=filter_value, category=category,
                            start_date=start_date, end_date=end_date,
                            end_exclusive=end_exclusive, post_author=post_author,
                            is_idea=is_idea)
    p = posts
    for pr in preds:
        p = p.filter(pr)

    if prefilter is None:
        prefilter = len(preds) > 1
    c = comments
    if prefilter:
        c = comments.join(p.select("internal_post_id"), "internal_post_id", "left_semi")
    act = comment_activity(c, comment_author=comment_author, keyword=keyword)
    j = p.join(act, "internal_post_id", "left").withColumn(
        "comment_count", F.coalesce(F.col("comment_count"), F.lit(0)).cast("bigint"))

    has_author, has_kw = _present(comment_author), _present(keyword)
    if has_kw:
        post_kw = F.coalesce(ilike_contains("post_content_raw", keyword), F.lit(False))
    if has_author and has_kw:
        # one comment: author matches AND (post text OR that comment's text matches)
        j = j.filter((post_kw & F.coalesce(F.col("_any_author"), F.lit(False)))
                     | F.coalesce(F.col("_any_author_kw"), F.lit(False)))
    elif has_author:
        j = j.filter(F.coalesce(F.col("_any_author"), F.lit(False)))
    elif has_kw:
        j = j.filter(post_kw | F.coalesce(F.col("_any_kw"), F.lit(False)))

    if min_comments is not None:                                               # F9
        j = j.filter(F.col("comment_count") >= F.lit(int(min_comments)))
    if max_comments is not None:
        j = j.filter(F.col("comment_count") <= F.lit(int(max_comments)))

    out = j.select(*posts.columns, "comment_count")
    if order or (limit and limit > 0):                                         # S1
        out = out.orderBy(F.col("posted_at").desc_nulls_last(), F.col("internal_post_id").asc())
    if limit and int(limit) > 0:                                               # S2
        out = out.limit(int(limit))
    return out


def typed_posts(posts: DataFrame) -> DataFrame:
    """P1 view for display: keywords joined by ', ', idea flag as Yes/No."""
    return posts.withColumn("keywords_text", F.array_join(F.col("ai_keywords"), ", ")) \
        .withColumn("idea_flag", F.when(F.col("ai_is_potential_idea"), "Yes").otherwise("No"))


def comments_of(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """J3 (flat): every comment of the selected posts, in one semi-join."""
    return comments.join(posts.select("internal_post_id"), "internal_post_id", "left_semi")


def post_threads(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """J3 + S3 + P5: each selected post with its comments, one row per comment.

    Posts without comments appear once with NULL comment columns. Rows are
    ordered by post, then comment scrape time, then comment id. The thread is
    kept flat: a post with millions of comments is never packed into one value.
    """
    p = typed_posts(posts).select(
        "internal_post_id", "post_author_name", "post_content_raw", "posted_at",
        "ai_category", "keywords_text", "idea_flag")
    c = comments.select("internal_post_id", "comment_id", "commenter_name", "comment_text",
                        "comment_scraped_at")
    # inner join (AQE can split a hot post on the comment side) + the posts without
    # comments (anti-join against the distinct commented ids: a partial aggregate)
    with_comments = p.join(c, "internal_post_id", "inner")
    commented = c.select("internal_post_id").distinct()
    bare = p.join(commented, "internal_post_id", "left_anti").select(
        *p.columns, *[F.lit(None).cast(t).alias(n) for n, t in c.dtypes if n != "internal_post_id"])
    return (with_comments.unionByName(bare)
            .orderBy("internal_post_id", F.col("comment_scraped_at").asc_nulls_last(),
                     "comment_id"))


def post_detail(posts: DataFrame, comments: DataFrame, post_id: int) -> DataFrame:
    """P5: one post and its ordered comments (the interactive view)."""
    return post_threads(posts.filter(F.col("internal_post_id") == F.lit(int(post_id))), comments)


def group_by(groups: DataFrame, *, group_id=None, name=None, url=None) -> DataFrame:
    """case-sensitive point lookup of a group by id, name or url."""
    g = groups
    if group_id is not None:
        g = g.filter(F.col("group_id") == F.lit(int(group_id)))
    if name is not None:
        g = g.filter(F.col("group_name") == F.lit(name))
    if url is not None:
        g = g.filter(F.col("group_url") == F.lit(url))
    return g


def list_groups(groups: DataFrame) -> DataFrame:
    """Groups by name."""
    return groups.orderBy("group_name", "group_id")
