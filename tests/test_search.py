"""Literal-row tests of the search semantics."""

import datetime as dt

import pytest

from agora import schemas
from agora.operators import search, stats
from agora.sources.bindings import conform

D = dt.datetime


def posts_df(spark, rows):
    cols = ("internal_post_id long, group_id long, post_content_raw string, "
            "post_author_name string, posted_at timestamp_ntz, ai_category string, "
            "ai_is_potential_idea boolean, is_processed_by_ai boolean")
    return conform(spark.createDataFrame(rows, cols), schemas.POSTS)


def comments_df(spark, rows):
    cols = "comment_id long, internal_post_id long, commenter_name string, comment_text string"
    df = spark.createDataFrame(rows, cols)
    from pyspark.sql import functions as F
    return conform(df.withColumn("is_processed_by_ai_comment", F.lit(False)), schemas.COMMENTS)


@pytest.fixture(scope="module")
def store(spark):
    posts = posts_df(spark, [
        (1, 1, "Looking for a co-founder", "Ann Lee", D(2024, 1, 15, 0, 0), "Project Idea", True, True),
        (2, 1, "100% match_here", "Bob", D(2024, 1, 15, 23, 59, 59), "Other", False, True),
        (3, 2, "Café near me?", "Zoë", D(2024, 1, 16, 0, 0), "Question/Inquiry", False, True),
        (4, 2, "a\\b path", "ann", None, "Other", False, True),
        (5, 1, "not yet annotated", "Cy", D(2024, 1, 10), None, None, False),
        (6, 1, "keyword only in post: widget", "Dee", D(2024, 1, 14), "Other", False, True),
    ])
    comments = comments_df(spark, [
        (10, 1, "Carl", "nice idea"),
        (11, 1, "Dana", "I have a widget"),
        (12, 2, "Carl", "widget!"),
        (13, 3, "Eve", "où?"),
        (14, 3, "Eve", "again"),
        (15, 3, "Fay", "more"),
    ])
    return posts, comments


def ids(df):
    return sorted(r["internal_post_id"] for r in df.collect())


def test_only_annotated_and_counts(store):
    posts, comments = store
    out = {r["internal_post_id"]: r["comment_count"]
           for r in search.search_posts(posts, comments).collect()}
    assert out == {1: 2, 2: 1, 3: 3, 4: 0, 6: 0}                          # F1, J1 zero case


def test_end_date_includes_whole_day(store):                              # Q3
    posts, comments = store
    assert ids(search.search_posts(posts, comments, start_date="2024-01-15",
                                   end_date="2024-01-15")) == [1, 2]
    assert ids(search.search_posts(posts, comments, start_date="2024-01-15",
                                   end_date="2024-01-15", end_exclusive=True)) == []
    assert ids(search.search_posts(posts, comments, start_date="2024-1-16")) == [3]


def test_like_wildcards_and_case(store):                                   # Q5
    posts, comments = store
    assert ids(search.search_posts(posts, comments, keyword="100%")) == [2]
    assert ids(search.search_posts(posts, comments, keyword="match_")) == [2]
    assert ids(search.search_posts(posts, comments, keyword="a\\b")) == [4]
    assert ids(search.search_posts(posts, comments, post_author="ANN")) == [1, 4]
    assert ids(search.search_posts(posts, comments, keyword="CAFÉ")) == [3]
    assert ids(search.search_posts(posts, comments, keyword="o'")) == []


def test_keyword_in_post_or_any_comment(store):                            # F8
    posts, comments = store
    assert ids(search.search_posts(posts, comments, keyword="widget")) == [1, 2, 6]


def test_author_and_keyword_same_comment(store):                           # Q6
    posts, comments = store
    # post 1: Carl wrote "nice idea", Dana wrote the widget comment -> no match
    assert ids(search.search_posts(posts, comments, comment_author="carl",
                                   keyword="widget")) == [2]
    # post text matches and some comment matches the author -> match
    assert ids(search.search_posts(posts, comments, comment_author="dana",
                                   keyword="co-founder")) == [1]
    # a post without comments (6 mentions the widget) never matches an author filter
    assert ids(search.search_posts(posts, comments, comment_author="a",
                                   keyword="widget")) == [1, 2]


def test_count_is_over_all_comments(store):                                # Q7, F9
    posts, comments = store
    out = search.search_posts(posts, comments, comment_author="Fay", min_comments=3).collect()
    assert [(r["internal_post_id"], r["comment_count"]) for r in out] == [(3, 3)]
    assert ids(search.search_posts(posts, comments, max_comments=0)) == [4, 6]


def test_field_filter_allow_list(store):                                   # F3, Q2
    posts, comments = store
    assert ids(search.search_posts(posts, comments, filter_field="ai_is_potential_idea",
                                   filter_value="1")) == [1]
    assert ids(search.search_posts(posts, comments, filter_field="post_content_raw",
                                   filter_value="x")) == [1, 2, 3, 4, 6]
    assert ids(search.search_posts(posts, comments, filter_field="ai_is_potential_idea",
                                   filter_value="yes")) == [1, 2, 3, 4, 6]


def test_empty_arguments_are_ignored_blank_ones_apply(store):              # F19
    posts, comments = store
    assert ids(search.search_posts(posts, comments, keyword="", post_author="",
                                   category=None)) == [1, 2, 3, 4, 6]
    assert ids(search.search_posts(posts, comments, post_author="  ")) == []


def test_order_and_limit(store):                                           # S1, S2
    posts, comments = store
    out = [r["internal_post_id"] for r in search.search_posts(posts, comments).collect()]
    assert out == [3, 2, 1, 6, 4]                                          # NULL time last
    out = [r["internal_post_id"] for r in search.search_posts(posts, comments, limit=2).collect()]
    assert out == [3, 2]
    assert len(search.search_posts(posts, comments, limit=0).collect()) == 5


def test_category_filter(store):                                           # F11, Q1
    posts, comments = store
    assert ids(search.search_posts(posts, comments, category="Other")) == [2, 4, 6]


def test_threads_ordered(spark, store):                                    # J3, S3, P5
    posts, comments = store
    rows = search.post_detail(posts, comments, 3).collect()
    assert [r["comment_id"] for r in rows] == [13, 14, 15]
    assert rows[0]["idea_flag"] == "No"


def test_stats(store):                                                     # A1-A8
    posts, comments = store
    row = stats.overview(posts, comments).first()
    assert (row["total_posts"], row["unprocessed_posts"], row["total_comments"]) == (6, 1, 6)
    assert row["avg_comments_per_post"] == pytest.approx(2.0)              # Q8: 3 commented posts
    cats = [tuple(r) for r in stats.posts_per_category(posts).collect()]
    assert cats[0] == ("Other", 3) and (None, 1) in cats
    assert sorted(r["value"] for r in stats.distinct_values(posts, "ai_is_potential_idea")
                  .collect()) == ["0", "1"]
    assert stats.distinct_values(posts, "post_content_raw").count() == 0
    top = stats.top_authors(posts, 2).collect()
    assert len(top) == 2
    allst = stats.all_statistics(posts, comments)
    assert allst["overview"].collect() == [row]
    assert [tuple(r) for r in allst["posts_per_category"].collect()] == cats
    assert len(allst["top_authors"].collect()) <= 5
