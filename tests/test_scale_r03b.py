"""Findings F8 to F11 of FINDINGS_r03: what a page, a posting and an insert cost."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from agora import schemas
from agora.functions import html
from agora.operators import extract, ingest, keyword_index
from agora.session import scratch_path

PLAIN = ("<!DOCTYPE html><html><head><title>a &amp; b</title><style>p{}</style><script>var t='</p>';</script></head><body>"
         "<!-- ad --><p>one<p class=\"x y\" data-a='1'>two<br/>three<div id=k hidden><IMG SRC=\"i.png\"/>four</div></body></html>")
ODD = ["<p>a<b", "a < b<p>c", "<div a = \"x\">t</div>", "<a href=/x/>l</a>", "<a href=\"x\"title='y'>l</a>", "<p>x</ p>y", "<!-- a -- b -->c",
       "<script>a</scripty>b</script>c", "<script>a<b", "<style>x</STYLE >y", "<?php x ?>z", "a &amp b &#65", "<title>a<b>c</title>",
       "<textarea><b></textarea>x", "<li/>x<p/>y", "<x:y a>z</x:y>", "</p>x</>y", "<div a b=\"c\" a='d'>e", "<![CDATA[x]]>y", "<div\xa0a>x"]


def _tree(node):
    return [c if isinstance(c, str) else (c.tag, c.attrs, _tree(c)) for c in node.children]


def test_plain_pages_do_not_pass_through_the_stdlib_parser(monkeypatch):
    monkeypatch.setattr(html.HTMLParser, "feed", lambda *_: pytest.fail("not a plain page"))
    page = _tree(html.parse(PLAIN))
    assert page[0][0] == "html" and [c[0] for c in page[0][2]] == ["head", "body"]


@pytest.mark.parametrize("page", [PLAIN, "", *ODD, *[PLAIN[:40] + o + PLAIN[40:] for o in ODD]])
def test_every_page_has_the_tree_of_the_stdlib_parser(page):
    whole = html._Builder()
    whole.feed(page)
    whole.close()
    tags = {}
    assert _tree(html.parse(page, tags)) == _tree(whole.root) == _tree(html.parse(page, tags))


def test_tags_that_a_task_remembers_are_bounded(monkeypatch):
    monkeypatch.setattr(html, "TAGS", 10)
    matcher, tags = html.Matcher(), {}
    wanted = matcher.add("a[href$='7']")
    root = html.parse("".join(f'<a href="{i}">x</a>' for i in range(100)) + f'<a href="{"y" * 300}7">x</a>', tags)
    assert len(matcher.walk(root).every(wanted, root)) == 11
    assert len(tags) <= 10 and len(matcher.by_source) <= 10


def test_records_leave_a_task_in_columns():
    import pyarrow as pa
    pages = pa.RecordBatch.from_pydict({"page_id": [1, 2], "url": ["u", None], "html": ["<h1>t</h1><ul><li>c</li></ul>", None]})
    out, = extract._arrow_fn(schemas.ARTICLE_RULES, extract.ALL_FIELDS)([pages])
    assert [c and c[0]["comment_text"] for c in out.column("comments").to_pylist()] == ["c", []]
    assert out.column("author_name").to_pylist() == ["t", None] and out.column("url").to_pylist() == ["u", None]


def test_postings_of_a_batch_share_a_stored_row(spark):
    posts = spark.range(0, 300, 1, 1).select(F.col("id").alias("internal_post_id"), F.lit("Ring of steel").alias("post_content_raw"))
    comments = posts.select("internal_post_id", (F.col("internal_post_id") * 10).alias("comment_id"),
                            F.concat(F.lit("ring "), "internal_post_id").alias("comment_text"))
    path = keyword_index.build(posts, comments, scratch_path(spark, "grams"))
    postings = 300 * len("Ring of steel") - 300 * 2 + sum(len(f"ring {i}") - 2 for i in range(300))
    assert spark.read.parquet(path).count() < postings / 4
    assert keyword_index.candidates(spark, path, "RING").count() == 300
    assert [r[0] for r in keyword_index.candidates(spark, path, "ring 123").collect()] == [123]


def test_postings_of_long_texts_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(keyword_index, "PIECE", 50)
    monkeypatch.setattr(keyword_index, "LETTERS", 30)
    texts = ["".join(chr(97 + (i * i + i // 7) % 26) for i in range(n)) for n in (50, 51, 52, 99, 100, 101, 102, 400)]
    texts += ["\U0001f600\U0001f601\U0001f602", "a\x00b", "".join(chr(0x4e00 + i) for i in range(300))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {(r["post_id"], r["gram"]) for r in keyword_index.postings(rows, "t", "id", None).collect()}
    assert got == {(k, t[i:i + 3]) for k, t in enumerate(texts) for i in range(len(t) - 2)}


def test_rows_of_a_unique_ordinal_are_not_numbered_again(spark, monkeypatch):
    rows = spark.createDataFrame([(i * 3, i * 7 % 5 if i % 6 else None, i * 11 % 8 if i % 7 else None) for i in range(60)],
                                 "o long, a long, b long")
    stored = spark.createDataFrame([(900, 1, 3)], "o long, a long, b long")
    for before in (None, stored):
        want = [sorted(map(str, d.collect())) for d in ingest.insert_two_keys(before, rows, ["a"], ["b"], "o")[:2]]
        with monkeypatch.context() as m:
            m.setattr(ingest, "with_ordinal", lambda *_: pytest.fail("sorted again"))
            got = ingest.insert_two_keys(before, rows, ["a"], ["b"], "o", unique=True)[:2]
        assert [sorted(map(str, d.collect())) for d in got] == want


RECORD = ("page_id long, post_url string, external_post_id string, scraped_at timestamp_ntz, post_author_profile_pic_url string, "
          "post_author_name string, content_text string, post_image_url string, time_text string, posted_at timestamp_ntz, "
          "comments array<struct<pos:int,commenter_profile_pic_url:string,commenter_name:string,comment_text:string,href:string,"
          "data_comment_id:string,time_text:string>>")


def _records(spark, rows):
    """(page, url, id, ids of comments) -> records"""
    return spark.createDataFrame([(p, u, e, None, None, "a", f"text {p}", None, None, None,
                                   [(i, None, "c", "t", None, c, None) for i, c in enumerate(cs)]) for p, u, e, cs in rows], RECORD)


def test_whole_records_are_stored_once_and_a_rescrape_writes_none(spark, monkeypatch):
    cut, landed = ingest.cut_lineage, {}

    def narrow(df):
        assert not {"content_text", "comments", "comment_text", "post_content_raw"} & set(df.columns), "whole rows are checkpointed"
        return cut(df)

    def land(df, name, land=ingest.landed):
        out = land(df, name)
        landed.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(ingest, "cut_lineage", narrow)
    monkeypatch.setattr(ingest, "landed", land)
    rows = [(7, "u7", "e7", ["k", "m"]), (2, "u2", "e2", ["k", "l"]), (5, "u2", "e5", ["n"]), (9, "u9", "e2", []), (3, None, None, ["x"]),
            (4, "u4", None, ["p"]), (8, "u8", "e8", [])]
    posts, comments = spark.createDataFrame([], schemas.POSTS), spark.createDataFrame([], schemas.COMMENTS)
    for shift in (0, 100):
        again = [(p + shift, u, e, cs) for p, u, e, cs in rows if u or not shift]  # a record without a key never meets a stored one
        run = ingest.ingest_records(posts, comments, _records(spark, again), group_id=1)
        posts, comments = run["posts"], run["comments"]
        assert sorted((r["internal_post_id"], r["post_content_raw"]) for r in posts.collect()) == [
            (1, "text 2"), (2, "text 3"), (3, "text 4"), (4, "text 7"), (5, "text 8")]
        assert sorted((r["comment_id"], r["internal_post_id"], r["external_comment_id"]) for r in comments.collect()) == [
            (1, 1, "k"), (2, 1, "l"), (3, 3, "p"), (4, 1, "n"), (5, 4, "m")]
        assert run["ignored_records"].count() == (6 if shift else 2)
        assert run["inserted_posts"].count() == (0 if shift else 5) and run["inserted_comments"].count() == (0 if shift else 5)
    assert landed["posts"] == [5, 0] and landed["comments"] == [5, 0]


def test_a_page_is_freed_without_the_collector():
    import gc
    reader = extract._Reader(schemas.ARTICLE_RULES, extract.ALL_FIELDS)
    nodes = lambda: sum(type(o) is html.Node for o in gc.get_objects())
    gc.collect()
    gc.disable()
    try:
        for page in (PLAIN, "<article><p>a<div><button>b</button></div><li>c</article>"):
            reader.one(page)
            reader.found, reader.matches = None, {}
            assert nodes() == 0
    finally:
        gc.enable()


def test_no_form_of_a_time_is_tried_where_there_is_no_text(spark):
    from agora.functions import timeparse
    parsed = timeparse.parse_time_text(F.col("t"), F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"))
    df = spark.createDataFrame([(None,), ("1 day ago",), ("",)], "t string").select("t", parsed.alias("ts"))
    assert [str(r["ts"]) for r in df.collect()] == ["None", "2024-01-01 00:00:00", "None"]
    assert "CASE WHEN isnotnull(t" in df._jdf.queryExecution().analyzed().toString()
