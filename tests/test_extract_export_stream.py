"""Extraction on literal pages (E*), export shaping and sinks (P3 P4 U1 SNK*),
and streaming = batch (ST1-ST4)."""

import csv
import glob
import json

from pyspark.sql import functions as F

from agora import schemas
from agora.operators import export, extract
from agora.session import scratch_path
from agora.sources import sinks
from agora.sources.bindings import conform
from agora.streaming import ingest_stream as S

PAGE = """<html><head><title>T</title></head><body>
<div role="article">
  <h2><strong>Ann &amp; Co</strong></h2><svg><image href="https://pic/ann.png"/></svg>
  <a href="https://www.forum.example/groups/g/posts/123/?ref=x"><abbr title="2 hrs ago">2h</abbr></a>
  <div data-ad-preview="message"><div>First line</div><div><div role="button">See more</div></div><div>Second  line</div></div>
  <img src="https://img/1.jpg">
  <ul>
    <li data-commentid="c1"><a href="/user/bob">Bob</a> <span dir="auto">Great idea</span>
        <abbr title="Yesterday at 5:00 PM">1d</abbr></li>
    <li><a href="/x?comment_id=77">Cy</a></li>
    <li><span></span></li>
  </ul>
</div></body></html>"""


def test_extract_literal_page(spark):
    pages = spark.createDataFrame(
        [(1, "https://www.forum.example/groups/g/posts/123/?ref=x", PAGE),
         (2, "https://elsewhere.org/a", "<p>no marker</p>")], "page_id long, url string, html string")
    base = F.lit("2024-03-10 12:00:00").cast("timestamp_ntz")
    posts = extract.extract_pages(pages, "forum.example", base_ts=base,
                                  rules={"text_container": ["div[data-ad-preview=message]"]})
    rows = posts.collect()
    assert len(rows) == 1                                                  # F14/F16
    r = rows[0]
    assert r["post_url"] == "https://www.forum.example/groups/g/posts/123/"
    assert r["external_post_id"] == "123"
    assert r["post_author_name"] == "Ann & Co"
    assert r["post_author_profile_pic_url"] == "https://pic/ann.png"
    assert r["content_text"] == "First line\nSecond  line"                 # button block skipped
    assert r["post_image_url"] == "https://img/1.jpg"
    assert str(r["posted_at"]) == "2024-03-10 10:00:00"
    assert len(r["comments"]) == 2                                         # F15 drops the empty li
    flat = {c["commenter_name"]: c for c in extract.explode_comments(posts).collect()}
    assert flat["Bob"]["external_comment_id"] == "c1"
    assert flat["Bob"]["comment_text"] == "Great idea"
    assert str(flat["Bob"]["commented_at"]) == "2024-03-09 17:00:00"
    assert flat["Cy"]["external_comment_id"] == "77"


def test_time_candidates(spark):
    page = """<div role="article"><h2><strong>Ann</strong></h2>
      <a href="/groups/g/posts/9" aria-label="Ann">Ann</a>
      <a aria-label="Comments">12 comments</a>
      <a href="/groups/g/posts/9" title="see">Ann</a>
      <a href="/groups/g/posts/9">March 3 at 5:00 PM</a><p>text</p></div>"""
    pages = spark.createDataFrame([(1, "https://www.forum.example/groups/g/posts/9", page)],
                                  "page_id long, url string, html string")
    base = F.lit("2024-03-10 12:00:00").cast("timestamp_ntz")
    r = extract.extract_pages(pages, "forum.example", base_ts=base).first()
    assert r["time_text"] == "March 3 at 5:00 PM"
    assert str(r["posted_at"]) == "2024-03-03 17:00:00"


def test_field_selection(spark):
    pages = spark.createDataFrame([(1, "https://www.forum.example/groups/g/posts/5", PAGE)],
                                  "page_id long, url string, html string")
    posts = extract.extract_pages(pages, "forum.example", fields=("post_author_name",),
                                  rules={"text_container": ["div[data-ad-preview=message]"]})
    assert "content_text" not in posts.columns and posts.first()["post_author_name"] == "Ann & Co"


def test_output_paths():
    p = sinks.output_paths("/out/dir/", "csv")
    assert p["combined"] == "/out/dir/fbdata_all.csv" and p["posts"] == "/out/dir/fbdata_posts.csv"
    p = sinks.output_paths("/out/report.json", "json")
    assert p["comments"] == "/out/report_comments.json"


def test_normalize_order(spark):
    df = spark.createDataFrame([(1, "u", "x", "z")], "zeta long, post_url string, alpha string, "
                                                      "post_author_name string")
    assert export.normalize(df, "posts").columns == [
        "post_url", "post_author_name", "post_content_raw", "posted_at", "ai_category",
        "alpha", "zeta"]


def test_csv_json_sinks_roundtrip(spark):
    posts = conform(spark.createDataFrame(
        [(1, 1, 'He said "hi", then\nleft', "Zoë", ["a", "b"], True)],
        "internal_post_id long, group_id long, post_content_raw string, post_author_name string, "
        "ai_keywords array<string>, is_processed_by_ai boolean"), schemas.POSTS)
    empty_comments = conform(spark.createDataFrame([], "comment_id long, internal_post_id long, "
                                                       "is_processed_by_ai_comment boolean"),
                             schemas.COMMENTS)
    data = {"posts": posts, "comments": empty_comments, "groups": None, "combined": None}
    base = scratch_path(spark, "t-export") + "/"
    written = sinks.export(data, base, "csv", spark)
    assert set(written) == {"posts"}                                       # SNK4: empty skipped
    files = glob.glob(written["posts"].replace("file:", "") + "/*.csv")
    rows = [r for f in files for r in csv.DictReader(open(f, encoding="utf-8", newline=""))]
    assert rows[0]["post_content_raw"] == 'He said "hi", then\nleft'
    assert rows[0]["post_author_name"] == "Zoë" and rows[0]["ai_keywords"] == '["a","b"]'
    assert rows[0]["ai_summary"] == ""                                      # NULL -> empty
    written = sinks.export(data, scratch_path(spark, "t-export") + "/", "json", spark)
    files = glob.glob(written["posts"].replace("file:", "") + "/*.json")
    lines = [ln for f in files for ln in open(f, encoding="utf-8") if ln.strip()]
    assert len(lines) == 1
    rec = json.loads(lines[0])
    assert rec["post_author_name"] == "Zoë" and rec["ai_summary"] is None


def test_stream_equals_batch(spark):
    from tests.conftest import SMALL
    ev = spark.read.parquet(f"{SMALL}/events.parquet")
    landing = scratch_path(spark, "t-landing")
    S.land_files(ev, landing, n_files=3, copies=2)
    store = scratch_path(spark, "t-store")

    def prep(df):
        return df.select(F.col("event_id").cast("string").alias("ext"), "user_id",
                         F.struct("ts", "event_id").alias("ordinal"))
    metrics = []
    info = S.run_ingest_stream(spark, landing, ev.schema, store, scratch_path(spark, "t-ckpt"),
                               prep, S.one_key_sink(store, ["ext"], "ordinal", metrics),
                               max_files_per_trigger=2)
    assert info["batches"] >= 3                                            # rounds bounded
    assert sum(m["inserted"] for m in metrics) == ev.count()               # A10 counters
    assert info["input_rows"] == 2 * ev.count()
    got = sorted(r["ext"] for r in spark.read.parquet(store).collect())
    assert got == sorted(str(r["event_id"]) for r in ev.collect())          # each once
    # a second run with nothing new lands nothing new (availableNow, ST4)
    S.run_ingest_stream(spark, landing, ev.schema, store, scratch_path(spark, "t-ckpt2"),
                        prep, S.one_key_sink(store, ["ext"], "ordinal"))
    assert spark.read.parquet(store).count() == len(got)


def test_typed_read(spark):
    df = spark.createDataFrame([('["a","b"]', 1, 0), ('"[\\"x\\"]"', 0, 1), ("not json", None, 1)],
                               "ai_keywords string, ai_is_potential_idea int, is_processed_by_ai int")
    rows = sinks.typed_read(df).collect()
    assert [r["ai_keywords"] for r in rows] == [["a", "b"], ["x"], []]
    assert [r["ai_is_potential_idea"] for r in rows] == [True, False, None]
    assert [r["is_processed_by_ai"] for r in rows] == [False, True, True]


def test_bootstrap_tables(spark):
    root = scratch_path(spark, "t-store-tables")
    assert not sinks.tables_present(spark, root)
    sinks.bootstrap(spark, root)
    assert sinks.tables_present(spark, root)
    got = sinks.read_table(spark, root, "posts").schema
    assert [(f.name, f.dataType) for f in got] == [(f.name, f.dataType) for f in schemas.POSTS]


def test_snapshot_update_cycle(spark):                                  # M3 via snapshots
    from agora.operators import annotate as AN
    root = scratch_path(spark, "t-snap-store")
    posts = conform(spark.createDataFrame(
        [(1, 1, "x" * 50, False), (2, 1, "y" * 900, False)],
        "internal_post_id long, group_id long, post_content_raw string, "
        "is_processed_by_ai boolean"), schemas.POSTS)
    first = sinks.write_snapshot(posts, root, "posts")
    assert sinks.current_snapshot(spark, root, "posts") == first
    current = sinks.read_current(spark, root, "posts")
    run = AN.annotate_posts(current, "offline", max_tokens=10_000,
                            run_ts=F.lit("2024-01-01 00:00:00"))
    second = sinks.write_snapshot(run["posts"], root, "posts")        # never over `first`
    assert second != first and sinks.current_snapshot(spark, root, "posts") == second
    after = {r["internal_post_id"]: r for r in sinks.read_current(spark, root, "posts").collect()}
    assert after[1]["is_processed_by_ai"] and after[2]["is_processed_by_ai"]
    assert spark.read.parquet(first).filter("is_processed_by_ai").count() == 0
    assert sinks.read_current(spark, root, "comments").count() == 0


def test_bounded_stream_dedup(spark):                                   # ST2 bounded state
    from tests.conftest import SMALL
    ev = spark.read.parquet(f"{SMALL}/events.parquet")
    landing = scratch_path(spark, "t-landing-wm")
    S.land_files(ev, landing, n_files=2, copies=2)
    out = scratch_path(spark, "t-out-wm")
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    q = (S.dedup_within_watermark(stream, ["event_id"], "ts", "400 days")
         .writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", scratch_path(spark, "t-ckpt-wm"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == ev.count() and got.select("event_id").distinct().count() == ev.count()
