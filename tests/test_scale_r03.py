"""Plans and layouts that the findings of round 3 were about: nothing whole on one machine, work dealt over all tasks."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from agora import schemas
from agora.functions import html
from agora.operators import annotate, extract, ledger
from agora.plans import catalog_feed
from agora.session import scratch_path
from agora.sources.parts import IdTable
from tests.conftest import SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_are_dealt_over_more_tasks_than_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    pages = spark.range(0, 100, 1, cores).groupBy("id").count()
    assert extract.spread(pages).rdd.getNumPartitions() == extract.TASKS * cores


def test_no_job_runs_while_the_feed_is_planned(spark):
    group = "planning the feed"
    spark.sparkContext.setJobGroup(group, group)
    try:
        catalog_feed.feed_pages(spark, SMALL)  # file schemas may need a job
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        pages = spark.range(0, 20, 1, 2).groupBy("id").count().select(
            F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("<p>x</p>").alias("html"))
        extract.extract_pages(pages, "forum.example", rules=schemas.FEED_RULES)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == before
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_selectors_are_tried_only_where_their_attributes_are():
    matcher = html.Matcher()
    linked, named, bare = (matcher.add(s)[0] for s in ('a[href*="x"]', 'a:not([href])', 'a'))
    root = html.parse('<a href="x">1</a><a HREF="y">2</a><a name="n">3</a>')
    found = matcher.walk(root)
    assert [[n.text() for n in found.every([i], root)] for i in (linked, named, bare)] == [["1"], ["3"], ["1", "2", "3"]]
    later = matcher.add('a[name]')[0]  # a selector added after a walk
    found = matcher.walk(root)
    assert [n.text() for n in found.every([later], root)] == ["3"]


def test_pages_cross_python_in_small_frames(monkeypatch):
    import pandas as pd
    monkeypatch.setattr(extract, "PAGES", 3)
    whole = pd.DataFrame({"page_id": range(8), "url": ["u"] * 8, "html": ["<h1>t</h1>"] * 8})
    rules = {**extract.DEFAULT_RULES, **schemas.FEED_RULES}
    out = list(extract._rules_fn(rules, extract.ALL_FIELDS)([whole, whole[:0]]))
    assert [len(f) for f in out] == [3, 3, 2] and list(pd.concat(out)["page_id"]) == list(range(8))


def test_comments_of_a_page_are_not_broadcast(spark):
    assert "BroadcastHashJoin" not in _plan(catalog_feed.feed_pages(spark, SMALL))


def test_small_parts_share_folders(spark):
    rows = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])
    table = IdTable(spark, scratch_path(spark, "t"), rows, "id", span=10, rows=500)
    table.append(spark.range(-20, 2000).select("id", F.lit("a").alias("v")).unionByName(
        spark.createDataFrame([(None, "n")], rows)))
    assert len(table.manifest()["parts"]) == 203
    assert len({e[0] for es in table.manifest()["parts"].values() for e in es}) == 6
    table.append(spark.createDataFrame([(1999, "second")], rows))  # a part in two folders
    table.update(spark.createDataFrame([(-20, "b"), (499, "b"), (1995, "b")], rows))
    table.update(spark.createDataFrame([(499, "c"), (500, "c")], rows))
    table.remove(spark.range(20, 40))
    got = sorted((tuple(r) for r in table.read().collect()), key=str)
    new = {-20: "b", 499: "c", 500: "c", 1995: "b"}
    assert got == sorted([(i, new.get(i, "a")) for i in range(-20, 2000) if not 20 <= i < 40]
                         + [(None, "n"), (1999, "second")], key=str)


def test_ledger_tasks_do_not_grow_with_the_prompts(spark, monkeypatch):
    prompts = spark.range(400).select(F.col("id").cast("string").alias("batch_id"), F.lit(1).cast("long").alias("n_items"),
                                      F.lit("s").alias("system"), F.concat(F.lit("Posts:\n"), F.col("id")).alias("user"))
    monkeypatch.setattr(ledger, "TASKS", 2)
    path = scratch_path(spark, "ledger")
    assert ledger.annotate_with_ledger(prompts, path, "offline").where("answer IS NOT NULL").count() == 400
    files = len(spark.read.parquet(path).inputFiles())
    assert files <= 2 * spark.sparkContext.defaultParallelism


def test_prompts_cross_python_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(annotate, "CALL_PROMPTS", 5)
    name, most = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    checkpoint = annotate.cut_lineage
    monkeypatch.setattr(annotate, "cut_lineage", lambda df: most.append(spark.conf.get(name)) or checkpoint(df))
    before = spark.conf.get(name)
    prompts = spark.range(40).select(F.col("id").cast("string").alias("batch_id"), F.lit(1).alias("n_items"),
                                     F.lit("s").alias("system"), F.lit("Posts:\n").alias("user"))
    assert annotate.annotate_prompts(prompts, concurrency=1).where("answer IS NOT NULL").count() == 40
    assert most == ["5"] and spark.conf.get(name) == before
