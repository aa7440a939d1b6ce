"""The answer ledger (UDF1 UDF4), containment (J5), kept statistics (A1-A6), keyword postings."""

import glob
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from agora.operators import annotate as AN
from agora.operators import keyword_index, ledger, search, stats
from agora.operators.stats_store import StatisticsStore
from agora.session import scratch_path
from agora.sources import bindings as B
from agora.streaming import ingest_stream as S
from tests.conftest import SMALL


def calls_of(folder):
    out = {}
    for f in glob.glob(os.path.join(folder, "*")):
        name = os.path.basename(f).split("-")[0]
        out[name] = out.get(name, 0) + 1
    return out


@pytest.fixture
def prompts(spark):
    rows = [(f"b{i}", "sys", f"u{i % 30}", 1) for i in range(40)]  # ten prompts stand twice
    return spark.createDataFrame(rows, "batch_id string, system string, user string, n_items long")


def _register(calls, fatal=None, failing=()):
    """An annotator that leaves a file for each call, fails at some prompts, and takes its task down at one."""
    class Died(BaseException):
        """What no retry catches."""

    def call(system, user):
        if user == fatal:
            raise Died(user)
        with open(os.path.join(calls, f"{user}-{uuid.uuid4().hex}"), "w"):
            pass
        if user in failing:
            raise ValueError(user)
        return f"answer to {user}"

    AN.register_annotator("counting", lambda **kw: call)


def test_answered_prompts_are_not_sent_again(spark, prompts, tmp_path):
    path = scratch_path(spark, "ledger")
    _register(calls=str(tmp_path), failing=("u3", "u4"))
    first = ledger.annotate_with_ledger(prompts, path, "counting", run="1")
    got = {r["batch_id"]: (r["answer"], r["run"]) for r in first.collect()}
    assert len(got) == 40 and got["b3"] == (None, None) and got["b5"] == got["b35"] == ("answer to u5", "1")
    assert calls_of(tmp_path) == {f"u{i}": 1 for i in range(30)}
    _register(calls=str(tmp_path))
    second = ledger.annotate_with_ledger(prompts, path, "counting", run="2", concurrency=1, per_task=1)
    got = {r["batch_id"]: r["run"] for r in second.collect()}
    assert {b for b, run in got.items() if run == "2"} == {"b3", "b33", "b4", "b34"} and len(got) == 40
    assert calls_of(tmp_path) == {f"u{i}": 2 if i in (3, 4) else 1 for i in range(30)}


def test_a_lost_job_keeps_the_answers_of_finished_tasks(spark, prompts, tmp_path):
    path = scratch_path(spark, "ledger")
    _register(calls=str(tmp_path), fatal="u7")
    with pytest.raises(Exception):  # one task at a time, some before the one that dies
        ledger.annotate_with_ledger(prompts, path, "counting", run="1", per_task=1, concurrency=1)
    stored = {r["key"] for r in ledger.read_ledger(spark, path).collect()}
    before = calls_of(tmp_path)
    _register(calls=str(tmp_path))
    done = ledger.annotate_with_ledger(prompts, path, "counting", run="2", per_task=1)
    assert done.where("answer IS NULL").count() == 0
    again = [u for u, n in calls_of(tmp_path).items() if n > 1]
    assert stored and len(before) - len(again) == len(stored)   # only answers that were not stored yet
    assert all(n <= 2 for n in calls_of(tmp_path).values())
    assert {r["run"] for r in done.collect()} == {"1", "2"}


# ---------------------------------------------------------------- J5
def test_containment_is_the_first_post_that_holds_the_summary(spark):
    rng = random.Random(2)
    posts, summaries = [], []
    for b in ("x", "y"):
        texts = ["".join(rng.choices("ab é", k=rng.choice((0, 3, 50, 700)))) for _ in range(12)]
        texts += ["", texts[5], None]
        order = rng.sample(range(len(texts)), len(texts))
        posts += [(b, 100 + i, o, t) for i, (o, t) in enumerate(zip(order, texts))]
        for n, t in enumerate([t for t in texts if t]):
            at = rng.randrange(len(t))
            summaries.append((b, n, t[at:at + rng.choice((1, 4, 12, 13, 90))]))
        summaries += [(b, 90, "nowhere to be found"), (b, 91, ""), (b, 92, None), (b, 93, "a" * 800)]
    unmatched = spark.createDataFrame(summaries, "batch_id string, rpos int, summary string").select(
        "batch_id", "rpos", F.struct("summary").alias("r"))
    got = {(r["batch_id"], r["rpos"]): r["fb_pid"] for r in AN.containment_fallback(unmatched, spark.createDataFrame(
        posts, "batch_id string, pid long, ordinal long, content string")).collect()}
    want = {}
    for b, n, s in summaries:
        hits = sorted((o, pid) for pb, pid, o, t in posts if s and t and pb == b and s in t)
        if hits:
            want[b, n] = hits[0][1]
    assert got == want and len(want) >= 12


# ---------------------------------------------------------------- statistics
def _same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_kept_statistics_equal_a_scan(spark):
    posts, comments = B.posts_b1(spark, SMALL).cache(), B.comments_b1(spark, SMALL).cache()
    store = StatisticsStore(spark, scratch_path(spark, "s"), most=2)
    assert store.overview().first()["total_posts"] == 0
    for r in range(5):
        part = lambda df, key: df.where(F.pmod(F.col(key), F.lit(5)) == r)  # noqa: B023, E731
        for _ in range(2):  # a round may run again
            store.add_posts(part(posts, "internal_post_id"), r)
            store.add_comments(part(comments, "comment_id"), r)
    assert _same(store.overview(), stats.overview(posts, comments))
    assert _same(store.posts_per_category(), stats.posts_per_category(posts))
    assert _same(store.top_authors(7), stats.top_authors(posts, 7))
    old = posts.where("ai_category IS NULL").limit(3).cache()
    new = old.withColumn("ai_category", F.lit("seen")).withColumn("is_processed_by_ai", F.lit(True))
    store.change_posts(old, new, 5)
    now = posts.join(old.select("internal_post_id"), "internal_post_id", "left_anti").unionByName(new)
    assert _same(store.overview(), stats.overview(now, comments))
    assert _same(store.posts_per_category(), stats.posts_per_category(now))


# ---------------------------------------------------------------- postings
@pytest.fixture(scope="module")
def indexed(spark):
    posts, comments = B.posts_b1(spark, SMALL).cache(), B.comments_b1(spark, SMALL).cache()
    return keyword_index.build(posts, comments, scratch_path(spark, "grams")), posts, comments


@pytest.mark.parametrize("keyword", ["ring", "MACHINERY", "e", "r%g", "nowhere", "h or", "", None, "STEEL)"])
def test_indexed_search_is_the_search(indexed, keyword):
    path, posts, comments = indexed
    kw = dict(keyword=keyword, min_comments=1, order=False)
    want = search.search_posts(posts, comments, **kw)
    assert _same(keyword_index.search_posts(path, posts, comments, **kw), want)


def test_index_prunes_what_is_read(indexed, spark):
    path, posts, comments = indexed
    ids = keyword_index.candidates(spark, path, "machinery")
    plan = ids._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan and "PushedFilters: [In(gram" in plan
    assert 0 < ids.count() < posts.count()
    assert not keyword_index.usable("ab") and not keyword_index.usable("a_c") and keyword_index.usable("a\\b")


def test_postings_of_odd_texts(spark):
    low = "ärger über 漢字漢字 " * 40
    rows = spark.createDataFrame([(1, low.upper()), (2, "ab"), (3, None), (4, ""), (5, "abc")], "id long, t string")
    got = {(r["post_id"], r["gram"]) for r in keyword_index.postings(rows, "t", "id", None).collect()}
    assert got == {(1, low.upper().lower()[i:i + 3]) for i in range(len(low) - 2)} | {(5, "abc")}


def test_a_round_lands_in_as_many_files_as_it_has_partitions(spark, tmp_path):
    """One file a round was one task that held the whole round."""
    S.land_round(spark.range(1000).repartition(5), str(tmp_path))
    S.land_round(spark.range(10).repartition(2), str(tmp_path))
    assert len(glob.glob(f"{tmp_path}/part-*")) == 7 and spark.read.parquet(str(tmp_path)).count() == 1010
