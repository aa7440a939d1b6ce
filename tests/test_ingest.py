"""Table maintenance: two-key first-wins inserts against the sequential model,
one-key dedup, groups add / upsert / delete, FK quarantine, per-group cap."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests import models
from agora.operators import ingest

ROW = "ordinal long, k1 string, k2 string"


def kept(spark, rows, stored=None):
    df = spark.createDataFrame(rows, ROW)
    st_df = spark.createDataFrame(stored, "k1 string, k2 string") if stored else None
    ins, ign, _ = ingest.insert_two_keys(st_df, df, ["k1"], ["k2"], "ordinal")
    got = sorted(r[0] for r in ins.select("ordinal").collect())
    assert sorted(got + [r[0] for r in ign.select("ordinal").collect()]) == sorted(
        r[0] for r in rows)
    return got


def test_chain(spark):
    # a(id1,url1) b(id1,url2) c(id3,url2): a and c stay (b is rejected by a,
    # so it must not block c through url2)
    assert kept(spark, [(1, "id1", "url1"), (2, "id1", "url2"), (3, "id3", "url2")]) == [1, 3]


def test_nulls_never_collide(spark):
    rows = [(1, None, "u"), (2, None, "v"), (3, "a", None), (4, "a", None), (5, None, None),
            (6, None, None)]
    assert kept(spark, rows) == [1, 2, 3, 5, 6]


def test_stored_keys_count_as_taken(spark):
    rows = [(1, "id1", "new"), (2, "id2", "u2"), (3, "id3", "stored_url")]
    assert kept(spark, rows, stored=[("id1", "x"), ("zz", "stored_url")]) == [2]


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 6)),
                          st.one_of(st.none(), st.integers(0, 6))), min_size=1, max_size=40),
       st.randoms(use_true_random=False))
def test_two_key_equals_sequential(spark, pairs, rnd):
    order = list(range(1, len(pairs) + 1))
    rnd.shuffle(order)
    rows = [(o, None if a is None else f"a{a}", None if b is None else f"b{b}")
            for o, (a, b) in zip(order, pairs)]
    exp = sorted(models.sequential_two_key(rows))
    assert kept(spark, rows) == exp


@pytest.mark.parametrize("shape", ["chain", "two_chains", "tree", "reversed"])
def test_long_chains_take_few_rounds(spark, shape):
    """1,024 rows of which each shares one key with the row before: pointer jumping, not a round for two rows."""
    n = 1024
    if shape == "tree":    # every group is a first row and two followers
        rows = [(i, f"a{i}", f"b{(i - 1) // 2}") if i % 2 else (i, f"a{(i - 1) // 2}", f"b{i}") for i in range(1, n + 1)]
    else:
        step = 2 if shape == "two_chains" else 1
        link = lambda i: (f"a{i // (2 * step)}.{i % step}", f"b{(i + step) // (2 * step)}.{i % step}")
        rows = [(i if shape != "reversed" else n - i, *link(i)) for i in range(n)]
    df = spark.createDataFrame(rows, ROW).repartition(4)
    ins, _, rounds = ingest.insert_two_keys(None, df, ["k1"], ["k2"], "ordinal")
    assert sorted(r[0] for r in ins.select("ordinal").collect()) == sorted(models.sequential_two_key(rows))
    assert rounds <= 12


def test_chains_that_end_undecided(spark):
    """Rows with several earlier neighbours end a chain without an answer and are decided later."""
    rnd = random.Random(4)
    rows = [(i, f"a{i // 2}", f"b{(i + 1) // 2}") for i in range(200)]
    rows += [(200 + i, f"a{rnd.randrange(120)}", f"b{rnd.randrange(120)}") for i in range(60)]
    rows += [(300 + i, None if i % 3 else f"a{i}", f"b{90 + i}") for i in range(60)]
    assert kept(spark, rows) == sorted(models.sequential_two_key(rows))


def test_two_key_on_lineitem_sample(spark):
    from tests.conftest import SMALL
    from agora.plans.catalog_ingest import lineitem_with_ordinal
    rows = lineitem_with_ordinal(spark, SMALL).select(
        "ordinal", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    ins, _, rounds = ingest.insert_two_keys(None, rows, ["l_orderkey", "l_linenumber"],
                                            ["l_partkey", "l_suppkey"], "ordinal")
    data = [(r[0], (r[1], r[2]), (r[3], r[4])) for r in rows.collect()]
    assert sorted(r[0] for r in ins.select("ordinal").collect()) == sorted(
        models.sequential_two_key(data))
    assert rounds >= 1


def test_one_key_first_wins_and_stored(spark):
    inc = spark.createDataFrame([(1, "c1", "first"), (2, "c1", "second"), (3, None, "n1"),
                                 (4, None, "n2"), (5, "c2", "stored")],
                                "ordinal long, ext string, text string")
    stored = spark.createDataFrame([("c2",)], "ext string")
    ins, ign = ingest.insert_one_key(stored, inc, ["ext"], "ordinal")
    assert sorted(r["text"] for r in ins.collect()) == ["first", "n1", "n2"]
    assert sorted(r["ordinal"] for r in ign.collect()) == [2, 5]


def test_with_ordinal_dense(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("v")).repartition(5)
    out = ingest.with_ordinal(df, ["v"], "o").collect()
    assert sorted((r["v"], r["o"]) for r in out) == [(v, v + 1) for v in range(1000)]


@pytest.fixture
def groups(spark):
    return spark.createDataFrame(
        [(1, "Alpha", "https://x/g/a", None), (2, "Beta", "https://x/g/b", None)],
        "group_id long, group_name string, group_url string, last_scraped_at timestamp_ntz")


def test_add_groups(spark, groups):                                      # M5
    new = spark.createDataFrame([(1, "Gamma", "https://x/g/c"), (2, "Alpha", "https://x/g/d"),
                                 (3, "Delta", "https://x/g/c"), (4, "Eps", "https://x/g/e")],
                                "ordinal long, group_name string, group_url string")
    after, rejected = ingest.add_groups(groups, new)
    got = sorted((r["group_id"], r["group_name"]) for r in after.collect())
    assert got == [(1, "Alpha"), (2, "Beta"), (3, "Gamma"), (4, "Eps")]
    assert sorted(r["ordinal"] for r in rejected.collect()) == [2, 3]


def test_get_or_create(spark, groups):                                   # M6, J6, X17
    req = spark.createDataFrame([("https://x/g/b", None), ("https://x/g/z", None),
                                 ("https://x/g/y", "Named")], "group_url string, group_name string")
    resolved, after = ingest.get_or_create_groups(groups, req)
    got = {r["group_url"]: r["group_id"] for r in resolved.collect()}
    assert got["https://x/g/b"] == 2 and {got["https://x/g/y"], got["https://x/g/z"]} == {3, 4}
    names = {r["group_url"]: r["group_name"] for r in after.collect()}
    assert names["https://x/g/z"] == "Group from https://x/g/z" and names["https://x/g/y"] == "Named"


def test_remove_groups_restrict_and_cascade(spark, groups):              # M7, Q14
    posts = spark.createDataFrame([(10, 1)], "internal_post_id long, group_id long")
    comments = spark.createDataFrame([(100, 10)], "comment_id long, internal_post_id long")
    ids = spark.createDataFrame([(1,), (2,), (9,)], "group_id long")
    out = ingest.remove_groups(groups, posts, ids)
    assert [r[0] for r in out["refused"].collect()] == [1]
    assert [r[0] for r in out["removed"].collect()] == [2]
    assert [r[0] for r in out["unknown"].collect()] == [9]
    assert sorted(r[0] for r in out["groups"].collect()) == [1]
    out = ingest.remove_groups(groups, posts, ids, cascade=True, comments=comments)
    assert out["groups"].count() == 0 and out["posts"].count() == 0
    assert out["comments"].count() == 0


def test_fk_quarantine(spark, groups):                                   # J9
    posts = spark.createDataFrame([(10, 1), (11, 7)], "internal_post_id long, group_id long")
    comments = spark.createDataFrame([(100, 10), (101, 11), (102, 99)],
                                     "comment_id long, internal_post_id long")
    out = ingest.fk_quarantine(groups, posts, comments)
    assert [r["internal_post_id"] for r in out["posts_quarantine"].collect()] == [11]
    assert sorted(r["comment_id"] for r in out["comments_quarantine"].collect()) == [101, 102]


# --- the four ingest-run properties of the source's tests, on S6 ----------------
def _feed(spark, n_groups, per_group):
    rows = [(g, g * 1000 + i) for g in range(n_groups) for i in range(per_group)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "grp int, ordinal long")


def test_cap_honoured(spark):
    out = ingest.cap_per_group(_feed(spark, 1, 20), ["grp"], "ordinal", 10).collect()
    assert sorted(r["ordinal"] for r in out) == list(range(10))


def test_cap_per_group_every_group(spark):
    out = ingest.cap_per_group(_feed(spark, 2, 10), ["grp"], "ordinal", 5).collect()
    assert sorted(r["ordinal"] for r in out) == [0, 1, 2, 3, 4, 1000, 1001, 1002, 1003, 1004]


def test_cap_fewer_than_requested(spark):
    out = ingest.cap_per_group(_feed(spark, 1, 3), ["grp"], "ordinal", 10).collect()
    assert len(out) == 3


def test_cap_empty_input(spark):
    empty = spark.createDataFrame([], "grp int, ordinal long")
    assert ingest.cap_per_group(empty, ["grp"], "ordinal", 10).count() == 0


def test_ingest_records_and_rescrape(spark):                            # ST1, Q10, Q11
    from agora import schemas
    from agora.operators import extract
    page = ('<div role="article"><h2><strong>{a}</strong></h2><abbr title="2 hrs ago">x</abbr>'
            '<div data-ad-preview="message"><div>{t}</div></div><ul>'
            '<li data-commentid="{c}"><a href="/u">Bob</a> <span dir="auto">hi</span></li></ul></div>')
    pages = spark.createDataFrame([
        (1, "https://www.forum.example/groups/g/posts/100", page.format(a="A", t="one", c="c1")),
        (2, "https://www.forum.example/groups/g/about/", page.format(a="B", t="two", c="c2")),
    ], "page_id long, url string, html string")
    rules = {"text_container": ["div[data-ad-preview=message]"]}
    base = F.lit("2024-03-10 12:00:00").cast("timestamp_ntz")
    recs = extract.extract_pages(pages, "forum.example", base_ts=base, rules=rules)
    posts0 = spark.createDataFrame([], schemas.POSTS)
    comments0 = spark.createDataFrame([], schemas.COMMENTS)
    run1 = ingest.ingest_records(posts0, comments0, recs, group_id=7)
    p1 = sorted((r["internal_post_id"], r["external_post_id"], r["post_content_raw"])
                for r in run1["posts"].collect())
    assert [(a, c) for a, _, c in p1] == [(1, "one"), (2, "two")]
    assert p1[0][1] == "100" and p1[1][1].startswith("generated_")     # no id in that url
    c1 = sorted((r["comment_id"], r["internal_post_id"], r["external_comment_id"])
                for r in run1["comments"].collect())
    assert c1 == [(1, 1, "c1"), (2, 2, "c2")]
    # re-scrape: same posts (first write wins, Q11); the id-less post gets a new
    # fallback id this time, so its new comment is resolved by url (Q10)
    pages2 = spark.createDataFrame([
        (3, "https://www.forum.example/groups/g/posts/100", page.format(a="A", t="changed", c="c1")),
        (4, "https://www.forum.example/groups/g/about/", page.format(a="B", t="two", c="c3")),
    ], "page_id long, url string, html string")
    recs2 = extract.extract_pages(pages2, "forum.example", base_ts=base, rules=rules)
    run2 = ingest.ingest_records(run1["posts"], run1["comments"], recs2, group_id=7)
    p2 = sorted((r["internal_post_id"], r["post_content_raw"]) for r in run2["posts"].collect())
    assert p2 == [(1, "one"), (2, "two")]
    c2 = sorted((r["comment_id"], r["internal_post_id"], r["external_comment_id"])
                for r in run2["comments"].collect())
    assert c2 == [(1, 1, "c1"), (2, 2, "c2"), (3, 2, "c3")]


def test_rows_that_share_an_ordinal_are_not_lost(spark):
    rows = [(1, "p1", "u1"), (1, "p2", "u2"), (1, "p1", "u9"), (1, None, None), (1, None, None), (2, "p3", "u2")]
    df = spark.createDataFrame(rows, "ordinal long, k1 string, k2 string")
    ins, ign, _ = ingest.insert_two_keys(None, df, ["k1"], ["k2"], "ordinal")
    got = [tuple(r) for r in ins.collect()]
    assert len(got) + ign.count() == len(rows)
    assert {r[1] for r in got} == {"p1", "p2", None} and sum(r[1] is None for r in got) == 2
    one, ignored = ingest.insert_one_key(None, df, ["k1"], "ordinal")
    assert one.count() == 5 and ignored.count() == 1


def test_first_given_name_and_unique_names(spark, groups):
    req = spark.createDataFrame([(1, "https://x/1", "Zed"), (2, "https://x/1", "Abe"), (3, "https://x/2", "Same"),
                                 (4, "https://x/3", "Same"), (5, "https://x/4", "Alpha"), (6, "https://x/5", None)],
                                "o long, group_url string, group_name string")
    resolved, after = ingest.get_or_create_groups(groups, req, "o")
    names = {r["group_url"]: r["group_name"] for r in after.collect()}
    assert names["https://x/1"] == "Zed" and names["https://x/2"] == "Same"
    assert "https://x/3" not in names and "https://x/4" not in names
    assert len(names) == len(set(names.values()))
    got = {r["o"]: r["group_id"] for r in resolved.collect()}
    assert got[1] == got[2] is not None and got[4] is None and got[5] is None and got[6] is not None


def test_stream_without_rows_first_and_shared_ordinals(spark, tmp_path):
    from agora.streaming import ingest_stream as S
    schema = "ordinal long, k1 string, k2 string"
    sink = S.two_key_sink(str(tmp_path / "store"), ["k1"], ["k2"], "ordinal")
    rows = spark.createDataFrame([(1, "p1", "u1"), (1, "p2", "u2")], schema)
    sink(spark.createDataFrame([], schema), 0)
    sink(rows, 1)
    sink(rows, 1)   # replayed
    sink(rows, 2)   # landed again
    got = S.read_store(spark, str(tmp_path / "store"), rows.schema).collect()
    assert sorted((r["k1"], r["_batch"]) for r in got) == [("p1", 1), ("p2", 1)]


def test_pointer_is_replaced_in_one_step_and_never_lost(spark, tmp_path):
    import pytest
    from agora.sources import sinks
    root = str(tmp_path)
    df = spark.range(3).selectExpr("id AS group_id")
    first = sinks.write_snapshot(df, root, "t")
    second = sinks.write_snapshot(df, root, "t")
    assert first != second == sinks.current_snapshot(spark, root, "t")
    (tmp_path / "t" / sinks.POINTER).unlink()
    with pytest.raises(RuntimeError):
        sinks.current_snapshot(spark, root, "t")


def test_no_own_folder_on_a_cluster(spark, monkeypatch):
    import pytest
    from agora import session

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())
