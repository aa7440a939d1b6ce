"""Scalar expressions on literal rows: X1-X5, X13-X15, F17, F18."""

import datetime as dt

import pytest

from pyspark.sql import functions as F

from agora.functions import text, timeparse, urls


def one_col(spark, values, expr_fn, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {typ}")
    return [r[0] for r in df.select(expr_fn(F.col("v"))).collect()]


def test_canonical_url(spark):
    got = one_col(spark, ["https://www.forum.example:8443/groups/x/posts/123?a=1#f",
                          "http://a.com", "not a url", None], urls.canonical_url)
    assert got == ["https://www.forum.example:8443/groups/x/posts/123", "http://a.com", None, None]


def test_record_id_cascade(spark):
    got = one_col(spark, [
        "https://forum.example/groups/g/posts/123/",
        "https://forum.example/groups/g/videos/a.b-c",
        "https://forum.example/permalink.php?story_fbid=9%2B9&id=5",
        "https://forum.example/watch/?v=777",
        "https://forum.example/x/1234567890/",
        "https://forum.example/groups/g/posts/bad%20id/",
        "https://forum.example/groups/g/posts",
        "https://forum.example/groups/g/",
        None], urls.record_id)
    assert got == ["123", "a.b-c", "9+9", "777", "1234567890", None, None, None, None]


def test_post_identity_and_fallback(spark):
    df = spark.createDataFrame([("https://www.forum.example/groups/g/posts/1", False, 1),
                                ("https://other.com/groups/g/posts/1", False, 2),
                                ("https://other.com/x", True, 3),
                                (None, False, 4)], "u string, marker boolean, k long")
    ident = urls.post_identity(F.col("u"), "forum.example", F.col("marker"), F.col("k"))
    rows = df.select(*[v.alias(n) for n, v in ident.items()]).collect()
    assert rows[0]["post_id"] == "1" and rows[0]["is_candidate"]
    assert not rows[1]["is_candidate"] and rows[1]["post_id"] is None
    assert rows[2]["is_candidate"] and rows[2]["post_id"].startswith("generated_")
    assert len(rows[2]["post_id"]) == len("generated_") + 12
    assert not rows[3]["is_candidate"]
    again = df.select(ident["post_id"]).collect()[2][0]
    assert again == rows[2]["post_id"]                                  # Q12 deterministic


def test_comment_id_cascade(spark):
    df = spark.createDataFrame([("/x?comment_id=42&a=1", None), ("/x", "c9"), (None, None)],
                               "href string, dc string")
    got = [r[0] for r in df.select(urls.comment_id_from(
        F.col("href"), F.col("dc"), F.lit("p"), F.lit("1"))).collect()]
    assert got[0] == "42" and got[1] == "c9" and got[2].startswith("bs_fallback_")


def test_valid_group_url(spark):
    got = one_col(spark, ["https://www.facebook.com/groups/my.group/", "http://fb.com/groups/ü_x",
                          "https://facebook.com/pages/x", "ftp://facebook.com/groups/x", "", None],
                  urls.valid_group_url)
    assert got == [True, True, False, False, False, False]


def test_time_text(spark):
    base = dt.datetime(2024, 3, 10, 12, 0, 0)
    cases = [
        ("2024-01-05T10:00:00+02:00", dt.datetime(2024, 1, 5, 8, 0)),
        ("2024-01-05T10:00:00", dt.datetime(2024, 1, 5, 10, 0)),
        ("January 5, 2024 at 3:04 PM", dt.datetime(2024, 1, 5, 15, 4)),
        ("March 3 at 5:00 PM", dt.datetime(2024, 3, 3, 17, 0)),
        ("2 hrs ago", dt.datetime(2024, 3, 10, 10, 0)),
        ("1 day", dt.datetime(2024, 3, 9, 12, 0)),
        ("5m", dt.datetime(2024, 3, 10, 11, 55)),
        ("Yesterday at 5:00 PM", dt.datetime(2024, 3, 9, 17, 0)),
        ("Just now", base),
        ("2024-01-05", dt.datetime(2024, 1, 5)),
        ("", None),
        ("junk text", None),
        (None, None),
    ]
    df = spark.createDataFrame([(c, base) for c, _ in cases], "t string, b timestamp_ntz")
    got = [r[0] for r in df.select(timeparse.parse_time_text(F.col("t"), F.col("b"))).collect()]
    assert got == [e for _, e in cases]


def test_date_argument(spark):
    got = one_col(spark, ["2024-01-15", "2024-1-5", "", None, "2024-13-01", "15/01/2024"],
                  timeparse.valid_date_arg)
    assert got == [True, True, True, True, False, False]


def test_tag_ids(spark):
    got = one_col(spark, ["POST_ID_12", "POST_ID_12: x", "12", "POST_ID_", "POST_ID_" + "9" * 30],
                  lambda c: text.lenient_tag_id(c, "POST_ID_"))
    assert got == [12, 12, None, None, None]
    got = one_col(spark, ["COMMENT_ID_7", "COMMENT_ID_7x", None],
                  lambda c: text.strict_tag_id(c, "COMMENT_ID_"))
    assert got == [7, None, None]


def test_token_estimate_and_line(spark):
    got = one_col(spark, ["This is a test post content. " * 50, "", None, "ééé"],
                  text.token_estimate)
    assert got == [462, 100, 100, 100]
    df = spark.createDataFrame([(5, "hi")], "i long, t string")
    assert df.select(text.tagged_line("POST_ID_", F.col("i"), F.col("t"))).first()[0] == \
        "[POST_ID_5: hi]\n"


def test_contains_pattern():
    assert text.contains_pattern("a\\b") == "%a\\\\b%"
    assert text.contains_pattern("50%") == "%50%%"


def test_time_text_reject_count(spark):
    df = spark.createDataFrame([("2 hrs ago",), ("junk",), ("",), (None,), ("bad date",)], "t string")
    parsed = df.withColumn("p", timeparse.parse_time_text(
        F.col("t"), F.lit("2024-03-10 12:00:00").cast("timestamp_ntz")))
    out, obs = timeparse.observe_rejects(parsed, "t", "p")
    assert out.count() == 5
    assert obs.get == {"rejected": 2, "with_text": 4}


def test_more_time_forms(spark):
    import datetime as dt
    base = dt.datetime(2024, 2, 1, 12, 30)  # a Thursday
    want = {
        "an hour ago": dt.datetime(2024, 2, 1, 11, 30), "a day ago": dt.datetime(2024, 1, 31, 12, 30),
        "30 secs ago": dt.datetime(2024, 2, 1, 12, 29, 30), "1 hour 5 minutes ago": dt.datetime(2024, 2, 1, 11, 25),
        "2 days, 3 hours ago": dt.datetime(2024, 1, 30, 9, 30), "last week": dt.datetime(2024, 1, 25, 12, 30),
        "Monday at 5:00 PM": dt.datetime(2024, 1, 29, 17), "Thursday": dt.datetime(2024, 1, 25),
        "Yesterday at 17:00": dt.datetime(2024, 1, 31, 17), "yesterday at 5:00 pm": dt.datetime(2024, 1, 31, 17),
        "5 January 2024": dt.datetime(2024, 1, 5), "5 January 2024 at 15:04": dt.datetime(2024, 1, 5, 15, 4),
        "January 5, 2024, 3:04 PM": dt.datetime(2024, 1, 5, 15, 4),
        "Monday, January 5, 2024 at 3:04 PM": dt.datetime(2024, 1, 5, 15, 4),
        "2024/01/05": dt.datetime(2024, 1, 5), "2024/1/5 10:20": dt.datetime(2024, 1, 5, 10, 20),
        "March 3 at 5:00 PM": dt.datetime(2024, 3, 3, 17), "2 hrs ago": dt.datetime(2024, 2, 1, 10, 30),
        "5m": dt.datetime(2024, 2, 1, 12, 25), "Just now": base, "some words": None, "": None, "at": None,
        "12345 hours ago and more": None,
    }
    df = spark.createDataFrame([(k, base) for k in want], "t string, b timestamp_ntz")
    got = {r["t"]: r["p"] for r in df.select("t", timeparse.parse_time_text(F.col("t"), F.col("b")).alias("p")).collect()}
    assert got == want


# ---------------------------------------------------------------- selectors
def _select(page, text):
    from agora.functions import html as H
    m = H.Matcher()
    numbers = m.add(text)
    root = H.parse(page)
    return [n.attrs.get("id") for n in m.walk(root).every(numbers, root)]


SELECTED = """<div id=a class="x y"><p id=b>t</p><p id=c dir=auto>u<b id=d>v</b></p><ul id=e><li id=f><div id=g role=article
 href="/posts/1">w</div></li><li id=h class="y  z"><a id=i href="/user/2/x"><span id=j>k</span></a></li></ul></div>
<div id=k aria-label="Comment by X"><button id=l>m</button></div>"""


@pytest.mark.parametrize("selector, ids", [
    ("div", "agk"), ("DIV", "agk"), ("*", "abcdefghijkl"), ("div p", "bc"), ("div > p", "bc"), ("div > b", ""), ("div b", "d"),
    ("p + p", "c"), ("p + ul", "e"), ("p ~ ul", "e"), ("b ~ ul", ""), ("ul > li div[role='article']", "g"),
    (".y", "ah"), ("div.x.y", "a"), (".z.y", "h"), ("li.x", ""), ("#d", "d"), ("[href*='/user/'] span", "j"),
    ("[href^='/posts']", "g"), ('[href$="/x"]', "i"), ("[class~=z]", "h"), ("[dir|=auto]", "c"), ("[href*='']", ""),
    ("li:first-child", "f"), ("div:first-child p", "bc"), ("p:last-child", ""), ("li:last-child a", "i"),
    ('div:not([class*=" "])', "gk"), ("div:not(:has(button))", "ag"), ("div:has(button)", "k"), ("div:not(.x, [role])", "k"),
    ("div:not(.x):not([role=article])", "k"), ("p, li , a", "bcfhi"), (" p ,  b ", "bcd"), ("ul>li>a > span", "j"),
    ('div[aria-label*="Comment by"], ul > li div[role="article"]', "gk"), ("div ul li a span", "j"), ("li + li a", "i"),
    ("div div", "g"), ("ul li ~ li", "h"),
])
def test_selectors(selector, ids):
    assert "".join(_select(SELECTED, selector)) == ids


@pytest.mark.parametrize("selector", ["", "div >", "> div", "div:nth-child(2)", "div[", "a:hover", "div:has(a b)", "div:has(a) p",
                                      "p:not(a b)", "a,,b", "div::before", "p!", "div:not(", "a b,"])
def test_selectors_that_are_not_understood_raise(selector):
    with pytest.raises(ValueError):
        _select(SELECTED, selector)


def test_selectors_inside_an_element_may_look_outside():
    from agora.functions import html as H
    m = H.Matcher()
    numbers, items = m.add("div li span, div a"), m.add("li")
    root = H.parse(SELECTED)
    found = m.walk(root)
    first, second = found.every(items, root)
    assert found.first(numbers, first) is None and found.first(numbers, second).attrs["id"] == "i"
    assert [n.attrs["id"] for n in found.every(numbers, second)] == ["i", "j"]


def test_rules_of_both_formats_load_and_bad_ones_fail_early(spark):
    from agora import schemas
    from agora.operators import extract
    for rules in (schemas.ARTICLE_RULES, schemas.FEED_RULES):
        extract.compiled(rules)
    pages = spark.createDataFrame([(1, "https://a/", "<p>x</p>")], "page_id long, url string, html string")
    with pytest.raises(ValueError):
        extract.extract_pages(pages, "a", rules={"author_name": ["h1:nth-of-type(2)"]})


def test_deep_pages_are_walked_without_recursion():
    page = "<div>" * 5000 + "<b id=z>x</b>"
    assert _select(page, "div div b") == ["z"]


# ---------------------------------------------------------------- size of plans
def test_time_parsing_keeps_plans_small(spark):
    from pyspark.sql import functions as F

    from agora.functions.timeparse import parse_time_text
    df = spark.createDataFrame([("2 hrs ago",)], "t string")
    plan = df.select(parse_time_text(F.col("t"), F.localtimestamp()).alias("ts"))._jdf.queryExecution().optimizedPlan()
    assert len(plan.toString()) < 20_000


def test_page_extraction_keeps_plans_small(spark):
    from __spark_entry__ import queries
    from tests.conftest import SMALL
    for name in ("extract_pages", "extract_feed_pages", "extract_comments"):
        plan = queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan()
        assert len(plan.toString()) < 100_000, name


def test_first_fenced_array_counts(spark):
    from pyspark.sql import functions as F

    from agora import schemas
    from agora.functions import answers
    array = '[{"postId": "POST_ID_1"}]'
    texts = [f"see\n```json\n{array}\n```", f"```\n{array}```", f"```python\nprint(1)\n```\nthen\n```json\n{array}\n```",
             "```json\n{}\n```", f"```JSON {array}\n```", "```json\n[1,"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["r"] for r in df.select("i", answers.parse_results(
        F.col("t"), schemas.POST_RESULT, schemas.POST_WRAPPER_KEYS).alias("r")).collect()}
    assert [len(got[i]) for i in range(6)] == [1, 1, 1, 0, 1, 0]
