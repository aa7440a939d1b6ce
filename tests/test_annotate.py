"""Annotation: next-fit packing vs a plain model, chunks, answer parsing, the
mapping-back rules (J4 J5 J8 J10 W4) and the write-back (M3 M4)."""

import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from agora import schemas
from agora.functions import answers
from agora.operators import annotate as AN
from agora.plans import offline  # noqa: F401
from agora.sources.bindings import conform


def next_fit_model(tokens, budget):
    out, cur, b, started = [], 0, 0, False
    for t in tokens:
        if started and cur + t > budget:
            b, cur = b + 1, 0
        cur += t
        started = True
        out.append(b)
    return out


def pack(spark, texts, budget, shards=None):
    rows = [(i + 1, t, (shards[i] if shards else "s")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, text string, shard string")
    out = AN.pack_batches(df, "id", "text", F.col("shard"), budget).collect()
    return [r["batch_seq"] for r in sorted(out, key=lambda r: r["id"])]


@pytest.mark.parametrize("budget,expected", [
    (10000, [0] * 20),                                  # 20 x 462 = 9,240 fits
    (1000, [i // 2 for i in range(20)]),                # two per batch
    (500, list(range(20))),                             # one per batch
    (300, list(range(20))),                             # oversize rows sit alone
])
def test_batch_smoke(spark, budget, expected):
    assert pack(spark, ["This is a test post content. " * 50] * 20, budget) == expected


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 3000), min_size=1, max_size=60), st.integers(150, 2000))
def test_packing_equals_model(spark, lengths, budget):
    texts = ["x" * n for n in lengths]
    assert pack(spark, texts, budget) == next_fit_model([n // 4 + 100 for n in lengths], budget)


def test_packing_is_per_shard(spark):
    texts = ["x" * 400] * 6
    got = pack(spark, texts, 450, shards=["a", "b", "a", "b", "a", "b"])
    assert got == [0, 0, 0, 0, 1, 1]                  # 200 tokens each: two per batch


@pytest.mark.parametrize("budget", [150, 450, 1000, 5000])
def test_any_block_size_gives_the_same_batches(spark, budget):
    import random
    rng = random.Random(budget)
    lengths = [rng.choice([0, 40, 400, 900, 3000]) for _ in range(120)]
    rows = [(i * 10**12, "x" * n, rng.choice(["a", "a", "a", "b", None])) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "id long, text string, shard string")
    want = {}
    for name in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == name]
        for r, seq in zip(own, next_fit_model([len(r[1]) // 4 + 100 for r in own], budget)):
            want[r[0]] = (name, seq)
    for block, fan in ((1, 2), (1, 7), (3, 3), (7, 16), (50, 2), (100_000, 16)):
        out = AN.pack_batches(df, "id", "text", F.col("shard"), budget, block_rows=block, fan=fan).collect()
        assert {r["id"]: (r["shard"], r["batch_seq"]) for r in out} == want and len(out) == len(rows)


def test_small_blocks_share_a_call():
    """A call of the Python function for every block of one row made the packing as slow as its calls."""
    import pandas as pd
    rows = pd.DataFrame({"_pos": range(40), "tokens": [100] * 40})
    maps = AN._block_maps(1, 30, 10, 1000)((7, 0), rows)
    assert maps["_block"].tolist() == list(range(30)) and set(maps["_shard"]) == {7}
    entries = maps.assign(_entry=0, _seq=0)
    assert AN._entries(30)((7, 0), entries)["_seq"].tolist() == [(i + 9) // 10 for i in range(30)]
    assert len(AN._composed(10, 4)((7, 0), maps)) == 8
    assert AN.CALL_ROWS > 1000 and AN.CALL_MAPS > 1000


def test_fixed_chunks(spark):
    df = spark.createDataFrame([(i * 3, "t") for i in range(12)], "comment_id long, t string")
    out = AN.fixed_chunks(df, "comment_id").collect()
    got = sorted((r["comment_id"], r["chunk"]) for r in out)
    assert got == [(i * 3, i // 5) for i in range(12)]


def test_prompt_text(spark):
    df = spark.createDataFrame([(2, "b", "x", 2), (1, "a", "x", 1)],
                               "internal_post_id long, post_content_raw string, batch_id string, "
                               "ordinal long")
    p = AN.build_prompts(df, "posts", "internal_post_id", "post_content_raw").first()
    assert p["user"] == "Posts:\n[POST_ID_1: a]\n[POST_ID_2: b]\n"
    assert p["system"].endswith(AN.POST_SCHEMA_FOR_PROMPT)
    assert AN.get_prompt("comment_analysis", overrides={"comment_analysis": "X"}) == "X"
    with pytest.raises(ValueError):
        AN.get_prompt("nope")


def test_annotator_registry_and_retry():
    with pytest.raises(ValueError):
        AN.get_annotator("missing")
    calls, sleeps = [], []

    def flaky(s, u):
        calls.append(1)
        if len(calls) < 3:
            raise AN.TransientError("busy")
        return "ok"
    clock = iter(range(0, 1000, 1))
    assert AN.call_with_retry(flaky, "s", "u", sleep=sleeps.append, jitter=lambda: 0,
                              clock=lambda: next(clock)) == "ok"
    assert sleeps == [1.0, 2.0]

    def broken(s, u):
        calls.append(1)
        raise KeyError("no such key")
    calls.clear()
    assert AN.call_with_retry(broken, "s", "u", sleep=sleeps.append) is None and len(calls) == 1

    def dead(s, u):
        raise TimeoutError("down")
    t = iter(range(0, 10000, 100))
    assert AN.call_with_retry(dead, "s", "u", sleep=lambda w: None, clock=lambda: next(t)) is None


def test_keywords_decode(spark):
    df = spark.createDataFrame([('["a"]',), ('"[\\"b\\"]"',), ("oops",), (None,)], "t string")
    got = [r[0] for r in df.select(answers.keywords_from_text(F.col("t"))).collect()]
    assert got == [["a"], ["b"], [], []]


def _batch(spark, rows):
    df = spark.createDataFrame(rows, "batch_id string, ordinal long, internal_post_id long, "
                                     "post_content_raw string")
    return df


def _answers(spark, rows):
    return spark.createDataFrame(rows, "batch_id string, answer string")


def res(pid, summary="", cat="Other"):
    return {"postId": pid, "category": cat, "keywords": ["k"], "summary": summary,
            "isPotentialIdea": True, "reasoning": "r"}


def test_mapping_rules(spark):
    batched = _batch(spark, [("b1", 1, 1, "alpha beta gamma"), ("b1", 2, 2, "beta gamma"),
                             ("b1", 3, 3, "delta"), ("b2", 1, 4, "gamma ray")])
    ans = _answers(spark, [
        ("b1", json.dumps([res("POST_ID_1", cat="first"), res("POST_ID_1: x", cat="second"),
                           res("POST_X", summary="beta gamma"),            # J5 -> post 1 (first)
                           res("POST_X", summary="delta", cat="d"),         # J5 -> post 3
                           res("POST_X", summary=""),                       # blank: no fallback
                           res("POST_ID_4", summary="gamma ray")])),         # other batch: reject
        ("b2", "not json"),
    ])
    m = AN.map_post_results(AN.results_of(ans, "posts"), batched)
    got = {r["internal_post_id"]: (r["r"]["category"], r["matched_by"])
           for r in m["matched"].collect()}
    # post 1: "first", "second" (id) then the fallback result (summary) -> last wins
    assert got == {1: ("Other", "summary"), 3: ("d", "summary")}
    assert m["rejects"].count() == 2


def test_comment_mapping_and_apply(spark):
    comments = conform(spark.createDataFrame(
        [(7, 1, "hi", False), (8, 1, "yo", False), (9, 1, "zz", False)],
        "comment_id long, internal_post_id long, comment_text string, "
        "is_processed_by_ai_comment boolean"), schemas.COMMENTS)
    batched = spark.createDataFrame([("0", 7), ("0", 8), ("0", 9)], "batch_id string, comment_id long")
    ok = {"comment_id": "COMMENT_ID_7", "category": "question", "sentiment": "neutral",
          "keywords": []}
    ans = _answers(spark, [("0", json.dumps({"comments": [
        ok, {**ok, "comment_id": "COMMENT_ID_8x"},
        {**ok, "comment_id": "COMMENT_ID_9", "category": "bogus"}]}))])
    m = AN.map_comment_results(AN.results_of(ans, "comments"), batched)
    assert [r["comment_id"] for r in m["matched"].collect()] == [7]
    assert m["rejects"].count() == 2                                     # J8 + F21
    after = AN.apply_comment_results(comments, m["matched"], F.lit("2024-01-01 00:00:00"))
    rows = {r["comment_id"]: r for r in after.collect()}
    assert rows[7]["is_processed_by_ai_comment"] and rows[7]["ai_comment_category"] == "question"
    assert not rows[8]["is_processed_by_ai_comment"]                     # retried next run


def test_end_to_end_offline(spark):
    texts = ["x" * random.Random(i).randint(10, 3000) for i in range(30)]
    posts = conform(spark.createDataFrame(
        [(i + 1, 1, t, False) for i, t in enumerate(texts)],
        "internal_post_id long, group_id long, post_content_raw string, "
        "is_processed_by_ai boolean"), schemas.POSTS)
    out = AN.annotate_posts(posts, "offline", max_tokens=1500,
                            run_ts=F.lit("2024-01-01 00:00:00"))
    after = out["posts"].collect()
    done = [r for r in after if r["is_processed_by_ai"]]
    assert len(after) == 30 and len(done) >= 25
    for r in done:
        assert r["ai_category"] in schemas.POST_CATEGORIES
        assert r["last_ai_processing_at"] is not None
    # a second run only picks the rest and is idempotent for the processed ones
    again = AN.annotate_posts(out["posts"], "offline", max_tokens=1500,
                              run_ts=F.lit("2024-01-02 00:00:00"))["posts"].collect()
    assert sum(r["is_processed_by_ai"] for r in again) >= len(done)


def test_registered_factory_reaches_the_executors(spark):
    def factory(prefix="", **_):
        return lambda system, user: prefix + user[:6]
    AN.register_annotator("echo", factory)
    prompts = spark.createDataFrame([("b1", "s", "Posts:\n..", 1)], "batch_id string, system string, user string, n_items long")
    got = AN.annotate_prompts(prompts, "echo", {"prefix": ">"}, concurrency=1).collect()
    assert got[0]["answer"] == ">Posts:"


def test_a_name_given_twice_keeps_the_last_value(spark):
    text = '[{"postId": "POST_ID_1", "category": "Other", "category": "Project Idea", "keywords": [], "summary": "s", ' \
           '"isPotentialIdea": true, "reasoning": "r"}, {"postId": "POST_ID_2", "category": "Other"}]'
    df = spark.createDataFrame([("b", text), ("c", "Sure:\n```json\n" + text + "\n```"), ("d", "so [1] it is " + text)],
                               "batch_id string, answer string")
    got = [(r["batch_id"], r["parsed_id"], r["r"]["category"]) for r in AN.results_of(df, "posts").collect()]
    assert sorted(got) == [("b", 1, "Project Idea"), ("b", 2, "Other"), ("c", 1, "Project Idea"), ("c", 2, "Other")]


def test_labels_of_the_instructions_are_those_that_are_checked():
    for name, labels in (("post_categorization", schemas.POST_CATEGORIES), ("comment_analysis", schemas.COMMENT_CATEGORIES)):
        assert all(x in AN.get_prompt(name) for x in labels)
