"""Hot keys: one key / post / shard holding a third of all rows stays exact and
is split or pre-aggregated (never one giant group in one task)."""

from pyspark.sql import functions as F

from tests import models
from agora.operators import annotate as AN
from agora.operators import ingest, search

N = 3000


def hot_rows(spark):
    # a third of the rows share key "hot"; the rest are spread over 500 keys
    return spark.range(N).select(
        F.col("id").alias("ordinal"),
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
         .otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("k"),
        (F.col("id") % 7).alias("v"))


def test_first_per_key_hot(spark):
    df = hot_rows(spark).repartition(8)
    got = {r["k"]: r["ordinal"] for r in ingest.first_per_key(df, F.col("k"), "ordinal").collect()}
    pdf = hot_rows(spark).toPandas()
    exp = pdf.groupby("k")["ordinal"].min().to_dict()
    assert got == exp


def test_comment_activity_hot_post(spark):
    comments = hot_rows(spark).select(
        F.when(F.col("k") == "hot", F.lit(1)).otherwise(F.col("ordinal") + 10)
         .alias("internal_post_id"),
        F.col("ordinal").alias("comment_id"),
        F.concat(F.lit("name"), F.col("v").cast("string")).alias("commenter_name"),
        F.concat(F.lit("text"), F.col("v").cast("string")).alias("comment_text"))
    out = {r["internal_post_id"]: r for r in search.comment_activity(
        comments.repartition(8), comment_author="name3", keyword="text3").collect()}
    assert out[1]["comment_count"] == N // 3
    assert out[1]["_any_author_kw"] is True


def test_two_key_hot_key(spark):
    rows = hot_rows(spark).select("ordinal", F.col("k").alias("k1"),
                                  F.col("v").cast("string").alias("k2"))
    ins, _, _ = ingest.insert_two_keys(None, rows.repartition(8), ["k1"], ["k2"], "ordinal")
    got = sorted(r[0] for r in ins.select("ordinal").collect())
    exp = sorted(models.sequential_two_key([(r[0], r[1], r[2]) for r in rows.collect()]))
    assert got == exp


def test_packing_splits_hot_shard(spark):
    df = spark.range(1, 2001).select(F.col("id"), F.lit("x" * 40).alias("text"),
                                     F.when(F.col("id") % 3 == 0, "hot")
                                      .otherwise(F.concat(F.lit("s"), (F.col("id") % 9).cast("string")))
                                      .alias("shard"))
    out = AN.pack_batches(df, "id", "text", F.col("shard"), 1000, block_rows=100)
    hot = sorted((r["id"], r["batch_seq"]) for r in out.collect() if r["shard"] == "hot")
    assert [s for _, s in hot] == [i // 9 for i in range(len(hot))]    # 110 tokens each, 9 to a batch
    assert out.count() == 2000
