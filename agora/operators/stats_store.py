"""Statistics kept up to date batch by batch (A1-A6): mergeable partial aggregates, summed on read.

Every stored batch leaves its partial counts (``parts.BatchTable``); reading sums them, so no stored post or comment
is read again. A changed post (an annotation) is the old one taken away and the new one added. Partial
counts of old batches are summed where they are merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agora.sources.parts import BatchTable

#: What is counted, of what value (a category, an author, a post id): rows and non-null ids.
PARTIAL = T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType()),
                        T.StructField("n", T.LongType()), T.StructField("n_ids", T.LongType())])


def merged(partials: DataFrame) -> DataFrame:
    return partials.groupBy("kind", "value").agg(F.sum("n").alias("n"), F.sum("n_ids").alias("n_ids"))


def post_partials(posts: DataFrame, sign: int = 1) -> DataFrame:
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value")) for k, v in (
        ("post", F.lit(None)), ("state", F.col("is_processed_by_ai")), ("category", F.col("ai_category")),
        ("author", F.col("post_author_name")))])
    return (posts.select(F.explode(kinds).alias("k")).groupBy("k.kind", "k.value")
            .agg((F.count(F.lit(1)) * sign).alias("n")).select("kind", "value", "n", F.lit(0).cast("long").alias("n_ids")))


def comment_partials(comments: DataFrame) -> DataFrame:
    return comments.groupBy(F.col("internal_post_id").cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.count("comment_id").alias("n_ids")).select(
        F.lit("comments").alias("kind"), "value", "n", "n_ids")


class StatisticsStore:
    """Partial counts of posts and of comments; batches of each are numbered by their own stream."""

    def __init__(self, spark: SparkSession, root: str, most: int = 32):
        self.posts, self.comments = (BatchTable(spark, f"{root.rstrip('/')}/{name}", PARTIAL, most, merge=merged)
                                     for name in ("posts", "comments"))

    def add_posts(self, posts: DataFrame, batch: int) -> None:
        self.posts.put(post_partials(posts), batch)

    def change_posts(self, old: DataFrame, new: DataFrame, batch: int) -> None:
        """Posts as they were and as they are now."""
        self.posts.put(merged(post_partials(old, -1).unionByName(post_partials(new))), batch)

    def add_comments(self, comments: DataFrame, batch: int) -> None:
        self.comments.put(comment_partials(comments), batch)

    def _counts(self, kind: str) -> DataFrame:
        return merged(self.posts.read().where(F.col("kind") == kind)).where("n <> 0")

    def overview(self) -> DataFrame:
        """A1 A3 A4 A5, as ``stats.overview``."""
        both = merged(self.posts.read().unionByName(self.comments.read()))
        of = lambda kind, col="n": F.when(F.col("kind") == kind, F.col(col))
        return both.agg(F.coalesce(F.sum(of("post")), F.lit(0)).alias("total_posts"),
                        F.coalesce(F.sum(F.when(F.col("value") == "false", of("state"))), F.lit(0)).alias("unprocessed_posts"),
                        F.coalesce(F.sum(of("comments")), F.lit(0)).alias("total_comments"),
                        F.coalesce(F.avg(of("comments", "n_ids")), F.lit(0.0)).alias("avg_comments_per_post"))

    def posts_per_category(self) -> DataFrame:
        """A2, as ``stats.posts_per_category``."""
        return self._counts("category").select(F.col("value").alias("ai_category"), F.col("n").alias("post_count")).orderBy(
            F.col("post_count").desc(), F.col("ai_category").asc_nulls_first())

    def top_authors(self, k: int = 5) -> DataFrame:
        """A6, as ``stats.top_authors``."""
        return self._counts("author").select(F.col("value").alias("post_author_name"), F.col("n").alias("post_count")).orderBy(
            F.col("post_count").desc(), F.col("post_author_name").asc_nulls_first()).limit(int(k))
