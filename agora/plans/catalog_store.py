"""Registered queries on stored tables: partial rewrites (M3 X16 ST3), the answer ledger (UDF1 UDF4), statistics kept
up to date (A1-A6), keyword search by postings (F6-F8), rejects (F21 J8), files (P4 SNK4) and new tables (SRC1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from agora import schemas
from agora.operators import annotate as AN
from agora.operators import export, keyword_index, ledger
from agora.operators.stats_store import StatisticsStore
from agora.plans import catalog, catalog_annotate, catalog_export
from agora.plans import offline  # noqa: F401  (registers the annotators)
from agora.plans import sql_bindings as SB
from agora.plans.registry import ORACLES, register
from agora.session import scratch_path
from agora.sources import bindings as B
from agora.sources import sinks
from agora.sources.parts import IdTable
from agora.streaming import ingest_stream as S

RUNS = ("2024-03-01 00:00:00", "2024-03-02 00:00:00")
_BATCHES, _TARGETS = catalog_annotate._BATCHES, catalog_annotate._POST_TARGETS.rstrip()

# length of a batch's prompt (X9): the header line and a tagged line a post
_PROMPT = ("length('Posts:') + 1 + sum(length('[POST_ID_' || CAST(doc_id AS VARCHAR) || ': ' || text || ']') + 1)")
_FAILED = f"SELECT shard, batch_seq FROM batched GROUP BY shard, batch_seq HAVING ({_PROMPT}) % 3 = 0"
_WIN = """ AS (
  SELECT target, category FROM {0} WHERE target IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY target ORDER BY pos DESC, dup DESC) = 1)"""


def _second(sql: str) -> str:
    """The rule of the first pass for the second: the same names with a 2."""
    import re
    return re.sub(r"\b(todo|packed|batched|res|tgt)\b", r"\g<1>2", sql)


_PASS_TWO = _second(_BATCHES[_BATCHES.index("todo AS ("):].replace(
    "AND post_content_raw IS NOT NULL)", "AND post_content_raw IS NOT NULL\n"
    "    AND internal_post_id NOT IN (SELECT target FROM win))") + "," + _TARGETS)


@register("annotate_two_passes", "WITH RECURSIVE " + _BATCHES + "," + _TARGETS.replace(
    "FROM batched\n", f"FROM batched WHERE (shard, batch_seq) NOT IN ({_FAILED})\n").replace(
    "FROM batched WHERE doc_id % 13 = 0", f"FROM batched WHERE doc_id % 13 = 0 AND (shard, batch_seq) NOT IN ({_FAILED})")
    + ",\nwin" + _WIN.format("tgt") + "," + _PASS_TWO + ",\nwin2" + _WIN.format("tgt2") + f"""
SELECT p.internal_post_id, (p.is_processed_by_ai OR w.target IS NOT NULL OR w2.target IS NOT NULL) AS is_processed_by_ai,
       coalesce(w2.category, w.category) AS ai_category,
       CASE WHEN w2.target IS NOT NULL THEN TIMESTAMP '{RUNS[1]}' WHEN w.target IS NOT NULL THEN TIMESTAMP '{RUNS[0]}' END
         AS last_ai_processing_at
FROM b2_posts p LEFT JOIN win w ON p.internal_post_id = w.target LEFT JOIN win2 w2 ON p.internal_post_id = w2.target""")
def q_annotate_two_passes(spark, sf_dir):
    """ST3: posts whose batch failed stay unannotated and make up the second run; each run rewrites only the parts
    of the stored table that hold its posts (M3) and stamps them (X16)."""
    posts = B.posts_b2(spark, sf_dir)
    source = B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("internal_post_id"), "source")
    table = IdTable(spark, scratch_path(spark, "posts"), schemas.POSTS, "internal_post_id", span=50)
    table.append(posts)
    for failing, at in zip((True, False), RUNS):
        stamp = F.lit(at).cast("timestamp_ntz")
        run = AN.annotate_posts(table.read().join(source, "internal_post_id"), "offline_failing",
                                max_tokens=catalog_annotate.BUDGET, shard=F.col("source"), run_ts=stamp,
                                options={"failing": failing})
        table.update(AN.cut_lineage(AN.post_changes(run["matched"], stamp)))
    return table.read().select("internal_post_id", "is_processed_by_ai", "ai_category", "last_ai_processing_at")


@register("annotate_ledger", "WITH RECURSIVE " + _BATCHES + f"""
SELECT shard || '/0/' || CAST(batch_seq AS VARCHAR) AS batch_id, count(*) AS n_items,
       CASE WHEN ({_PROMPT}) % 3 = 0 THEN 'second' ELSE 'first' END AS run
FROM batched GROUP BY shard, batch_seq""")
def q_annotate_ledger(spark, sf_dir):
    """UDF4: prompts that failed in the first run are the only ones that the second one sends."""
    prompts = AN.build_prompts(catalog_annotate._batched_b2(spark, sf_dir), "posts", "internal_post_id", "post_content_raw")
    path = scratch_path(spark, "ledger")
    for run, failing in (("first", True), ("second", False)):
        answers = ledger.annotate_with_ledger(prompts, path, "offline_failing", {"failing": failing}, run=run)
    return answers.where("answer IS NOT NULL").select("batch_id", "n_items", "run")


def _rounds(df, key, rounds=3):
    for r in range(rounds):
        yield df.where(F.pmod(F.col(key), F.lit(rounds)) == r)


def _kept_statistics(spark, sf_dir):
    """Posts and comments land in three rounds each; every round leaves its partial counts."""
    store = StatisticsStore(spark, scratch_path(spark, "statistics"), most=2)
    for df, key, add in ((B.posts_b1(spark, sf_dir), "internal_post_id", store.add_posts),
                         (B.comments_b1(spark, sf_dir), "comment_id", store.add_comments)):
        landing, checkpoint = scratch_path(spark, "landing"), scratch_path(spark, "ckpt")
        for part in _rounds(df, key):
            S.land_round(part, landing)
            S.run_ingest_stream(spark, landing, df.schema, "", checkpoint, lambda d: d, add)
    return store


@register("stats_incremental", ORACLES["stats_overview"])
def q_stats_incremental(spark, sf_dir):
    """A1 A3 A4 A5 after three rounds of a stream, from partial counts alone."""
    return _kept_statistics(spark, sf_dir).overview()


@register("stats_incremental_categories", ORACLES["posts_per_category"])
def q_stats_incremental_categories(spark, sf_dir):
    """A2 from partial counts, after posts were annotated: the old rows are taken away and the new ones added."""
    store = StatisticsStore(spark, scratch_path(spark, "statistics"))
    posts = B.posts_b1(spark, sf_dir)
    before = posts.withColumn("ai_category", F.lit(None).cast("string")).withColumn("is_processed_by_ai", F.lit(False))
    store.add_posts(before, 0)
    store.change_posts(before, posts, 1)
    return store.posts_per_category()


@register("search_keyword_indexed", ORACLES["search_keyword"])
def q_search_keyword_indexed(spark, sf_dir):
    """F6-F8 through the posting table of trigrams: the rows of search_keyword."""
    posts, comments = B.posts_b1(spark, sf_dir), B.comments_b1(spark, sf_dir)
    path = keyword_index.build(posts, comments, scratch_path(spark, "trigrams"))
    return keyword_index.search_posts(path, posts, comments, keyword="ring", order=False).select(*catalog.SEARCH_COLS)


@register("annotate_rejects", SB.with_(SB.B3) + """
, todo AS (SELECT *, row_number() OVER (ORDER BY comment_id) - 1 AS place FROM b3_comments WHERE comment_text IS NOT NULL)
SELECT CAST(place // 5 AS VARCHAR) AS batch_id, CAST(place % 5 AS INTEGER) AS rpos,
       'COMMENT_ID_' || comment_id || CASE WHEN comment_id % 9 = 4 THEN 'x' ELSE '' END AS comment_id
FROM todo WHERE comment_id % 9 = 4 OR comment_id % 11 = 7""")
def q_annotate_rejects(spark, sf_dir):
    """Results whose id is not one of their batch, and results of a category that does not exist."""
    todo = AN.fixed_chunks(AN.unprocessed_comments(B.comments_b3(spark, sf_dir)), "comment_id")
    batched = AN.cut_lineage(todo)
    answers = AN.annotate_prompts(AN.build_prompts(batched, "comments", "comment_id", "comment_text"))
    wrong = F.when(F.col("parsed_id") % 11 == 7, F.lit("no_such_category")).otherwise(F.col("r.category"))
    results = AN.results_of(answers, "comments").withColumn("r", F.col("r").withField("category", wrong))
    return AN.map_comment_results(results, batched)["rejects"].select("batch_id", "rpos", "r.comment_id")


def _header(entity: str, names: list[str]) -> str:
    first = [c for c in schemas.ESSENTIAL_FIELDS[entity] if c in names]
    rest = ", ".join(f"'{c}'" for c in names if c not in first)
    return f"'{','.join(first)},' || array_to_string(list_sort([{rest}]), ',')"


@register("export_layout", SB.with_(SB.B1) + catalog_export._SELECTED + f"""
SELECT 'posts' AS entity, {_header("posts", [*schemas.POSTS.names, "comment_count"])} AS header, count(*) AS n FROM sel
UNION ALL SELECT 'comments', NULL, 0
UNION ALL SELECT 'groups', {_header("groups", schemas.GROUPS.names)}, count(*) FROM b1_groups
UNION ALL SELECT 'combined', '{",".join(schemas.COMBINED_FIELDS)}',
  (SELECT count(*) FROM sel) + (SELECT count(*) FROM b1_groups)""")
def q_export_layout(spark, sf_dir):
    """P4 SNK1 SNK3 SNK4: the header of every file written, and its records; an entity without rows leaves no file."""
    data = catalog_export._data(spark, sf_dir, "all", materialize=True)
    data["comments"] = data["comments"].where(F.lit(False))
    data["combined"] = export.combined(data["groups"], data["posts"], data["comments"])
    written = sinks.export(data, scratch_path(spark, "layout") + "/", "csv", spark)
    rows = []
    for entity in schemas.EXPORT_ENTITIES:
        file = spark.read.option("header", True).csv(written[entity]) if entity in written else data["comments"]
        header = F.lit(",".join(file.columns) if entity in written else None).cast("string")
        rows.append(file.agg(F.count(F.lit(1)).alias("n")).select(F.lit(entity).alias("entity"), header.alias("header"), "n"))
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@register("store_bootstrap", SB.with_(SB.B1) + """
SELECT 'groups' AS name, true AS present, CAST(0 AS BIGINT) AS n_new, count(*) AS n FROM b1_groups
UNION ALL SELECT 'posts', true, 0, count(*) FROM b1_posts
UNION ALL SELECT 'comments', true, 0, count(*) FROM b1_comments""")
def q_store_bootstrap(spark, sf_dir):
    """SRC1 SRC2: tables are made once, empty and typed; a second start leaves what they hold."""
    root, out = scratch_path(spark, "store"), []
    sinks.bootstrap(spark, root)
    new = {name: sinks.read_table(spark, root, name).count() for name in schemas.TABLES}
    for name, rows in (("groups", B.groups_b1), ("posts", B.posts_b1), ("comments", B.comments_b1)):
        rows(spark, sf_dir).write.mode("append").parquet(f"{root}/{name}")
    sinks.bootstrap(spark, root)
    present = sinks.tables_present(spark, root)
    for name in ("groups", "posts", "comments"):
        out.append(sinks.read_table(spark, root, name).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("name"), F.lit(present).alias("present"), F.lit(new[name]).cast("long").alias("n_new"), "n"))
    return out[0].unionByName(out[1]).unionByName(out[2])
