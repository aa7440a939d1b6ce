"""Batch annotation: select unannotated rows, pack them into prompts, call a
pluggable annotator, parse the answers and write the results back.

Plan (posts)::

    F12 unprocessed -> X8 tokens -> W1 next-fit packing per shard (applyInPandas on
    blocks of rows, only (position, tokens) cross into Python) -> X9/X10 prompt per batch ->
    UDF1 annotator (Arrow-batched pandas UDF, non-deterministic) -> raw answers
    CHECKPOINTED (a recomputed plan must never call the model twice) ->
    X11/X12 parse -> posexplode -> X13 id -> J4 equi-join on (batch, id) ->
    J5 containment fallback within the batch -> W4 last result wins -> M3.

Comments use fixed chunks of 5 in comment-id order (W2): a global dense rank
(distributed, no single-partition window) divided by the chunk size.
"""

from __future__ import annotations

import itertools
import logging
import random
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agora import schemas
from agora.functions.answers import parse_results
from agora.functions.text import lenient_tag_id, strict_tag_id, tagged_line, token_estimate
from agora.operators.ingest import cut_lineage, with_ordinal
from agora.session import ship_package

log = logging.getLogger(__name__)

# ---------------------------------------------------------------- prompts (UDF5)
DEFAULT_PROMPTS = schemas.DEFAULT_PROMPTS
POST_SCHEMA_FOR_PROMPT = schemas.POST_SCHEMA_FOR_PROMPT
COMMENT_SCHEMA_FOR_PROMPT = schemas.COMMENT_SCHEMA_FOR_PROMPT


def get_prompt(prompt_type: str, include_schema: bool = False,
               overrides: dict | None = None) -> str:
    """X10 instruction: an override replaces the default; the schema text is appended."""
    if prompt_type not in DEFAULT_PROMPTS:
        raise ValueError(f"unknown prompt type {prompt_type!r}; known: {list(DEFAULT_PROMPTS)}")
    prompt = (overrides or {}).get(prompt_type, DEFAULT_PROMPTS[prompt_type])
    if include_schema:
        extra = POST_SCHEMA_FOR_PROMPT if prompt_type == "post_categorization" \
            else COMMENT_SCHEMA_FOR_PROMPT
        prompt = f"{prompt}\n\n{extra}"
    return prompt


# ---------------------------------------------------------------- selection
def unprocessed_posts(posts: DataFrame, group_id: int | None = None,
                      keep: tuple[str, ...] = ()) -> DataFrame:
    """unannotated posts with text (optionally one group)."""
    p = posts.filter(~F.col("is_processed_by_ai") & F.col("post_content_raw").isNotNull())
    if group_id is not None:
        p = p.filter(F.col("group_id") == F.lit(int(group_id)))
    return p.select("internal_post_id", "post_content_raw", "group_id", *keep)


def unprocessed_comments(comments: DataFrame, group_id: int | None = None,
                         posts: DataFrame | None = None) -> DataFrame:
    """unannotated comments with text; optionally only one group's (via posts)."""
    c = comments.filter(~F.col("is_processed_by_ai_comment") & F.col("comment_text").isNotNull())
    if group_id is not None and posts is not None:
        ids = posts.filter(F.col("group_id") == F.lit(int(group_id))).select("internal_post_id")
        c = c.join(ids, "internal_post_id", "left_semi")
    return c.select("comment_id", "comment_text", "internal_post_id")


# ---------------------------------------------------------------- W1 packing
#: Consecutive rows of a shard that one task packs.
BLOCK_ROWS = 100_000


def _next_starts(tokens: np.ndarray, max_tokens: int) -> np.ndarray:
    """For each row the row that the next batch begins with, if one begins here."""
    total = np.concatenate([[0], np.cumsum(tokens)])
    fits = np.searchsorted(total, total[:-1] + max_tokens, side="right") - 1
    return np.maximum(fits, np.arange(len(tokens)) + 1)


#: Rows, and maps of blocks, that a call of a Python function takes where they are smaller than a task needs: a call costs
#: as much as some thousand rows.
CALL_ROWS, CALL_MAPS = 8192, 4096
_MAP_COLUMNS = ["_shard", "_block", "entry", "leave", "count"]


def _block_maps(block_rows: int, blocks: int, reach: int, max_tokens: int):
    """Where the batches leave each of ``blocks`` consecutive blocks, for each row they may enter it by: as runs of
    entries with the same (row of the next block, number of batches begun)."""
    def fn(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out, entry = pdf.sort_values("_pos"), [], np.arange(reach)
        rows = int((pdf["_pos"] < (int(key[1]) + 1) * blocks * block_rows).sum())
        starts = _next_starts(pdf["tokens"].to_numpy(), max_tokens)
        for begin in range(0, rows, block_rows):
            own = min(block_rows, rows - begin)
            at = starts[begin:begin + own] - begin
            count = np.ones(own, np.int64)
            while len(inside := np.flatnonzero(at < own)):  # each step doubles the batches looked ahead
                count[inside], at[inside] = count[inside] + count[at[inside]], at[at[inside]]
            passed = entry >= own
            enter = np.minimum(entry, own - 1)
            out.append((key[0], int(key[1]) * blocks + begin // block_rows, *_as_runs(
                np.where(passed, entry, at[enter]) - block_rows, np.where(passed, 0, count[enter]))))
        return pd.DataFrame(out, columns=_MAP_COLUMNS)
    return fn


def _as_runs(leave: np.ndarray, count: np.ndarray) -> tuple[list, list, list]:
    """A map from entries to (leave, count) as runs of entries: of one value, or (count 0) of entries that the
    batch passes by, whose leaves rise with the entry."""
    same = (np.diff(count) == 0) & (np.diff(leave) == (count[1:] == 0))
    new = np.flatnonzero(np.append(True, ~same))
    return new.tolist(), leave[new].tolist(), count[new].tolist()


def _from_runs(start, leave, count, reach: int) -> tuple[np.ndarray, np.ndarray]:
    start, leave, count = (np.asarray(x, np.int64) for x in (start, leave, count))
    run = np.repeat(np.arange(len(start)), np.diff(np.append(start, reach)))
    return np.where(count[run] == 0, leave[run] + np.arange(reach) - start[run], leave[run]), count[run]


def _composed(reach: int, fan: int):
    """One map for each ``fan`` consecutive blocks: composition is associative, so blocks may be joined as a tree."""
    def fn(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("_block"), []
        maps = zip(pdf["_block"] // fan, pdf["entry"], pdf["leave"], pdf["count"])
        for above, own in itertools.groupby(maps, key=lambda m: m[0]):
            leave, count = np.arange(reach), np.zeros(reach, np.int64)
            for _, *runs in own:
                to, more = _from_runs(*runs, reach)
                leave, count = to[leave], count + more[leave]
            out.append((key[0], int(above), *_as_runs(leave, count)))
        return pd.DataFrame(out, columns=_MAP_COLUMNS)
    return fn


def _entries(fan: int):
    """Follow at most ``fan`` blocks of each map: where the batches enter each, and how many began before."""
    def fn(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out, above = pdf.sort_values("_block"), [], None
        rows = zip(pdf["_block"], pdf["_entry"], pdf["_seq"], pdf["entry"], pdf["leave"], pdf["count"])
        for block, first, before, start, leave, count in rows:
            if block // fan != above:
                above, entry, seq = block // fan, int(first), int(before)
            out.append((key[0], block, entry, seq))
            run = int(np.searchsorted(start, entry, side="right")) - 1
            seq += int(count[run])
            entry = int(leave[run]) + (entry - int(start[run]) if count[run] == 0 else 0)
        return pd.DataFrame(out, columns=["_shard", "_block", "_entry", "_seq"])
    return fn


#: Blocks (and maps of blocks) that are joined into one.
FAN = 16
_MAP = "_shard long, _block long, entry array<long>, leave array<long>, count array<long>"


def _entered(maps: DataFrame, reach: int, fan: int) -> DataFrame:
    """Where the batches enter every block. Maps of ``fan`` blocks are composed into one, level by level, until
    a shard has at most ``fan`` of them; the entries then follow level by level back to the blocks. No task holds
    more than ``fan`` maps at once, or ``CALL_MAPS`` small ones, however many blocks a shard has."""
    levels = [cut_lineage(maps)]
    last = levels[0].agg(F.max("_block")).first()[0] or 0
    above = F.floor(F.col("_block") / fan).cast("long").alias("_above")
    # maps of ``reach`` entries each: about as many numbers in a call, whatever their size
    call = max(1, CALL_MAPS * 32 // max(32, reach) // fan)
    some = F.floor(F.col("_block") / (fan * call)).cast("long").alias("_call")
    while last >= fan:
        levels.append(cut_lineage(levels[-1].groupBy("_shard", some).applyInPandas(_composed(reach, fan), _MAP)))
        last //= fan
    entries = None
    for level in reversed(levels):
        rows = level.select("*", above)
        if entries is None:
            rows = rows.withColumns({"_entry": F.lit(0).cast("long"), "_seq": F.lit(0).cast("long")})
        else:
            rows = rows.join(entries.withColumnRenamed("_block", "_above"), ["_shard", "_above"])
        entries = cut_lineage(rows.groupBy("_shard", some).applyInPandas(
            _entries(fan), "_shard long, _block long, _entry long, _seq long"))
    return entries


def _numbered(block_rows: int, max_tokens: int):
    """Batch numbers of the rows of consecutive blocks, given where the batches enter each."""
    def fn(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        starts, begins = _next_starts(pdf["tokens"].to_numpy(), max_tokens), np.zeros(len(pdf), np.int64)
        enters, before, seq = pdf["_entry"].to_numpy(), pdf["_seq"].to_numpy(), np.zeros(len(pdf), np.int64)
        for begin in range(0, len(pdf), block_rows):
            end = min(begin + block_rows, len(pdf))
            entry = begin + enters[begin]
            while entry < end:
                begins[entry] = 1
                entry = starts[entry]
            seq[begin:end] = before[begin] - 1 + np.cumsum(begins[begin:end])
        return pd.DataFrame({"_g": pdf["_g"].to_numpy(), "batch_seq": seq})
    return fn


def pack_batches(rows: DataFrame, id_col: str, text_col: str, shard: Column,
                 max_tokens: int = schemas.POST_BATCH_MAX_TOKENS,
                 block_rows: int = BLOCK_ROWS, fan: int = FAN) -> DataFrame:
    """Next-fit packing by token budget, in id order, within each shard.

    A batch closes when adding the next row would pass ``max_tokens``; a row
    larger than the budget sits alone. A NULL shard is a shard of its own. The result
    does not depend on ``block_rows``, the consecutive rows of a shard that one task
    packs: a row costs ``TOKEN_OVERHEAD`` at least, so a batch reaches only so many
    rows into the next block. For each row that a batch can enter a block by, a
    task finds where the batches leave it; these maps are composed as a tree of ``fan``
    (``_entered``), and every block is numbered with its own entry. Only (position, tokens) go
    through Python.

    Returns rows + ``tokens``, ``shard``, ``batch_seq`` and ``batch_id`` =
    "<shard>/0/<seq>".
    """
    ship_package(rows.sparkSession)
    reserved = {"shard", "tokens", "ordinal", "batch_seq", "batch_id"}
    keyed = rows.select(*[F.col(c) for c in rows.columns if c not in reserved],
                        shard.cast("string").alias("shard"),
                        token_estimate(F.col(text_col)).alias("tokens"),
                        F.col(id_col).alias("ordinal"))
    ranked = with_ordinal(keyed, ["shard", "ordinal"], "_g")
    # a shard is known by its first row from here on
    first = ranked.groupBy(F.col("shard").alias("_name")).agg(F.min("_g").alias("_shard"))
    narrow = (ranked.select("_g", "shard", "tokens").join(first, F.col("shard").eqNullSafe(F.col("_name")))
              .select("_g", "_shard", (F.col("_g") - F.col("_shard")).alias("_pos"), "tokens"))
    reach = max(1, max_tokens // schemas.TOKEN_OVERHEAD)
    # a call takes several small blocks, and the rows that a batch may reach behind the last of them
    blocks = max(1, max(CALL_ROWS, reach) // block_rows)
    call = lambda pos: F.floor(pos / (block_rows * blocks)).cast("long")
    back = F.greatest(F.lit(0).cast("long"), call(F.col("_pos") - reach))
    maps = (narrow.withColumn("_call", F.explode(F.sequence(back, call(F.col("_pos")))))
            .groupBy("_shard", "_call").applyInPandas(
                _block_maps(block_rows, blocks, reach, max_tokens), _MAP))
    entries = _entered(maps, reach, fan)
    packed = (narrow.withColumn("_block", F.floor(F.col("_pos") / block_rows).cast("long")).join(entries, ["_shard", "_block"])
              .groupBy("_shard", call(F.col("_pos")).alias("_call")).applyInPandas(
                  _numbered(block_rows, max_tokens), "_g long, batch_seq long"))
    out = ranked.join(packed, "_g").drop("_g")
    return out.withColumn("batch_id", F.concat_ws("/", "shard", F.lit("0"), F.col("batch_seq").cast("string")))


def fixed_chunks(rows: DataFrame, id_col: str, size: int = schemas.COMMENT_CHUNK_SIZE) -> DataFrame:
    """Consecutive chunks of ``size`` rows in id order (global, exact)."""
    r = with_ordinal(rows, [id_col], "_rank")
    chunk = F.floor((F.col("_rank") - 1) / F.lit(size)).cast("bigint")
    return r.withColumn("chunk", chunk).withColumn("batch_id", chunk.cast("string")) \
        .withColumnRenamed("_rank", "ordinal")


# ---------------------------------------------------------------- X9/X10 prompts
def build_prompts(batched: DataFrame, kind: str, id_col: str, text_col: str,
                  instruction: str | None = None, include_schema: bool = True) -> DataFrame:
    """One prompt row per batch: (batch_id, system, user, n_items).

    The user text is the header line then one tagged line per row in ordinal
    order. A batch is bounded by the token budget (or the chunk size), so the
    ordered collect per batch is bounded too.
    """
    tag = schemas.POST_TAG if kind == "posts" else schemas.COMMENT_TAG
    header = "Posts:\n" if kind == "posts" else "Comments:\n"
    ptype = "post_categorization" if kind == "posts" else "comment_analysis"
    system = instruction or get_prompt(ptype, include_schema=include_schema)
    lines = batched.select("batch_id", "ordinal",
                           tagged_line(tag, F.col(id_col), F.col(text_col)).alias("line"))
    return lines.groupBy("batch_id").agg(
        F.concat(F.lit(header), F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("ordinal", "line"))), lambda x: x["line"]), ""))
        .alias("user"),
        F.count(F.lit(1)).alias("n_items"),
    ).withColumn("system", F.lit(system))


# ---------------------------------------------------------------- UDF1-UDF4
# UDF3: annotators by name; a factory runs on the worker.
ANNOTATORS: dict[str, Callable[..., Callable[[str, str], str]]] = {}


def register_annotator(name: str, factory: Callable[..., Callable[[str, str], str]]) -> None:
    ANNOTATORS[name] = factory


def factory_of(name: str) -> Callable[..., Callable[[str, str], str]]:
    if name not in ANNOTATORS:
        raise ValueError(f"unknown annotator {name!r}; known: {sorted(ANNOTATORS)}")
    return ANNOTATORS[name]


def get_annotator(name: str, **options) -> Callable[[str, str], str]:
    return factory_of(name)(**options)


class TransientError(Exception):
    """What an annotator raises for a failure that may pass (rate limit, overload)."""


TRANSIENT = (TransientError, ConnectionError, TimeoutError)


def call_with_retry(fn, *args, initial=schemas.RETRY_INITIAL_S,
                    multiplier=schemas.RETRY_MULTIPLIER, cap=schemas.RETRY_MAX_WAIT_S,
                    deadline=schemas.RETRY_DEADLINE_S, sleep=time.sleep, clock=time.monotonic,
                    transient=TRANSIENT, jitter=random.random):
    """UDF4: exponential back-off with jitter on transient errors; after the deadline, and at
    once on any other error, the call yields None (its rows stay unprocessed)."""
    start, wait = clock(), initial
    while True:
        try:
            return fn(*args)
        except transient as e:
            if clock() - start + wait > deadline:
                log.warning("annotator gave up after retries: %s", e)
                return None
            sleep(wait * (1 + jitter() / 4))
            wait = min(wait * multiplier, cap)
        except Exception as e:
            log.warning("annotator failed: %s", e)
            return None


#: Prompts that cross into Python at once: they are long, and a call takes far longer than a batch.
CALL_PROMPTS = 256


@contextmanager
def small_batches(spark, rows: int):
    """At most ``rows`` rows an Arrow batch in jobs that are planned and run inside, whatever the session has."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    now = int(before)
    spark.conf.set(name, str(min(rows, now) if now > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def annotate_prompts(prompts: DataFrame, annotator: str = "offline", options: dict | None = None,
                     retry: dict | None = None, concurrency: int | None = None) -> DataFrame:
    """UDF1/UDF2: (batch_id, system, user) -> + answer (NULL when the call failed).

    An Arrow-batched iterator UDF: the annotator is built once per task. The
    prompts are spread over ``concurrency`` partitions (default: the cluster's
    parallelism) — an explicit count that AQE does not coalesce — so that many
    calls run at once and the knob matches the model service's rate limit. The
    answers are checkpointed to the shared folder before anything reads them,
    so a re-evaluated plan never calls the model again.
    """
    ship_package(prompts.sparkSession)
    # looked up here: the executors' own registry knows nothing of what was registered on the driver
    factory, opts, rkw = factory_of(annotator), dict(options or {}), dict(retry or {})
    n = concurrency or prompts.sparkSession.sparkContext.defaultParallelism
    prompts = prompts.repartition(int(n), "batch_id")

    @F.pandas_udf(T.StringType())
    def call(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        fn = factory(**opts)
        for system, user in it:
            yield pd.Series([call_with_retry(fn, s, u, **rkw) for s, u in zip(system, user)],
                            dtype=object)

    call = call.asNondeterministic()
    answered = prompts.select("batch_id", "n_items", call(F.col("system"), F.col("user"))
                              .alias("answer"))
    with small_batches(prompts.sparkSession, CALL_PROMPTS):
        return cut_lineage(answered)


# ---------------------------------------------------------------- mapping back
def results_of(answers: DataFrame, kind: str) -> DataFrame:
    """One row per parsed result: (batch_id, rpos, result, parsed_id)."""
    schema = schemas.POST_RESULT if kind == "posts" else schemas.COMMENT_RESULT
    keys = schemas.POST_WRAPPER_KEYS if kind == "posts" else schemas.COMMENT_WRAPPER_KEYS
    # of a name given twice in one object the last value counts, as usual for JSON
    answers.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    parsed = answers.select("batch_id", F.posexplode(
        parse_results(F.col("answer"), schema, keys)).alias("rpos", "r"))
    if kind == "posts":
        pid = lenient_tag_id(F.col("r.postId"), schemas.POST_TAG)
    else:
        pid = strict_tag_id(F.col("r.comment_id"), schemas.COMMENT_TAG)
    return parsed.withColumn("parsed_id", pid)


def valid_result(kind: str) -> Column:
    """required fields present; comment category / sentiment in their enums."""
    req = schemas.POST_RESULT_REQUIRED if kind == "posts" else schemas.COMMENT_RESULT_REQUIRED
    ok = F.lit(True)
    for f in req:
        ok = ok & F.col(f"r.{f}").isNotNull()
    if kind == "comments":
        ok = ok & F.col("r.category").isin(*schemas.COMMENT_CATEGORIES) \
            & F.col("r.sentiment").isin(*schemas.COMMENT_SENTIMENTS)
    return ok


#: Letters of a summary that its post is looked for by.
GRAM = 12


def containment_fallback(unmatched: DataFrame, posts: DataFrame) -> DataFrame:
    """(batch_id, rpos, fb_pid) for results whose non-blank summary occurs in a
    post of the same batch — the first such post in batch order.

    A post that holds a summary holds its first ``GRAM`` letters (all, if it is shorter). Only batches
    with unmatched results take part: the different strings of that length in their posts are joined
    with the summaries' beginnings, and the posts found that way are tested. No group of a batch is
    gathered and no summary meets a post without cause.
    """
    summ = unmatched.filter(F.col("r.summary").isNotNull() & (F.col("r.summary") != "")).select(
        "batch_id", "rpos", F.col("r.summary").alias("summary"))
    some = summ.select("batch_id", "summary", F.least(F.lit(GRAM), F.length("summary")).alias("q")).distinct()
    some = some.withColumn("gram", F.substring(F.col("summary"), F.lit(1), F.col("q")))
    sizes = some.select("batch_id", "q").distinct()   # GRAM rows a batch at most
    texts = (posts.join(sizes, "batch_id").where(F.length("content") >= F.col("q"))
             .select("batch_id", "pid", "ordinal", "content", "q"))
    # a substring is counted from the start of its text: pieces of about the root of the length keep that short
    step = F.greatest(F.lit(64), F.ceil(F.sqrt(F.length("content")))).cast("int")
    pieces = F.transform(F.sequence(F.lit(1), F.length("content"), step),
                         lambda i: F.substring(F.col("content"), i, step + F.col("q") - 1))
    own = texts.select("batch_id", "pid", "ordinal", "q", F.explode(pieces).alias("piece")).where(
        F.length("piece") >= F.col("q"))
    grams = own.select("batch_id", "pid", "ordinal", "q", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length("piece") - F.col("q") + 1),
        lambda i: F.substring(F.col("piece"), i, F.col("q"))))).alias("gram"))
    hits = some.join(grams, ["batch_id", "q", "gram"]).select("batch_id", "summary", "pid", "ordinal").distinct()
    held = (hits.join(posts.select("batch_id", "pid", "content"), ["batch_id", "pid"])
            .where(F.contains("content", "summary")).groupBy("batch_id", "summary")
            .agg(F.min_by("pid", "ordinal").alias("fb_pid")))
    return summ.join(held, ["batch_id", "summary"]).select("batch_id", "rpos", "fb_pid")


def map_post_results(results: DataFrame, batched: DataFrame, validate: bool = False) -> dict:
    """J4 + J5 + J8 + W4: results -> (matched per post, rejects).

    J4: the parsed id is a post of the same batch. J5 (only for results J4 left
    unmatched): the first post of the batch, in batch order, whose text contains
    the non-blank summary (``containment_fallback``).
    W4: per post the last result (batch, result position) wins.
    """
    r = results.filter(valid_result("posts")) if validate else results
    bad = results.filter(~valid_result("posts")) if validate else None
    posts = batched.select("batch_id", "ordinal", F.col("internal_post_id").alias("pid"),
                           F.col("post_content_raw").alias("content"))
    ids = batched.select(F.col("batch_id").alias("_b"),
                         F.col("internal_post_id").alias("direct_pid"))
    direct = r.join(ids, (F.col("batch_id") == F.col("_b"))
                    & (F.col("parsed_id") == F.col("direct_pid")), "left").drop("_b")
    unmatched = direct.filter(F.col("direct_pid").isNull()).drop("direct_pid")
    fallback = containment_fallback(unmatched, posts)
    mapped = direct.join(fallback, ["batch_id", "rpos"], "left").withColumn(
        "target", F.coalesce(F.col("direct_pid"), F.col("fb_pid"))).withColumn(
        "matched_by", F.when(F.col("direct_pid").isNotNull(), "id")
        .when(F.col("fb_pid").isNotNull(), "summary"))
    rejects = mapped.filter(F.col("target").isNull()).select("batch_id", "rpos", "r")   # J8
    if bad is not None:
        rejects = rejects.unionByName(bad.select("batch_id", "rpos", "r"))
    last = mapped.filter(F.col("target").isNotNull()).groupBy("target").agg(
        F.max_by(F.struct("r", "matched_by"), F.struct("batch_id", "rpos")).alias("w"))
    return {"matched": last.select(F.col("target").alias("internal_post_id"), "w.r",
                                   "w.matched_by"),
            "rejects": rejects}


def map_comment_results(results: DataFrame, batched: DataFrame, validate: bool = True) -> dict:
    """J10 + J8 + W4: strict id within the chunk; no fallback."""
    r = results.filter(valid_result("comments")) if validate else results
    bad = results.filter(~valid_result("comments")) if validate else None
    ids = batched.select("batch_id", F.col("comment_id").alias("parsed_id"))
    hit = r.join(ids, ["batch_id", "parsed_id"], "left_semi")
    rejects = r.join(ids, ["batch_id", "parsed_id"], "left_anti").select("batch_id", "rpos", "r")
    if bad is not None:
        rejects = rejects.unionByName(bad.select("batch_id", "rpos", "r"))
    last = hit.groupBy("parsed_id").agg(F.max_by("r", F.struct("batch_id", "rpos")).alias("r"))
    return {"matched": last.withColumnRenamed("parsed_id", "comment_id"), "rejects": rejects}


# ---------------------------------------------------------------- M3 / M4
def _post_values(r: str, run_ts: Column) -> dict[str, Column]:
    """The columns that a result (struct column ``r``) gives a post; X16 the stamp of the run."""
    return {
        "ai_category": F.col(f"{r}.category"),
        "ai_sub_category": F.col(f"{r}.subCategory"),
        "ai_keywords": F.coalesce(F.col(f"{r}.keywords"), F.array().cast("array<string>")),
        "ai_summary": F.col(f"{r}.summary"),
        "ai_is_potential_idea": F.coalesce(F.col(f"{r}.isPotentialIdea"), F.lit(False)),
        "ai_reasoning": F.col(f"{r}.reasoning"),
        "ai_raw_response": F.to_json(F.col(r)),
        "is_processed_by_ai": F.lit(True),
        "last_ai_processing_at": run_ts.cast("timestamp_ntz"),
    }


def _comment_values(r: str, run_ts: Column) -> dict[str, Column]:
    return {
        "ai_comment_category": F.col(f"{r}.category"),
        "ai_comment_sentiment": F.col(f"{r}.sentiment"),
        "ai_comment_keywords": F.coalesce(F.col(f"{r}.keywords"), F.array().cast("array<string>")),
        "ai_comment_raw_response": F.to_json(F.col(r)),
        "is_processed_by_ai_comment": F.lit(True),
        "last_ai_processing_at_comment": run_ts.cast("timestamp_ntz"),
    }


def post_changes(matched: DataFrame, run_ts: Column) -> DataFrame:
    """M3 as changed columns by id, for ``parts.IdTable.update``: only the parts that hold them are rewritten."""
    return matched.select("internal_post_id", *[v.alias(c) for c, v in _post_values("r", run_ts).items()])


def comment_changes(matched: DataFrame, run_ts: Column) -> DataFrame:
    """M4, as ``post_changes``."""
    return matched.select("comment_id", *[v.alias(c) for c, v in _comment_values("r", run_ts).items()])


def _applied(rows: DataFrame, matched: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    j = rows.join(matched.select(key, F.col("r").alias("_r"), F.lit(True).alias("_hit")), key, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return j.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
                      for c in rows.columns])


def apply_post_results(posts: DataFrame, matched: DataFrame, run_ts: Column) -> DataFrame:
    """M3: annotated posts get the result, the processed flag and the run stamp.

    Produces a new snapshot of the table (join + when), never an in-place update.
    """
    return _applied(posts, matched, "internal_post_id", _post_values("_r", run_ts))


def apply_comment_results(comments: DataFrame, matched: DataFrame, run_ts: Column) -> DataFrame:
    """M4: as M3 for comments."""
    return _applied(comments, matched, "comment_id", _comment_values("_r", run_ts))


# ---------------------------------------------------------------- end to end
def annotate_posts(posts: DataFrame, annotator: str = "offline", group_id: int | None = None,
                   max_tokens: int = schemas.POST_BATCH_MAX_TOKENS, shard: Column | None = None,
                   run_ts: Column | None = None, options: dict | None = None,
                   instruction: str | None = None) -> dict:
    """ST3 step for posts: returns the new posts snapshot plus the run's pieces."""
    todo = unprocessed_posts(
        posts.withColumn("_shard", shard if shard is not None else F.col("group_id")),
        group_id, keep=("_shard",))
    batched = pack_batches(todo, "internal_post_id", "post_content_raw", F.col("_shard"),
                           max_tokens)
    batched = cut_lineage(batched)
    prompts = build_prompts(batched, "posts", "internal_post_id", "post_content_raw", instruction)
    answers = annotate_prompts(prompts, annotator, options)
    mapped = map_post_results(results_of(answers, "posts"), batched)
    ts = run_ts if run_ts is not None else F.localtimestamp()
    return {"posts": apply_post_results(posts, mapped["matched"], ts), "batches": batched,
            "answers": answers, "matched": mapped["matched"], "rejects": mapped["rejects"]}


def annotate_comments(comments: DataFrame, annotator: str = "offline",
                      run_ts: Column | None = None, options: dict | None = None,
                      group_id: int | None = None, posts: DataFrame | None = None,
                      instruction: str | None = None) -> dict:
    """ST3 step for comments (chunks of 5)."""
    todo = unprocessed_comments(comments, group_id, posts)
    batched = cut_lineage(fixed_chunks(todo, "comment_id"))
    prompts = build_prompts(batched, "comments", "comment_id", "comment_text", instruction)
    answers = annotate_prompts(prompts, annotator, options)
    mapped = map_comment_results(results_of(answers, "comments"), batched)
    ts = run_ts if run_ts is not None else F.localtimestamp()
    return {"comments": apply_comment_results(comments, mapped["matched"], ts),
            "batches": batched, "answers": answers, "matched": mapped["matched"],
            "rejects": mapped["rejects"]}

