"""Table maintenance: de-duplicating inserts, groups upsert / delete, FK checks.

Semantics follow a sequential "INSERT OR IGNORE" in ingest order (first write
wins), re-expressed as set operations:

* one unique key (M2): first row per key by ordinal, minus keys already stored;
* two unique keys (M1, M5): a row is kept iff, processing rows in ordinal order,
  neither of its keys was taken by a kept row. Computed exactly in rounds: a row
  that is the earliest undecided row of BOTH its key groups is kept; rows sharing
  a key with a kept row are rejected; repeat. Each round is two partial
  aggregations plus joins over the still-undecided rows only, and is
  checkpointed to the shared checkpoint folder. Where a round decides fewer than half of its
  rows, the chains they form are followed by pointer jumping (``_followed``).

NULL keys never collide. Ingest order is an explicit ordinal; rows that share one are
taken in the order of their content, so none is lost and replays agree.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.functions.text import generated_group_name
from agora.session import scratch_path, shared_dir

log = logging.getLogger(__name__)


# ---------------------------------------------------------------- helpers
def key_col(*cols: str) -> Column:
    """A composite key; NULL when any part is NULL (NULLs never collide)."""
    if len(cols) == 1:
        return F.col(cols[0])
    all_set = F.lit(True)
    for c in cols:
        all_set = all_set & F.col(c).isNotNull()
    return F.when(all_set, F.struct(*[F.col(c) for c in cols]))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def with_ordinal(df: DataFrame, order_cols: list[str], name: str = "ordinal",
                 start: int = 1) -> DataFrame:
    """Dense 1-based (``start``-based) BIGINT ordinal in ``order_cols`` order.

    Distributed, no window and no single partition: range-partition and sort
    within partitions, checkpoint (fixes partition contents and row order, so a
    retried task sees the same rows), take each row's position inside its
    partition from ``monotonically_increasing_id`` (partition index in the high
    bits, position in the low bits), and add the prefix sum of the per-partition
    counts (one row per partition, so its broadcast is bounded by the partition
    count).
    """
    ordered = cut_lineage(df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols))
    mid = F.monotonically_increasing_id()
    pos = (ordered.withColumn("_mid", mid)
           .withColumn("_pid", F.shiftright(F.col("_mid"), 33))
           .withColumn("_pos", F.col("_mid") - F.shiftleft(F.col("_pid"), 33)))
    counts = pos.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(
            Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (pos.join(F.broadcast(offsets.select("_pid", "_off")), "_pid")
            .withColumn(name, (F.lit(start) + F.col("_off") + F.col("_pos")).cast("bigint"))
            .drop("_pid", "_off", "_pos", "_mid"))


def first_per_key(df: DataFrame, key: Column, ordinal: str) -> DataFrame:
    """The first row (smallest ordinal) per non-NULL key; NULL-key rows all pass.

    ``min_by`` aggregates partially before the shuffle, so a key holding a third
    of the rows is reduced to one row per map task.
    """
    cols = df.columns
    k = df.withColumn("_k", key)
    firsts = (k.filter(F.col("_k").isNotNull()).groupBy("_k")
              .agg(F.min_by(F.struct(*cols), F.col(ordinal)).alias("_r"))
              .select("_r.*"))
    nulls = k.filter(F.col("_k").isNull()).select(*cols)
    return firsts.unionByName(nulls)


def unique_ordinal(df: DataFrame, ordinal: str, name: str = "_o") -> DataFrame:
    """``df`` (checkpointed) with an ordinal that is unique: the given one, then a hash of
    the row, then the row's place in the checkpoint (for repeated rows)."""
    rows = cut_lineage(df)
    return rows.withColumn(name, F.struct(
        F.col(ordinal).alias("a"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("b"),
        F.monotonically_increasing_id().alias("c")))


def landed(df: DataFrame, name: str) -> DataFrame:
    """``df`` in a Parquet folder of its own below the shared one: a table whose later readers read only their columns."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _stored(df: DataFrame) -> DataFrame:
    """``df`` landed, with its row number ``_place`` and a hash of the row, ``_b``: what needs
    the keys alone reads only them, and whole rows are read once, where they are given out."""
    return landed(df.withColumns({"_b": F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]),
                                  "_place": F.monotonically_increasing_id()}), "incoming")


def _where_set(df: DataFrame, key: str, step) -> DataFrame:
    """``step`` on the rows with a key; rows without one pass by it, so that NULLs
    never meet in one task of a join."""
    return step(df.filter(F.col(key).isNotNull())).unionByName(
        df.filter(F.col(key).isNull()), allowMissingColumns=True)


# ---------------------------------------------------------------- M2
def insert_one_key(stored: DataFrame | None, incoming: DataFrame, key_cols: list[str],
                   ordinal: str) -> tuple[DataFrame, DataFrame]:
    """(inserted, ignored) for a table with one unique key.

    A row is inserted iff its key is NULL, or it is the first row of its key in
    the batch and the key is not stored yet.
    """
    rows = _stored(incoming)
    kept = cut_lineage(_kept_of_one_key(stored, rows, key_cols, ordinal).select("_place"))
    inserted, ignored = (rows.join(kept, "_place", how).drop("_place", "_b") for how in ("left_semi", "left_anti"))
    return inserted, ignored


def _kept_of_one_key(stored: DataFrame | None, rows: DataFrame, key_cols: list[str], ordinal: str) -> DataFrame:
    """a (the ordinal), _b, _place: those of ``rows`` (``_stored``) that a table with one unique key takes."""
    # the key's part of every row, in the order of ``unique_ordinal``
    keys = rows.select(key_col(*key_cols).alias("_k"), F.struct(F.col(ordinal).alias("a"), "_b", "_place").alias("_o"))
    firsts = keys.filter(F.col("_k").isNotNull()).groupBy("_k").agg(F.min("_o").alias("_o"))
    if stored is not None:
        sk = stored.select(key_col(*key_cols).alias("_k")).filter(F.col("_k").isNotNull())
        firsts = firsts.join(sk, "_k", "left_anti")
    return firsts.select("_o.*").unionByName(keys.filter(F.col("_k").isNull()).select("_o.*"))


# ---------------------------------------------------------------- M1 / M5
def _placed(rows: DataFrame, ordinal: str, key1: Column, key2: Column, unique: bool) -> DataFrame:
    """``_place``, both keys and an order ``_o`` of ``rows`` (``_stored``): the ordinal itself where
    it is ``unique``, else a dense one, in which rows that share an ordinal are ordered by a hash of the row, then by
    place (repeated rows)."""
    if unique:
        return rows.select(F.col(ordinal).alias("_o"), "_place", key1.alias("_k1"), key2.alias("_k2"))
    keys = rows.select(F.col(ordinal).alias("_a"), "_b", "_place", key1.alias("_k1"), key2.alias("_k2"))
    return with_ordinal(keys, ["_a", "_b", "_place"], "_o").select("_o", "_place", "_k1", "_k2")


def _firsts(work: DataFrame, key: str) -> DataFrame:
    """_g, _m: the earliest row of each group of a key."""
    return work.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_g")).agg(F.min("_o").alias("_m"))


def _first_of_both(work: DataFrame) -> DataFrame:
    """Rows that are the earliest of both their groups: a semi-join for each key that is set."""
    out = work
    for key in ("_k1", "_k2"):
        out = _where_set(out, key, lambda d, k=key, m=_firsts(work, key): d.join(
            m, (F.col(k) == F.col("_g")) & (F.col("_o") == F.col("_m")), "left_semi"))
    return out


def _predecessors(work: DataFrame) -> DataFrame:
    """_o, at, odd, known, end: the link of every undecided row. A row with exactly one earlier row in its two
    groups is kept if and only if that row is not: it links there, with odd distance. A row with none is
    kept (``known``); one with several ends its chain without an answer."""
    ranked = work
    for n in ("1", "2"):
        firsts = _firsts(work, f"_k{n}").withColumnRenamed("_m", f"_m{n}")
        ranked = _where_set(ranked, f"_k{n}", lambda d, k=f"_k{n}", m=firsts: d.join(
            m, F.col(k) == F.col("_g"), "left").drop("_g"))
    ranked = cut_lineage(ranked.select("_o", "_k1", "_k2", "_m1", "_m2"))
    for n in ("1", "2"):  # the second of each group follows its first
        second = (ranked.filter(F.col("_o") > F.col(f"_m{n}")).groupBy(f"_k{n}", F.col(f"_m{n}").alias(f"_p{n}"))
                  .agg(F.min("_o").alias("_o")).select("_o", f"_p{n}"))
        ranked = ranked.join(second, "_o", "left")
    first = [F.col(f"_m{n}").isNull() | (F.col(f"_m{n}") == F.col("_o")) for n in "12"]
    at = (F.when(first[0] & first[1], F.col("_o")).when(first[0], F.col("_p2")).when(first[1], F.col("_p1"))
          .when(F.col("_p1") == F.col("_p2"), F.col("_p1")))
    linked = at.isNotNull() & (at != F.col("_o"))
    return ranked.select("_o", F.coalesce(at, F.col("_o")).alias("at"), linked.alias("odd"),
                         (first[0] & first[1]).alias("known"), (~linked).alias("end"))


def _followed(work: DataFrame) -> tuple[DataFrame, int]:
    """(undecided rows that are kept as far as their chains tell, jumps): every link is replaced by its
    link's link until all have reached the end of their chain, so a chain of n rows takes log2(n) jumps."""
    links, jumps = cut_lineage(_predecessors(work)), 0
    while not links.filter(~F.col("end")).isEmpty():
        jumps += 1
        target = links.select(F.col("_o").alias("at"), F.col("at").alias("_at"), F.col("odd").alias("_odd"),
                              F.col("known").alias("_known"), F.col("end").alias("_end"))
        moved = links.filter(~F.col("end")).join(target, "at").select(
            "_o", F.col("_at").alias("at"), (F.col("odd") != F.col("_odd")).alias("odd"),
            F.col("_known").alias("known"), F.col("_end").alias("end"))
        links = cut_lineage(links.filter("end").unionByName(moved))
    kept = links.filter(F.col("known") & ~F.col("odd")).select("_o")
    return work.join(kept, "_o", "left_semi"), jumps


def insert_two_keys(stored: DataFrame | None, incoming: DataFrame, key1_cols: list[str],
                    key2_cols: list[str], ordinal: str, max_rounds: int | None = None,
                    taken: tuple[DataFrame, DataFrame] | None = None,
                    unique: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """M1 / M5: (inserted, ignored, rounds) for a table with two unique keys.

    Exactly equal to inserting the rows one by one in ``ordinal`` order with
    INSERT OR IGNORE against both keys. ``taken`` gives the stored keys (``_k1``; ``_k2``) in place of
    ``stored``. ``max_rounds`` is only a safety valve for tests; ``None`` runs to completion; a pointer
    jump counts as a round. ``unique`` says that no two rows share an ordinal and none lacks it (one made by
    ``with_ordinal``), so that rows need not be sorted and numbered again.
    """
    rows = _stored(incoming)
    kept, rounds = _kept_of_two_keys(stored, rows, key1_cols, key2_cols, ordinal, max_rounds, taken, unique)
    kept = cut_lineage(kept.select("_place"))
    inserted, ignored = (rows.join(kept, "_place", how).drop("_place", "_b") for how in ("left_semi", "left_anti"))
    return inserted, ignored, rounds


def _kept_of_two_keys(stored: DataFrame | None, rows: DataFrame, key1_cols: list[str], key2_cols: list[str], ordinal: str,
                      max_rounds: int | None = None, taken: tuple[DataFrame, DataFrame] | None = None,
                      unique: bool = False) -> tuple[DataFrame, int]:
    """(_o, an order that follows the ordinal, and _place of those of ``rows`` (``_stored``) that a table with two unique
    keys takes; rounds)."""
    k1, k2 = key_col(*key1_cols), key_col(*key2_cols)
    work = _placed(rows, ordinal, k1, k2, unique)
    anti = lambda d, key, gone: _where_set(d, key, lambda x: x.join(gone, key, "left_anti"))
    if taken is None and stored is not None:
        taken = stored.select(k1.alias("_k1")), stored.select(k2.alias("_k2"))
    if taken is not None:
        for key, gone in zip(("_k1", "_k2"), taken):
            work = anti(work, key, gone.filter(F.col(key).isNotNull()).distinct())
    if taken is not None or not unique:  # else it is a scan of the stored rows
        work = cut_lineage(work)
    # rows with both keys NULL never collide: kept now; every later kept row has a
    # non-NULL key, so the anti-joins on the taken keys also drop it from ``work``
    both_null = F.col("_k1").isNull() & F.col("_k2").isNull()
    kept_parts: list[DataFrame] = [work.filter(both_null).select("_o", "_place")]
    work = work.filter(~both_null)
    rounds, before, slow = 0, work.count(), False
    while before:
        found, jumps = _followed(work) if slow else (_first_of_both(work), 0)
        rounds += 1 + max(0, jumps - 1)
        if max_rounds is not None and rounds > max_rounds:
            raise RuntimeError("two-key insert did not converge within max_rounds")
        kept = cut_lineage(found)
        kept_parts.append(kept.select("_o", "_place"))
        for key in ("_k1", "_k2"):
            work = anti(work, key, kept.select(key).filter(F.col(key).isNotNull()))
        work = cut_lineage(work)
        left = work.count()
        slow, before = 2 * left > before, left
    kept_all = kept_parts[0]
    for p in kept_parts[1:]:
        kept_all = kept_all.unionByName(p)
    log.info("two-key insert converged in %d rounds", rounds)
    return kept_all, rounds


# ---------------------------------------------------------------- groups
def add_groups(groups: DataFrame, new: DataFrame, ordinal: str = "ordinal"
               ) -> tuple[DataFrame, DataFrame]:
    """M5: add (group_name, group_url) rows; both unique; violations rejected.

    Returns (groups_after, rejected). New ids continue after the current max.
    """
    inserted, rejected, _ = insert_two_keys(groups, new, ["group_name"], ["group_url"], ordinal)
    return _append_groups(groups, inserted, ordinal), rejected


def _append_groups(groups: DataFrame, inserted: DataFrame, ordinal: str) -> DataFrame:
    # new ids continue after the current maximum: one scalar, read once
    base = groups.agg(F.coalesce(F.max("group_id"), F.lit(0))).first()[0]
    ided = with_ordinal(inserted, [ordinal], "_seq")
    new_rows = ided.select(
        (F.lit(int(base)) + F.col("_seq")).cast("bigint").alias("group_id"),
        "group_name", "group_url",
        F.lit(None).cast("timestamp_ntz").alias("last_scraped_at"))
    return groups.select(*new_rows.columns).unionByName(new_rows)


def get_or_create_groups(groups: DataFrame, urls: DataFrame, ordinal: str | None = None,
                         ) -> tuple[DataFrame, DataFrame]:
    """Resolve each (group_url, group_name?) to a group id, creating
    the missing groups (name defaults to ``Group from <url>``).

    Requests are taken in the order of ``ordinal`` (without one: of url and name): of a url's
    names the first given counts, and a new group is added only if its name is
    not taken yet, by a stored group or an earlier new one (both columns are unique).
    A request whose group could not be added keeps a NULL group_id.

    Returns (resolved rows with group_id, groups_after).
    """
    name = F.col("group_name") if "group_name" in urls.columns else F.lit(None).cast("string")
    order = F.col(ordinal) if ordinal else F.struct(F.col("group_url"), name)
    req = (urls.select("group_url", name.alias("group_name"), order.alias("ordinal"))
           .groupBy("group_url").agg(F.min_by("group_name", F.struct(F.col("group_name").isNull(), "ordinal"))
                                     .alias("group_name"), F.min("ordinal").alias("ordinal")))
    misses = req.join(groups.select("group_url"), "group_url", "left_anti").select(
        "group_url", generated_group_name(F.col("group_name"), F.col("group_url"))
        .alias("group_name"), "ordinal")
    inserted, _, _ = insert_two_keys(groups, misses, ["group_name"], ["group_url"], "ordinal")
    after = _append_groups(groups, inserted, "ordinal")
    resolved = urls.join(after.select("group_url", "group_id"), "group_url", "left")
    return resolved, after


def remove_groups(groups: DataFrame, posts: DataFrame, ids: DataFrame, cascade: bool = False,
                  comments: DataFrame | None = None) -> dict:
    """M7: remove groups by id. Without ``cascade`` a group that posts refer to is
    refused; unknown ids are reported. With ``cascade`` its posts and their
    comments go too.
    """
    req = ids.select(F.col("group_id").cast("bigint").alias("group_id")).distinct()
    known = req.join(groups.select("group_id"), "group_id", "left_semi")
    unknown = req.join(groups.select("group_id"), "group_id", "left_anti")
    # few distinct ids: a group of very many posts is no hot key of the join
    used = known.join(posts.select("group_id").distinct(), "group_id", "left_semi")
    if cascade:
        removed, refused = known, used.limit(0)
    else:
        removed, refused = known.join(used, "group_id", "left_anti"), used
    out = {"groups": groups.join(removed, "group_id", "left_anti"), "removed": removed,
           "refused": refused, "unknown": unknown}
    if cascade:
        gone_posts = posts.join(removed, "group_id", "left_semi")
        out["posts"] = posts.join(removed, "group_id", "left_anti")
        if comments is not None:
            out["comments"] = comments.join(gone_posts.select("internal_post_id"),
                                            "internal_post_id", "left_anti")
    return out


# ---------------------------------------------------------------- J9 / S6
def fk_quarantine(groups: DataFrame, posts: DataFrame, comments: DataFrame) -> dict:
    """Rows whose parent is missing go to quarantine instead of the table."""
    bad_posts = posts.join(groups.select("group_id"), "group_id", "left_anti")
    good_posts = posts.join(groups.select("group_id"), "group_id", "left_semi")
    pid = good_posts.select("internal_post_id")
    return {
        "posts": good_posts, "posts_quarantine": bad_posts,
        "comments": comments.join(pid, "internal_post_id", "left_semi"),
        "comments_quarantine": comments.join(pid, "internal_post_id", "left_anti"),
    }


def cap_per_group(df: DataFrame, group_cols: list[str], ordinal: str, n: int) -> DataFrame:
    """At most ``n`` rows per group, earliest by ordinal.

    ``row_number() <= n`` lets Spark insert a map-side group limit before the
    shuffle, so a huge group ships at most n rows per map task.
    """
    w = Window.partitionBy(*group_cols).orderBy(F.col(ordinal))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


# ---------------------------------------------------------------- records -> store
def _next_ids(existing: DataFrame, id_col: str, new: DataFrame, order_cols: list[str],
              out_col: str) -> DataFrame:
    """_place and a new surrogate id of each row of ``new``, continuing after the stored maximum, dense in ``order_cols`` order."""
    base = existing.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
    return cut_lineage(with_ordinal(new, order_cols, "_seq").select(
        "_place", (F.lit(int(base)) + F.col("_seq")).cast("bigint").alias(out_col)))


def _with_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The ``rows`` that have an id, with it. Where none has (a re-scrape), no row is read."""
    if ids.isEmpty():
        rows = rows.filter(F.lit(False))
    return rows.join(ids, "_place").drop("_place")


def resolve_post_ids(records: DataFrame, posts: DataFrame) -> DataFrame:
    """Q10: the stored post of each record — by external id, else by url."""
    by_ext = posts.filter(F.col("external_post_id").isNotNull()).select(
        "external_post_id", F.col("internal_post_id").alias("_by_ext"))
    by_url = posts.filter(F.col("post_url").isNotNull()).select(
        "post_url", F.col("internal_post_id").alias("_by_url"))
    return (records.join(by_ext, "external_post_id", "left").join(by_url, "post_url", "left")
            .withColumn("internal_post_id", F.coalesce("_by_ext", "_by_url"))
            .drop("_by_ext", "_by_url"))


def ingest_records(posts: DataFrame, comments: DataFrame, records: DataFrame,
                   group_id: int, ordinal: str = "page_id") -> dict:
    """ST1 body in batch form: extracted records -> posts (M1), comments.

    ``records`` carry ``external_post_id``, ``post_url``, post fields and nested
    ``comments`` (the extraction output). Posts are inserted first-wins on both
    unique keys; every record - inserted or already stored - is then resolved to
    its stored post (Q10) and its comments are inserted first-wins on the
    external comment id. New rows are written once, beside the stored ones.
    Returns the new table snapshots and the run counts.
    """
    from agora import schemas
    from agora.operators.extract import explode_comments
    from agora.sources.bindings import conform
    # whole records are written once, and read once for the posts and once for their comments; which of them go in,
    # under what ids, is found on keys and places alone
    rows = _stored(records.withColumn("group_id", F.lit(int(group_id)).cast("bigint")))
    recs = rows.drop("_b")
    kept = cut_lineage(_kept_of_two_keys(posts, rows, ["external_post_id"], ["post_url"], ordinal)[0])
    ids = _next_ids(posts, "internal_post_id", kept, ["_o"], "internal_post_id")
    new_posts = _with_ids(recs, ids).withColumn("is_processed_by_ai", F.lit(False)) \
        .withColumn("post_content_raw", F.col("content_text"))
    posts_after = posts.unionByName(landed(conform(new_posts, schemas.POSTS), "posts"))
    resolved = resolve_post_ids(recs.drop("group_id", "_place"), posts_after)
    cm = _stored(explode_comments(resolved, keep=("internal_post_id",))
                 .filter(F.col("internal_post_id").isNotNull())
                 .withColumn("_ord", F.struct(F.col("page_id"), F.col("pos"))))
    c_kept = cut_lineage(_kept_of_one_key(comments, cm, ["external_comment_id"], "_ord"))
    c_ids = _next_ids(comments, "comment_id", c_kept, ["a", "_b", "_place"], "comment_id")
    new_c = _with_ids(cm.drop("_b"), c_ids).withColumn("is_processed_by_ai_comment", F.lit(False))
    comments_after = comments.unionByName(landed(conform(new_c, schemas.COMMENTS), "comments"))
    ign = recs.join(kept.select("_place"), "_place", "left_anti").drop("_place")
    return {"posts": posts_after, "comments": comments_after, "inserted_posts": new_posts,
            "ignored_records": ign, "inserted_comments": new_c}
