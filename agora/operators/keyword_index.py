"""Keyword search at scale (F6-F8): a posting table of trigrams that prunes posts and comments by id.

``build`` stores, for every distinct three letters (lower case) of a post's text or a comment's, the texts they
stand in, in parts by a hash of the trigram, sorted by it. The texts of one batch of rows are a segment: its ids are
stored once, in a part of their own, and a row of a trigram holds the texts' places in the segment as steps of a
byte or two, so that what is shuffled, sorted and written is about a byte a posting and few rows. A keyword is looked
up by its trigrams: Spark reads the parts and row groups that may hold them, and a text that lacks one of them can't
contain the keyword. The search itself (``search.search_posts``) then runs on the posts left and their comments,
with its ``ilike`` on the texts, so the rows are the same. A keyword of fewer than three letters, or with a live
wildcard, has no trigram to look for and is searched without the index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.functions.text import has_wildcard
from agora.operators import search
from agora.session import ship_package

GRAM = 3
PARTS = 256
#: Letters of a text that cross into Python as one row, and letters that are sorted at once there.
PIECE, LETTERS = 4096, 2_000_000
#: A row of a trigram has no ids; the one row of a segment's ids has no trigram.
PACKED = "segment long, gram string, places binary, post_ids binary, comment_ids binary"
POSTING = "post_id long, comment_id long, gram string"
#: Part of the rows that hold ids.
IDS = -1
#: Spark's own setting that frees a query's shuffle files when it ends.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _grams(text: Column) -> Column:
    """The different trigrams of a lower-case text. Pieces of about the root of its length keep the places that
    substrings are counted from near."""
    step = F.greatest(F.lit(64), F.ceil(F.sqrt(F.length(text)))).cast("int")
    pieces = F.transform(F.sequence(F.lit(1), F.length(text), step), lambda i: F.substring(text, i, step + GRAM - 1))
    grams = F.transform(pieces, lambda p: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(p) - GRAM + 1)),
                                                      lambda i: F.substring(p, i, F.lit(GRAM))))
    return F.filter(F.array_distinct(F.flatten(grams)), lambda g: F.length(g) == GRAM)


def _blocks(batch):
    """(first, last) rows of a batch with some letters together, and the code points and row ends of all of it."""
    import numpy as np
    column = batch.column("letters")
    ends = np.frombuffer(column.buffers()[1], np.int64 if str(column.type).startswith("large") else np.int32)
    ends = ends[column.offset:column.offset + len(column) + 1]
    points = np.frombuffer(column.buffers()[2], ">u4")[ends[0] // 4:ends[-1] // 4]
    ends = (ends - ends[0]).astype(np.int64) // 4
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + LETTERS, "right")) - 1)
        yield at, to, points[ends[at]:ends[to]].astype(np.int64), np.diff(ends[at:to + 1])
        at = to


def _varints(values):
    """Numbers (uint64) in base 128, the lowest digit first and 128 more on all but the last, and the bytes of each."""
    import numpy as np
    top, sizes = int(values.max(initial=0)), np.ones(len(values), np.int64)
    for k in range(7, top.bit_length(), 7):
        sizes += values >= np.uint64(1 << k)
    starts = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        on = np.flatnonzero(sizes > k)
        digit = (values[on] >> np.uint64(7 * k)) & np.uint64(127)
        out[starts[on] + k] = digit.astype(np.uint8) | ((sizes[on] > k + 1) * np.uint8(128))
    return out, sizes


def _numbers(data: bytes):
    """What ``_varints`` wrote."""
    import numpy as np
    digits = np.frombuffer(data, np.uint8)
    starts = np.flatnonzero(np.append(True, digits[:-1] < 128)[:len(digits)])
    place = np.arange(len(digits)) - np.repeat(starts, np.diff(np.append(starts, len(digits))))
    parts = (digits & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.bitwise_or.reduceat(parts, starts) if len(digits) else parts


def _ids_bytes(column) -> bytes:
    """A column of ids: how many are null, the steps between the places of those, and the steps between the others."""
    import numpy as np
    nulls = np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False))
    steps = np.diff(column.drop_null().to_numpy(), prepend=0)
    signed = (steps << 1) ^ (steps >> 63)  # small either way
    return _varints(np.concatenate([[len(nulls)], np.diff(nulls, prepend=0), signed]).astype(np.int64).view(np.uint64))[0].tobytes()


def _ids(data: bytes):
    """Ids that ``_ids_bytes`` wrote (0 for null), and which are not null."""
    import numpy as np
    numbers = _numbers(data)
    n = int(numbers[0])
    known = np.ones(len(numbers) - 1, bool)
    known[np.cumsum(numbers[1:n + 1].astype(np.int64))] = False
    signed, ids = numbers[n + 1:], np.zeros(len(known), np.int64)
    ids[known] = np.cumsum((signed >> np.uint64(1)).astype(np.int64) ^ -(signed & np.uint64(1)).astype(np.int64))
    return ids, known


def _pack(batches):
    """Rows of a text's code points (``post_id``, ``comment_id``, ``letters``: UTF-32) to rows of ``PACKED``. A segment
    is named by a hash of what it holds, so that it has the same name when a task is run again."""
    import hashlib

    import numpy as np
    import pyarrow as pa
    for batch in (b for b in batches if b.num_rows):
        for first, last, points, lengths in _blocks(batch):
            if len(points) < GRAM:
                continue
            row = np.repeat(np.arange(last - first), lengths)
            seen = np.zeros(points.max() + 1, bool)
            seen[points] = True
            known, number = np.flatnonzero(seen), (np.cumsum(seen) - 1)[points]
            size = len(known)
            gram = (number[:-2] * size + number[1:-1]) * size + number[2:]
            inside = row[:-2] == row[2:]  # a trigram of one text
            gram, row = gram[inside], row[:-2][inside]
            # few different letters make small numbers, which sort without comparisons
            order = np.argsort(gram.astype(np.uint16) if size ** GRAM <= 1 << 16 else gram, kind="stable")
            gram, row = gram[order], row[order]
            new = np.ones(len(gram), bool)
            new[1:] = gram[1:] != gram[:-1]
            once = new.copy()
            once[1:] |= row[1:] != row[:-1]
            starts, found, place = np.flatnonzero(new[once]), gram[new], row[once]
            steps = np.diff(place, prepend=0)
            steps[starts] = place[starts]
            steps, sizes = _varints(steps.astype(np.uint64))
            ends = np.append(0, np.cumsum(sizes))[np.append(starts, len(place))].astype(np.int32)
            places = pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(ends), pa.py_buffer(steps)])
            text = known[np.stack([found // size ** 2, found // size % size, found % size], 1)].astype("<u4").tobytes().decode(
                "utf-32-le", "surrogatepass")
            ids = [_ids_bytes(batch.column(c).slice(first, last - first)) for c in ("post_id", "comment_id")]
            name = hashlib.blake2b(b"".join([*ids, lengths.tobytes(), points.tobytes()]), digest_size=8).digest()
            rest = pa.nulls(len(found), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(1 + len(found), int.from_bytes(name, "little", signed=True))),
                 pa.array([None, *(text[i:i + GRAM] for i in range(0, len(text), GRAM))], pa.string()),
                 pa.concat_arrays([pa.nulls(1, pa.binary()), places]),
                 *(pa.concat_arrays([pa.array([i], pa.binary()), rest]) for i in ids)],
                ["segment", "gram", "places", "post_ids", "comment_ids"])


def _unpack(wanted: list[str] | None):
    """Segments' ids and trigrams (``post_ids``, ``comment_ids``, ``hits``) to rows of ``POSTING``. With ``wanted``, a
    text that has all of these trigrams is a row without one (and of its post alone), and of the others only the first
    and the last text count, as pieces of a long one may go on in another segment."""
    def rows(segment):
        import numpy as np
        (posts, post), (comments, comment) = _ids(segment["post_ids"]), _ids(segment["comment_ids"])
        places = [np.cumsum(_numbers(h["places"]).astype(np.int64)) for h in segment["hits"]]
        grams = [h["gram"] for h in segment["hits"]]
        if wanted is not None:
            new = np.ones(len(posts), bool)  # rows of one text have the same ids and stand together
            new[1:] = False
            for c in (posts, post, comments, comment):
                new[1:] |= c[1:] != c[:-1]
            text, starts = np.cumsum(new) - 1, np.flatnonzero(new)
            has = np.zeros((len(wanted), len(starts)), bool)
            for gram, at in zip(grams, places):
                has[wanted.index(gram), text[at]] = True
            whole = has.all(0)
            edges = sorted({0, len(starts) - 1} - set(np.flatnonzero(whole).tolist()))
            found = starts[whole]
            found = found[np.append(True, (posts[found][1:] != posts[found][:-1]) | (post[found][1:] != post[found][:-1]))[:len(found)]]
            comment = comment.copy()
            comment[found] = False
            grams, places = [None, *wanted], [found, *(starts[[e for e in edges if has[k, e]]] for k in range(len(wanted)))]
        at = np.concatenate([np.zeros(0, np.int64), *places])
        return posts[at], post[at], comments[at], comment[at], [g for g, p in zip(grams, places) for _ in range(len(p))]

    def unpack(batches):
        import pyarrow as pa
        for batch in batches:
            for k in range(batch.num_rows):
                posts, post, comments, comment, grams = rows(batch.slice(k, 1).to_pylist()[0])
                yield pa.RecordBatch.from_arrays([pa.array(posts, mask=~post), pa.array(comments, mask=~comment),
                                                  pa.array(grams, pa.string())], ["post_id", "comment_id", "gram"])
    return unpack


def packed(rows: DataFrame, text: str, post: str, comment: str | None) -> DataFrame:
    """``PACKED`` and ``part``: the texts of a batch of rows by trigram. A long text goes in pieces that overlap. In
    order, texts make the same segments whenever a task is run, and their ids go in small steps."""
    ship_package(rows.sparkSession)
    low = F.lower(F.col(text))
    pieces = F.transform(F.sequence(F.lit(1), F.length("low"), F.lit(PIECE)),
                         lambda i: F.substring(F.col("low"), i, F.lit(PIECE + GRAM - 1)))
    ids = rows.where(F.length(text) >= GRAM).select(
        F.col(post).cast("long").alias("post_id"), (F.col(comment) if comment else F.lit(None)).cast("long").alias("comment_id"),
        low.alias("low")).sortWithinPartitions("post_id", "comment_id", "low")
    cut = ids.select("post_id", "comment_id", F.explode(F.when(F.length("low") <= PIECE, F.array("low")).otherwise(pieces)).alias("piece"))
    return (cut.select("post_id", "comment_id", F.encode("piece", "UTF-32").alias("letters")).mapInArrow(_pack, PACKED)
            .withColumn("part", F.when(F.col("gram").isNull(), IDS).otherwise(F.pmod(F.xxhash64("gram"), F.lit(PARTS)).cast("int"))))


def _each(texts: DataFrame, hits: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """``POSTING``: a row for each text that a trigram of ``hits`` stands in, or as ``_unpack`` says. ``texts`` has the
    segments' ids."""
    hits = hits.groupBy("segment").agg(F.collect_list(F.struct("gram", "places")).alias("hits"))
    return texts.select("segment", "post_ids", "comment_ids").join(hits, "segment").drop("segment").mapInArrow(_unpack(wanted), POSTING)


def postings(rows: DataFrame, text: str, post: str, comment: str | None) -> DataFrame:
    """post_id, comment_id, gram: one row a posting."""
    lists = packed(rows, text, post, comment)
    return _each(lists.where(F.col("part") == IDS), lists.where(F.col("part") != IDS))


def build(posts: DataFrame, comments: DataFrame, path: str) -> str:
    """Write the posting table. The rebalance cuts the postings of a frequent trigram into several files. What the input
    was shuffled for is freed when they are written, before a search shuffles it again."""
    spark = posts.sparkSession
    rows = packed(posts, "post_content_raw", "internal_post_id", None).unionByName(
        packed(comments, "comment_text", "internal_post_id", "comment_id"))
    before = spark.conf.get(_FREE)
    spark.conf.set(_FREE, "true")
    try:
        (rows.hint("rebalance", "part").sortWithinPartitions("part", "gram", "segment").write.partitionBy("part")
         .option("compression", "zstd").parquet(path))
    finally:
        spark.conf.set(_FREE, before)
    return path


def usable(keyword: str | None) -> bool:
    return bool(keyword) and len(keyword) >= GRAM and not has_wildcard(keyword)


def candidates(spark: SparkSession, path: str, keyword: str) -> DataFrame:
    """internal_post_id of every post that may contain the keyword, in its text or in one comment."""
    # one row, a trigram a letter of the keyword at most
    asked = spark.range(1).select(F.explode(_grams(F.lower(F.lit(keyword)))).alias("gram")).select(
        "gram", F.pmod(F.xxhash64("gram"), F.lit(PARTS)).cast("int").alias("part")).collect()
    wanted, parts = sorted(r["gram"] for r in asked), sorted({r["part"] for r in asked})
    rows = spark.read.schema(f"{PACKED}, part int").parquet(path)
    hits = _each(rows.where(F.col("part") == IDS), rows.where(F.col("part").isin(parts) & F.col("gram").isin(wanted)), wanted)
    # a trigram may stand in several pieces of a long text
    return (hits.groupBy("post_id", "comment_id").agg(F.count_distinct("gram").alias("n"), F.bool_or(F.col("gram").isNull()).alias("whole"))
            .where(F.col("whole") | (F.col("n") >= len(wanted))).select(F.col("post_id").alias("internal_post_id")).distinct())


def search_posts(path: str, posts: DataFrame, comments: DataFrame, *, keyword=None, **filters) -> DataFrame:
    """``search.search_posts`` with the postings at ``path``."""
    if usable(keyword):
        ids = candidates(posts.sparkSession, path, keyword)
        posts = posts.join(ids, "internal_post_id", "left_semi")
        comments = comments.join(ids, "internal_post_id", "left_semi")
    return search.search_posts(posts, comments, keyword=keyword, **filters)
