"""Fixity audit of web archives with Merkle trees.

``records`` lays pages out as WARC/1.1 records in archive files. An audit hashes every record of a
replica (place, length and SHA-256 of its bytes), then ordered ranges of offsets: the nodes of a
level cover equal stretches of the address space, ``FANOUT_BITS`` bits of it each, and hash their
children in order. Two replicas are compared from the root; only children of nodes that
differ are looked at, down to the records.

All of it is DataFrame operations: a node has ``2 ** FANOUT_BITS`` children at most, records of a
lowest range are few (it has 64 KiB), and nothing is gathered beyond that.

Results of ``audit``: one row per damaged record with its file, start, length (in the first replica,
else the second) and kind: ``missing`` or ``extra`` (only in the first, the second), ``resized``, ``altered``. Records
at one place of a file count as one, their digests in order. Replicas that agree, and empty ones, give
no rows. Null urls and bodies are empty; a null page_id goes to a file of its own. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.llm.common import fix_split, materialize, table

#: Pages (ids) of an archive file, and the bits of an offset in a file.
FILE_PAGES = 1000
OFFSET_BITS = 36
#: Bits of address that the ranges of each level drop, from 64 KiB to everything.
LEVELS = (16, 24, 32, 40, 48, 56, 63)
CRLF = "\r\n"


def _header(url: Column, page_id: Column, size: Column) -> Column:
    lines = [F.lit("WARC/1.1"), F.lit("WARC-Type: resource"), F.concat(F.lit("WARC-Target-URI: "), url),
             F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
             F.concat(F.lit("WARC-Record-ID: <urn:sha256:"), F.sha2(F.concat(
                 url, F.lit("|"), F.coalesce(page_id.cast("string"), F.lit(""))).cast("binary"), 256), F.lit(">")),
             F.lit("Content-Type: text/html"), F.concat(F.lit("Content-Length: "), size)]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2))


def records(pages: DataFrame) -> DataFrame:
    """file, start, length, page_id, record (the bytes as a string): the pages in order of their ids (then url and
    html), ``FILE_PAGES`` ids to a file."""
    fix_split(pages.sparkSession)
    empty = F.lit("")
    rows = pages.select("page_id", F.coalesce("url", empty).alias("url"), F.coalesce("html", empty).alias("html"))
    record = F.concat(_header(F.col("url"), F.col("page_id"), F.octet_length("html").cast("string")),
                      F.col("html"), F.lit(CRLF * 2))
    file = F.coalesce(F.floor(F.col("page_id") / FILE_PAGES) + 1, F.lit(0)).cast("long")
    sized = rows.select("page_id", file.alias("file"), record.alias("record"), F.monotonically_increasing_id().alias("_row"))
    # offsets are running sums over narrow rows; the records join them
    narrow = sized.select("_row", "file", "page_id", F.octet_length("record").cast("long").alias("length"),
                          F.xxhash64("record").alias("tie"))
    before = Window.partitionBy("file").orderBy("page_id", "tie", "_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = narrow.select("_row", "length", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("start"))
    return sized.join(placed, "_row").select("file", "start", "length", "page_id", "record")


def write_archive(found: DataFrame, path: str) -> None:
    """The records as WARC files, one for each archive file number's partition."""
    body = F.expr(f"substring(record, 1, length(record) - {len(CRLF * 2)})")
    (found.repartition("file").sortWithinPartitions("file", "start").select(body.alias("value"))
     .write.option("lineSep", CRLF * 2).text(path))


def leaves(found: DataFrame) -> DataFrame:
    """address, length, page_id, hash of each record: what a replica's tree is built on."""
    address = F.shiftleft(F.col("file"), OFFSET_BITS).bitwiseOR(F.col("start"))
    each = found.select(address.alias("address"), F.octet_length("record").cast("long").alias("length"), "page_id",
                        F.sha2(F.col("record").cast("binary"), 256).alias("digest"))
    same = each.groupBy("address").agg(
        F.sum("length").alias("length"), F.min("page_id").alias("page_id"),
        F.array_join(F.sort_array(F.collect_list("digest")), "").alias("digest"))
    return same.withColumn("hash", F.sha2(F.concat_ws("|", "address", "length", "digest").cast("binary"), 256))


def _level(below: DataFrame, key: str, bits: int) -> DataFrame:
    """Nodes that cover ranges of ``bits`` bits, from the nodes (or records) below."""
    child = F.struct(F.col(key).alias("at"), "hash")
    return (below.groupBy("replica", F.shiftright(F.col("address"), bits).alias("node"))
            .agg(F.min("address").alias("address"), F.sort_array(F.collect_list(child)).alias("children"))
            .select("replica", "node", "address", F.sha2(F.array_join(F.transform(
                "children", lambda c: F.concat_ws("|", c["at"], c["hash"])), "|").cast("binary"), 256).alias("hash")))


def _differing(nodes: DataFrame, key: str) -> DataFrame:
    """Keys whose hashes are not the same in both replicas."""
    return (nodes.groupBy(key).agg(F.count("*").alias("n"), F.min("hash").alias("a"), F.max("hash").alias("b"))
            .where("n < 2 OR a <> b").select(key))


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """Compare two replicas given as ``records``; see above for the result."""
    both = leaves(first).withColumn("replica", F.lit(1)).unionByName(leaves(second).withColumn("replica", F.lit(2)))
    both = materialize(both, "fixity")
    levels, below, key = [], both, "address"
    for bits in LEVELS:
        below = materialize(_level(below, key, bits), "fixity")
        levels.append(below)
        key = "node"
    differ = _differing(levels[-1], "node")
    for bits, nodes in zip(LEVELS[:0:-1], levels[-2::-1]):  # from the root to the lowest ranges
        inside = nodes.join(differ.select(F.col("node").alias("up")),
                            F.shiftright(F.col("address"), bits) == F.col("up"), "left_semi")
        differ = _differing(inside, "node")
    suspect = both.join(differ, F.shiftright("address", LEVELS[0]) == F.col("node"), "left_semi")
    of = lambda n, c: F.max(F.when(F.col("replica") == n, F.col(c)))
    pairs = suspect.groupBy("address").agg(*[of(n, c).alias(f"{c}{n}") for n in (1, 2)
                                             for c in ("hash", "length", "page_id")])
    kind = (F.when(F.col("hash2").isNull(), "missing").when(F.col("hash1").isNull(), "extra")
            .when(F.col("length1") != F.col("length2"), "resized").otherwise("altered"))
    return (pairs.where("NOT (hash1 <=> hash2)")
            .select(F.shiftright("address", OFFSET_BITS).alias("file"),
                    F.col("address").bitwiseAND(F.lit((1 << OFFSET_BITS) - 1)).alias("start"),
                    F.coalesce("length1", "length2").alias("length"),
                    F.coalesce("page_id1", "page_id2").alias("page_id"), kind.alias("kind")))


def damaged(found: DataFrame) -> DataFrame:
    """A second replica with damage of known places: by page_id, some records are lost, some have a
    byte changed, some a byte too many."""
    pid = F.col("page_id")
    altered = F.concat(F.expr(f"substring(record, 1, length(record) - {len(CRLF * 2)})"), F.lit(CRLF + "\r!"))
    return (found.where(F.coalesce(pid % 211 != 5, F.lit(True)))
            .withColumn("record", F.when(pid % 101 == 7, altered)
                        .when(pid % 307 == 3, F.concat("record", F.lit("!"))).otherwise(F.col("record"))))


def audited(spark, sf_dir: str) -> DataFrame:
    """Lay out the pages, damage a replica, and find the damage by comparing trees."""
    whole = records(table(spark, sf_dir, "pages"))
    return audit(whole, damaged(whole))


ORACLE = f"""
WITH sized AS (
  SELECT page_id, floor(page_id / {FILE_PAGES})::BIGINT + 1 AS file,
    {sum(len(x) for x in ("WARC/1.1", "WARC-Type: resource", "WARC-Target-URI: ", "WARC-Date: 1970-01-01T00:00:00Z",
                          "WARC-Record-ID: <urn:sha256:>", "Content-Type: text/html", "Content-Length: "))}
      + 64 + {2 * 10} + strlen(coalesce(url, '')) + length(strlen(coalesce(html, ''))::VARCHAR)
      + strlen(coalesce(html, '')) AS length
  FROM pages),
placed AS (
  SELECT *, coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sized)
SELECT file, start, length::BIGINT AS length, page_id,
  CASE WHEN page_id % 211 = 5 THEN 'missing' WHEN page_id % 101 = 7 THEN 'altered' ELSE 'resized' END AS kind
FROM placed WHERE page_id % 211 = 5 OR page_id % 101 = 7 OR page_id % 307 = 3"""
