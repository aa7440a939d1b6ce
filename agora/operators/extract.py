"""Page extraction: ``pages(page_id, url, html)`` -> posts with nested comments.

One Spark job. The structural rules (body text = direct children of the text
container minus button blocks, nested comment containers) run in a
``mapInArrow`` over the small tree helper; everything that is a flat rule or
a column formula stays JVM-side: permalink identity (E9), time parsing (X5),
validity (F14/F15), comment ids (X4), field selection (P2), the per-run cap
(S6) and the flattening into the comment table (E8).

Each field is an ordered list of selectors (comma lists allowed); the first element that yields a
non-empty value wins. The lists are parameters: ``schemas.ARTICLE_RULES`` for generic article pages,
``schemas.FEED_RULES`` for feed elements. They are compiled on the driver first, so a selector
that is not understood fails before the job runs, and all of them are found in one walk over a page.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora import schemas
from agora.functions import html, timeparse, urls
from agora.operators.ingest import cap_per_group
from agora.session import ship_package

DEFAULT_RULES = schemas.ARTICLE_RULES

ALL_FIELDS = ("post_author_profile_pic_url", "post_author_name", "content_text",
              "post_image_url", "posted_at", "comments")

COMMENT_STRUCT = ("array<struct<pos:int,commenter_profile_pic_url:string,commenter_name:string,"
                  "comment_text:string,href:string,data_comment_id:string,time_text:string>>")
RAW_SCHEMA = ("page_id bigint, url string, author_pic string, author_name string, "
              "content_text string, image_url string, time_text string, "
              "time_candidates array<string>, has_time_marker boolean, comments " + COMMENT_STRUCT)

_BG_URL = re.compile(r'background-image:\s*url\("?([^")]*)"?\)')


#: Tasks a core that CPU-heavy Python work is cut into, and pages that a task holds in Python at once.
TASKS, PAGES = 4, 256


def spread(df: DataFrame) -> DataFrame:
    """Deal CPU-heavy Python work evenly over every core, round-robin, into several tasks a core: an explicit count,
    which AQE does not coalesce (a shuffle of pages is small beside the work that they make). Asking the input
    for its partitions instead would run its joins and aggregations once more."""
    if df.isStreaming:          # micro-batches are sized by maxFilesPerTrigger
        return df
    return df.repartition(TASKS * df.sparkSession.sparkContext.defaultParallelism)


def compiled(rules: dict[str, list[str]]) -> tuple[html.Matcher, dict[str, list[list[int]]]]:
    """One matcher of all rules, and the numbers of each rule's selectors. Raises for one it can't read."""
    matcher = html.Matcher()
    return matcher, {name: [matcher.add(s) for s in sels] for name, sels in rules.items() if isinstance(sels, list)}


class _Reader:
    """Reads the fields of one page after another; made in the task, where the selectors are compiled once."""

    def __init__(self, rules: dict, fields: tuple):
        self.rules, self.want = rules, set(fields)
        self.matcher, self.numbers = compiled(rules)
        self.found = None
        self.matches = {}
        self.tags = {}

    def matched(self, rule):
        """What the rule's selectors match on this page, in their order, without those that match nothing: most of them."""
        found = self.matches.get(rule)
        if found is None:
            found = self.matches[rule] = [m for m in map(self.found.of, self.numbers[rule]) if m[0]]
        return found

    def first_match(self, node, rule):
        # rule cascade: the first element matching the first selector that matches
        for at, nodes in self.matched(rule):
            n = html.first_inside(at, nodes, node)
            if n is not None:
                return n
        return None

    def first_text(self, node, rule, sep=" "):
        # the first selector giving a non-empty text wins
        for at, nodes in self.matched(rule):
            n = html.first_inside(at, nodes, node)
            t = n.text(sep) if n is not None else ""
            if t:
                return t
        return None

    @staticmethod
    def image_of(n):
        if n is None:
            return None
        if n.tag == "image":
            return n.attrs.get("href") or n.attrs.get("xlink:href")
        if n.tag == "img":
            return n.attrs.get("src")
        m = _BG_URL.search(n.attrs.get("style", ""))
        return m.group(1) if m else None

    def body(self, root):
        cont = self.first_match(root, "text_container")
        text = None
        if cont is not None:
            parts = [e.text(" ") for e in cont.elements() if not html.has_button(e)]
            parts = [p for p in parts if p]
            text = "\n".join(parts) if parts else (cont.text(" ") or None)
        if not text:
            text = self.first_text(root, "generic_text")
        return text

    def time_of(self, node, rule):
        n = self.first_match(node, rule)
        if n is None:
            return None
        v = n.attrs.get("title") or n.attrs.get("datetime") or n.text(" ")
        return v or None

    def post_time(self, root):
        """E5 steps 1-2: attribute time, then the permalink's time text."""
        return self.time_of(root, "time") or self.first_text(root, "time_link_text", "")

    def time_candidates(self, root, author):
        """E5 step 3: title / aria-label (> 5 chars) / short text of candidate links,
        in page order; Spark keeps the first that parses."""
        out = []
        for a in self.found.every(sum(self.numbers["time_candidates"], []), root):
            for attr in ("title", "aria-label"):
                v = a.attrs.get(attr)
                if v and len(v) > 5:
                    out.append(v)
            t = a.text("")
            low = t.lower()
            if 2 < len(t) < 30 and low != (author or "").lower() and "comment" not in low:
                out.append(t)
        return out

    def comment_time(self, c):
        """The time element's, else the label or text of the comment's own link."""
        n = self.first_match(c, "comment_time_link")
        return self.time_of(c, "comment_time") or (n.attrs.get("aria-label") or n.text("") or None if n is not None else None)

    def comment_text(self, c):
        """The text element's, else of the container that stands in for it, else (where asked) all of the comment."""
        text = self.first_text(c, "comment_text")
        box = self.first_match(c, "comment_text_container") if text is None else None
        if box is not None:
            text = self.first_text(box, "comment_text_inside") or box.text(" ") or None
        return text or (c.text(" ") or None if self.rules["comment_text_whole"] else None)

    def comments(self, root):
        out = []
        for i, c in enumerate(self.found.every(sum(self.numbers["comment"], []), root)):
            link = self.first_match(c, "comment_id_link") or self.first_match(c, "comment_any_link")
            out.append({
                "pos": i,
                "commenter_profile_pic_url": self.image_of(self.first_match(c, "comment_pic")),
                "commenter_name": self.first_text(c, "comment_name"),
                "comment_text": self.comment_text(c),
                "href": link.attrs.get("href") if link is not None else None,
                "data_comment_id": c.attrs.get("data-commentid"),
                "time_text": self.comment_time(c),
            })
        return out

    def one(self, page):
        root = html.parse(page, self.tags)
        self.found, self.matches = self.matcher.walk(root), {}
        author = self.first_text(root, "author_name")
        tt = self.post_time(root) if "posted_at" in self.want else None
        record = {
            "author_pic": self.image_of(self.first_match(root, "author_pic"))
            if "post_author_profile_pic_url" in self.want else None,
            "author_name": author if "post_author_name" in self.want else None,
            "content_text": self.body(root) if "content_text" in self.want else None,
            "image_url": self.image_of(self.first_match(root, "image"))
            if "post_image_url" in self.want else None,
            "time_text": tt,
            "time_candidates": self.time_candidates(root, author)
            if "posted_at" in self.want and tt is None else [],
            "has_time_marker": self.first_match(root, "time_marker") is not None,
            "comments": self.comments(root) if "comments" in self.want else [],
        }
        html.release(root)
        return record


def _arrow_fn(rules: dict, fields: tuple):
    """Pages to records, column by column: nested comments made row by row would cost as much as reading them."""
    def fn(batches):
        import pyarrow as pa
        text = pa.string()
        comment = {"pos": pa.int32(), **dict.fromkeys(("commenter_profile_pic_url", "commenter_name", "comment_text", "href",
                                                       "data_comment_id", "time_text"), text)}
        types = {"author_pic": text, "author_name": text, "content_text": text, "image_url": text, "time_text": text,
                 "time_candidates": pa.list_(text), "has_time_marker": pa.bool_()}
        reader = _Reader(rules, fields)
        for part in (b.slice(i, PAGES) for b in batches for i in range(0, b.num_rows, PAGES)):
            rows = [reader.one(h) for h in part.column("html").to_pylist()]
            flat, ends = [], [0]
            for r in rows:
                flat += r["comments"]
                ends.append(len(flat))
            comments = pa.StructArray.from_arrays([pa.array([c[n] for c in flat], t) for n, t in comment.items()], list(comment))
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id").cast(pa.int64()), part.column("url").cast(text),
                 *[pa.array([r[n] for r in rows], t) for n, t in types.items()],
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), comments)],
                ["page_id", "url", *types, "comments"])
    return fn


def _rules_fn(rules: dict, fields: tuple):
    """``_arrow_fn`` on pandas frames."""
    def fn(frames):
        import pyarrow as pa
        for batch in _arrow_fn(rules, fields)(pa.RecordBatch.from_pandas(f) for f in frames):
            yield batch.to_pandas()
    return fn


def _time_of(base: Column) -> Column:
    """The time text and its instant: the direct text, parsed or not, else the first candidate that parses."""
    direct = F.col("time_text")
    tried = F.transform(F.when(direct.isNotNull(), F.array(direct)).otherwise(F.col("time_candidates")),
                        lambda c: F.struct(c.alias("text"), timeparse.parse_time_text(c, base).alias("ts")))
    return timeparse.bind(tried, lambda a: F.coalesce(
        F.try_element_at(F.filter(a, lambda t: t["ts"].isNotNull()), F.lit(1)),
        F.when(direct.isNotNull(), F.try_element_at(a, F.lit(1)))))


def extract_pages(pages: DataFrame, host: str, base_ts: Column | None = None,
                  fields: tuple | None = None, rules: dict | None = None,
                  cap: int | None = None, cap_group: str | None = None) -> DataFrame:
    """One row per valid record, comments nested.

    ``base_ts`` is the scrape time relative time text is read against
    (default: the job's current timestamp). ``cap`` keeps at most that many
    valid records per ``cap_group`` (or overall per host) in page order.
    """
    ship_package(pages.sparkSession)
    rules = {**DEFAULT_RULES, **(rules or {})}
    compiled(rules)  # fails here, not in a task
    fields = tuple(fields) if fields else ALL_FIELDS
    src = spread(pages.select("page_id", "url", "html"))
    raw = src.mapInArrow(_arrow_fn(rules, fields), RAW_SCHEMA)
    base = base_ts if base_ts is not None else F.localtimestamp()
    seen = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("author_name", "content_text", "time_text")])
    ident = urls.post_identity(F.col("url"), host, F.col("has_time_marker"), seen)
    if "posted_at" in fields:
        # E5: direct time text, else the first candidate that parses (X5, JVM-side). The parse stands once
        # in the plan: a generator's output is not copied into the filters above it
        raw = raw.select("*", F.explode(F.array(_time_of(base))).alias("_time"))
    else:
        raw = raw.withColumn("_time", F.lit(None).cast("struct<text:string,ts:timestamp_ntz>"))
    posts = raw.select(
        "page_id", ident["post_url"].alias("post_url"), ident["post_id"].alias("external_post_id"),
        F.col("author_pic").alias("post_author_profile_pic_url"),
        F.col("author_name").alias("post_author_name"),
        F.col("content_text"),
        F.col("image_url").alias("post_image_url"),
        F.col("_time.text").alias("time_text"), F.col("_time.ts").alias("posted_at"),
        F.filter("comments", lambda c: (F.coalesce(c["commenter_name"], F.lit("")) != "")
                 | (F.coalesce(c["comment_text"], F.lit("")) != "")).alias("comments"),  # F15
        base.alias("scraped_at"),
    )
    valid = ((F.col("post_url").isNotNull() | F.col("external_post_id").isNotNull())
             & (F.col("content_text").isNotNull() | F.col("posted_at").isNotNull()
                | F.col("post_author_name").isNotNull()))                                # F14
    posts = posts.filter(valid)
    if cap is not None:
        grp = cap_group or "_host"
        if cap_group is None:
            posts = posts.withColumn("_host", F.try_parse_url("post_url", F.lit("HOST")))
        posts = cap_per_group(posts, [grp], "page_id", cap)
        if cap_group is None:
            posts = posts.drop("_host")
    keep = ["page_id", "post_url", "external_post_id", "scraped_at"] + [
        c for c in ("post_author_profile_pic_url", "post_author_name", "content_text",
                    "post_image_url", "time_text", "posted_at", "comments")
        if c in fields or (c == "time_text" and "posted_at" in fields)]
    return posts.select(*keep)


def explode_comments(posts: DataFrame, base_ts: Column | None = None,
                     keep: tuple[str, ...] = ()) -> DataFrame:
    """Nested comments -> comment rows, with the X4 id cascade and X5 time.
    ``keep`` names record columns carried onto every comment row."""
    base = base_ts if base_ts is not None else F.col("scraped_at")
    e = posts.select("page_id", "external_post_id", "scraped_at", *keep,
                     F.explode("comments").alias("c"))
    return e.select(
        "page_id", "external_post_id", *keep,
        F.col("c.pos").alias("pos"),
        F.col("c.commenter_name").alias("commenter_name"),
        F.col("c.commenter_profile_pic_url").alias("commenter_profile_pic_url"),
        F.col("c.comment_text").alias("comment_text"),
        urls.comment_id_from(F.col("c.href"), F.col("c.data_comment_id"),
                             *[F.coalesce(c, F.lit("")) for c in ("c.commenter_name", "c.comment_text",
                                                                  "c.time_text", "external_post_id")])
        .alias("external_comment_id"),
        timeparse.parse_time_text(F.col("c.time_text"), base).alias("commented_at"),
        F.col("scraped_at").alias("comment_scraped_at"),
    )


# ---------------------------------------------------------------- flat rules
def unescape(c: Column) -> Column:
    """The five XML entities (``&amp;`` last so nothing is unescaped twice)."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", ""), r"^\s+|\s+$", "")


def extract_items(pages: DataFrame) -> DataFrame:
    """Flat E6 rule, JVM-side: every ``<li>`` of a page with its link and text."""
    items = pages.select("page_id", F.posexplode(
        F.regexp_extract_all("html", F.lit(r"(?s)<li[^>]*>(.*?)</li>"), 1)).alias("pos", "item"))
    return items.select(
        "page_id", "pos",
        F.nullif(F.regexp_extract("item", r'<a[^>]*href="([^"]*)"', 1), F.lit("")).alias("href"),
        unescape(strip_tags(F.regexp_extract("item", r"(?s)<a[^>]*>(.*?)</a>", 1))).alias("name"),
        unescape(strip_tags(F.col("item"))).alias("text"))


def page_titles(pages: DataFrame) -> DataFrame:
    """Flat E2 rule, JVM-side: first ``<h1>`` text, else ``<title>`` text."""
    h1 = unescape(strip_tags(F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1)))
    title = unescape(strip_tags(F.regexp_extract("html", r"(?s)<title[^>]*>(.*?)</title>", 1)))
    return pages.select("page_id", F.coalesce(F.nullif(h1, F.lit("")), F.nullif(title, F.lit("")))
                        .alias("post_author_name"))
