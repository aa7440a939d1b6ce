"""The bindings of ``agora.sources.bindings`` written as SQL CTEs.

Used by the DuckDB oracles: every oracle query starts from the same driver
tables and derives the store tables exactly as the Spark bindings do.
"""

GROUP_URL_PREFIX = "https://groups.example.com/g/"

B1_GROUPS = f"""
b1_groups AS (
  SELECT CAST(n_nationkey AS BIGINT) AS group_id, n_name AS group_name,
         '{GROUP_URL_PREFIX}' || CAST(n_nationkey AS VARCHAR) AS group_url
  FROM nation)"""

B1_POSTS = f"""
b1_posts AS (
  SELECT o_orderkey AS internal_post_id,
         CAST(c_nationkey AS BIGINT) AS group_id,
         'op' || CAST(o_orderkey AS VARCHAR) AS external_post_id,
         '{GROUP_URL_PREFIX}' || CAST(c_nationkey AS VARCHAR) || '/posts/'
           || CAST(o_orderkey AS VARCHAR) AS post_url,
         o_orderpriority || ' order from the ' || c_mktsegment || ' segment' AS post_content_raw,
         c_name AS post_author_name,
         o_orderdate AS posted_at,
         o_orderdate AS scraped_at,
         CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS ai_category,
         CASE WHEN o_orderstatus <> 'P' THEN c_mktsegment END AS ai_sub_category,
         CASE WHEN o_orderstatus <> 'P' THEN o_totalprice > 400000.0 END AS ai_is_potential_idea,
         o_orderstatus <> 'P' AS is_processed_by_ai
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

B1_LINEITEM_FIRST = """
b1_li AS (
  SELECT * FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate, l_partkey, l_suppkey, l_linestatus) = 1)"""

B1_COMMENTS = B1_LINEITEM_FIRST + """,
b1_comments AS (
  SELECT l_orderkey * 10 + l_linenumber AS comment_id,
         l_orderkey AS internal_post_id,
         s_name AS commenter_name,
         p_name || ' (' || p_type || ')' AS comment_text,
         CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS external_comment_id,
         l_shipdate AS comment_scraped_at,
         l_shipdate AS commented_at,
         l_linestatus = 'F' AS is_processed_by_ai_comment
  FROM b1_li JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""

B1 = ",".join([B1_GROUPS, B1_POSTS, B1_COMMENTS])

B2_POSTS = """
b2_posts AS (
  SELECT d.doc_id AS internal_post_id,
         CAST(regexp_extract(d.source, '(\\d+)$', 1) AS BIGINT) AS group_id,
         d.text AS post_content_raw,
         d.lang AS post_author_name,
         d.source AS source,
         l.quality = 1 AS ai_is_potential_idea,
         l.quality IS NOT NULL AS is_processed_by_ai
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

B3 = """
b3_posts AS (
  SELECT conv_id AS internal_post_id, text AS post_content_raw, role AS post_author_name,
         TRUE AS is_processed_by_ai
  FROM conversations WHERE turn = 0),
b3_comments AS (
  SELECT conv_id * 100 + turn AS comment_id, conv_id AS internal_post_id,
         role AS commenter_name, text AS comment_text,
         make_timestamp(1970, 1, 1, 0, 0, CAST(turn AS DOUBLE)) AS comment_scraped_at
  FROM conversations WHERE turn > 0)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


def two_key_first_wins(base: str, key1: list[str], key2: list[str], out: str) -> str:
    """Recursive-CTE form of the two-unique-key first-wins insert.

    ``base`` is a SELECT giving column ``o`` (unique ordinal) and the key
    columns; rounds keep the rows earliest in both key groups and reject their
    neighbours until no row is undecided. NULL keys never collide.
    """
    k1, k2 = ", ".join(key1), ", ".join(key2)
    n1 = " OR ".join(f"{c} IS NULL" for c in key1)
    n2 = " OR ".join(f"{c} IS NULL" for c in key2)
    cols = ", ".join(["o"] + key1 + key2)
    return f"""
WITH RECURSIVE base AS ({base}),
it({cols}, st) AS (
  SELECT {cols}, 'u' FROM base
  UNION ALL
  SELECT {cols},
         CASE WHEN kept THEN 'k'
              WHEN (NOT ({n1}) AND bool_or(kept) OVER (PARTITION BY {k1}))
                OR (NOT ({n2}) AND bool_or(kept) OVER (PARTITION BY {k2})) THEN 'r'
              ELSE 'u' END
  FROM (SELECT *, (({n1}) OR o = min(o) OVER (PARTITION BY {k1}))
                  AND (({n2}) OR o = min(o) OVER (PARTITION BY {k2})) AS kept
        FROM it WHERE st = 'u') s),
kept AS (SELECT {cols} FROM it WHERE st = 'k')
{out}"""


def url_identity_sql(url: str, host: str, marker: str, key: str) -> dict[str, str]:
    """SQL twins of the permalink identity (X1-X3, F16) for DuckDB."""
    from agora import schemas
    auth = f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
    canon = f"nullif(regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*[^?#]*)', 1), '')"
    path = f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    query = f"regexp_extract({url}, '\\?([^#]*)', 1)"
    on_host = f"coalesce(strpos(lower({auth}), '{host.lower()}') > 0, FALSE)"
    cands = []
    for name in schemas.ID_PATH_SEGMENTS:
        seg = f"regexp_extract({path}, '^(?:[^/]*/)*?{name}/([^/]*)', 1)"
        cands.append(f"CASE WHEN regexp_matches({seg}, '^[a-zA-Z0-9._-]+$') THEN {seg} END")
    for k in schemas.ID_QUERY_KEYS:
        v = f"url_decode(regexp_extract({query}, '(?:^|&){k}=([^&]*)', 1))"
        cands.append(f"CASE WHEN trim({v}) <> '' THEN {v} END")
    cands.append(f"nullif(regexp_extract({path}, '/(\\d{{10,}})', 1), '')")
    post_url = f"CASE WHEN {on_host} THEN {canon} END"
    cand = f"(({on_host} AND {canon} IS NOT NULL) OR {marker})"
    rid = f"CASE WHEN {on_host} THEN coalesce({', '.join(cands)}) END"
    pid = (f"CASE WHEN {cand} THEN coalesce({rid}, 'generated_' || substr(sha256("
           f"coalesce({post_url}, CAST({key} AS VARCHAR))), 1, 12)) END")
    return {"post_url": post_url, "post_id": pid, "is_candidate": cand}
