"""Every registered query against its DuckDB oracle (the driver's check) at sf0.001."""

import pytest

from __spark_entry__ import oracle_sql, queries
from tests.conftest import SMALL
from tests.oracle_compare import compare

NAMES = sorted(queries())


def test_every_query_has_a_callable():
    assert NAMES and all(callable(queries()[n]) for n in NAMES)


def test_oracles_only_for_registered_queries():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck_small, name):
    res = compare(spark, name, SMALL, duck_small)
    if res.get("oracle") == "none":
        assert res["spark_rows"] >= 0
    else:
        assert res["cols_match"], res
        assert res["match"], res


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    rows = df.collect()
    assert df.columns == ["internal_post_id", "post_author_name", "posted_at", "ai_category",
                          "post_content_raw", "comment_count"]
    assert all(r["comment_count"] >= 1 and r["ai_category"] == "1-URGENT" for r in rows)
