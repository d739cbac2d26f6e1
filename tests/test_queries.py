"""Registered queries against their SQL at the smallest scale.

The whole registry is compared by ``tools/compare.py``; the suite keeps one query per family.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "normalize_articles", "corroborate", "filter_events", "briefing_windows", "html_to_text", "trail_fold", "point_in_polygon",
    "source_revisions", "geo_audit", "related_events", "entity_mentions", "detail_violations",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, duck, name):
    frame = entry.queries()[name](spark, SF)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(columns, result.fetchall())


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 120
