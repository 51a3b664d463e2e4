"""Queries against their DuckDB SQL on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from lapforge.plans.core import CORE
from lapforge.plans.ingest import INGEST
from lapforge.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The others take long to plan; they are compared with their SQL outside the tests as well.
MORE = ["compare_laps", "compare_laps_segments", "strategy_summary", "standings", "narrative_facts", "race_control_incidents", "analyze_pit_stops", "classify_laps", "decision_waterfall", "primary_category_audit", "shape_examples", "threshold_sensitivity", "threshold_borderline_laps", "compare_laps_by_distance", "compare_laps_story", "winner_report", "surface_flags", "coverage_summary", "replay_watchlist", "product_readiness", "quality_windows", "context_timeline", "marker_quality", "message_taxonomy_summary", "resample_closed", "adjusted_rand", "stream_degraded_segments"]
NAMES = [n for n in [*CORE, *INGEST, *MORE] if n in SQL]


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return float("%.9g" % float(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in found), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    found = duck.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, found.fetchall())
