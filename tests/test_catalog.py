"""Every registered query: plan shape, and agreement with its check SQL on the small tables."""
import os

import duckdb
import pytest

from ownerlens.plans.catalog import CHECKS, QUERIES
from ownerlens.plans.fixtures import BASE_TABLES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")
# These write or stream while the plan is built.
EAGER = ("agg20", "jn05", "ext05_publish", "ext08_stored", "run02", "jn02", "jn03", "jn04", "st0", "snk01", "snk08", "run01", "win01", "win12", "src02", "src03", "src04", "src05", "src08", "rep02")
COMPARED = ["fn01_feed_date", "fn03_navigation_stub", "flt04_off_topic", "rf20_annotate", "agg05_psc_dedup", "win01_article_ids",
            "gr01_vertices", "agg15_extraction_score", "srh03_hybrid", "fn30_article_entities", "st05_register_upsert", "run01_end_to_end", "jn03_vector_dedup", "jn05_relation_endpoints", "srh05_batch_hybrid", "srh05_batch_concept",
            "ext06_fan_out", "ext09_embedding", "agg20_funnel", "ext05_publish_gate", "ext08_stored_records", "run02_complete", "st04_stream_windows", "st05_holdings_upsert"]


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(EAGER)])
def test_plan_shape(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan


def _plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", COMPARED)
def test_equals_check_sql(spark, name):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    cur = con.execute(CHECKS[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(tuple(_plain(r[n]) for n in sorted(names)) for r in df.collect())
    at = {n: i for i, n in enumerate(names)}
    assert got == sorted(tuple(_plain(r[at[n]]) for n in sorted(names)) for r in cur.fetchall())


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)
