"""The queries that apply follow lists to all nodes and all edges, against their SQL on a larger table."""

import duckdb
import pytest

from walkgraph.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", ["resolve_ids", "update_follows", "follow_list_deltas", "bulk_update_walks", "update_walks", "stream_follow_lists", "arbiter_scan_walks"])
def test_whole_graph(spark, data, name):
    at = data.replace("sf0.001", "sf0.01")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{at}/events.parquet'")
    found = QUERIES[name](spark, at)
    rows = sorted(tuple(r) for r in found.collect())
    assert rows == sorted(con.sql(SQL[name]).project(", ".join(found.columns)).fetchall())
    [(users,)] = con.sql("SELECT count(DISTINCT user_id) FROM events").fetchall()
    assert name != "resolve_ids" or len(rows) > users
