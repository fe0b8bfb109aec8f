"""Registered queries: every one has rows of a stable schema, and a sample equals its DuckDB SQL on the smallest data."""

import os

import pytest

from tapewise.plans.registered import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
#: A query or two of each kind; all of them with ALL_QUERIES=1.
SAMPLE = (
    "zone_outcomes", "zone_visits", "zone_nesting", "structure_breaks", "bar_states", "level_visits", "moving_stops", "trade_drawdowns", "chain_lifts", "run_tiers", "block_effects", "backtest_overfitting", "stream_bars",
    "stream_sessions", "bars_read_from_csv", "signal_shards", "calendar_read", "back_filled", "reports_parsed", "session_labels", "parsed_ideas", "known_failing_ideas", "idea_neighbours", "studies_of_runs", "grid_search",
    "regime_shifts", "mean_reversions", "excitations", "order_flows", "segment_entropies",
)
if os.environ.get("ALL_QUERIES"):
    SAMPLE = tuple(sorted(ORACLE_SQL))


def test_every_oracle_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES) and len(QUERIES) > 80


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)

    def plain(rows):
        return sorted(tuple("null" if x is None else f"{x:.6f}" if isinstance(x, (int, float)) else str(x) for x in r) for r in rows)

    assert plain(got.select(order).collect()) == plain(want.project(", ".join(f'"{c}"' for c in order)).fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
