"""DuckDB SQL that the queries' results are compared with: common table expressions by name, and their composition."""

from __future__ import annotations

import re

#: Windows of the bar tables.
W = "PARTITION BY symbol ORDER BY bar_no"

CTES = {
    "raw_bars": """
        SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, struct_pack(t := ts, i := event_id)) AS open, max(value) AS high,
               min(value) AS low, arg_max(value, struct_pack(t := ts, i := event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2""",
    "bars": """
        SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_no, timezone('America/New_York', timezone('UTC', ts)) AS ny,
               timezone('America/Chicago', timezone('UTC', ts)) AS chi FROM raw_bars""",
    "days": """
        SELECT o_orderpriority AS symbol, CAST(o_orderdate AS TIMESTAMP) AS ts, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
               min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume FROM orders GROUP BY 1, 2""",
    "tr": f"""
        SELECT *, greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))) AS tr FROM bars""",
    "atrs": f"""
        SELECT *, avg(tr) OVER ({W} ROWS 13 PRECEDING) AS atr, avg(tr) OVER ({W} ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS atr_before FROM tr""",
    "atr50": f"""
        SELECT *, CASE WHEN count(atr) OVER ({W} ROWS 49 PRECEDING) = 50 THEN avg(atr) OVER ({W} ROWS 49 PRECEDING) END AS atr50 FROM atrs""",
    "gaps": f"""
        SELECT *, coalesce(low - lag(high, 2) OVER ({W}) > 0, false) AS bull, coalesce(lag(low, 2) OVER ({W}) - high > 0, false) AS bear,
               lag(high, 2) OVER ({W}) AS high2, lag(low, 2) OVER ({W}) AS low2 FROM bars""",
    "gap_ids": f"""
        SELECT *, sum(bull::INT) OVER ({W}) AS bull_id, sum(bear::INT) OVER ({W}) AS bear_id FROM gaps""",
    # mirrored bars of both sides, after the birth of a zone
    "zone_all": """
        SELECT symbol, 'bull' AS side, bull_id AS zone_id, bar_no, ts, ny, low AS lo, high AS hi, close AS px, bull AS birth, low AS e, high2 AS f FROM gap_ids
        UNION ALL SELECT symbol, 'bear', bear_id, bar_no, ts, ny, -high, -low, -close, bear, -high, -low2 FROM gap_ids""",
    "born": "SELECT symbol, side, zone_id, bar_no AS born_no, ts AS born_ts, ny AS born_ny, e AS entry, f AS far FROM zone_all WHERE birth",
    "zone_bars": "SELECT z.*, b.born_no, b.born_ts, b.born_ny, b.entry, b.far FROM zone_all z JOIN born b USING (symbol, side, zone_id)",
    "episodes": """
        SELECT symbol, side, zone_id, entry, far, born_no, born_ts, born_ny,
               min(bar_no) FILTER (bar_no > born_no AND lo <= entry) AS touch_no, min(bar_no) FILTER (bar_no > born_no AND lo <= far) AS fill_no,
               min(ny) FILTER (bar_no > born_no AND lo <= far) AS fill_ny, min(lo) FILTER (bar_no > born_no) AS lowest,
               arg_min(lo, bar_no) FILTER (bar_no > born_no AND lo <= far) AS at_fill
        FROM zone_bars GROUP BY ALL""",
    "depths": """
        SELECT *, CASE WHEN touch_no IS NOT NULL THEN entry - CASE WHEN fill_no IS NULL THEN lowest ELSE at_fill END END AS depth,
               CASE WHEN touch_no IS NOT NULL THEN (entry - CASE WHEN fill_no IS NULL THEN lowest ELSE at_fill END) / nullif(entry - far, 0) * 100 END AS pct FROM episodes""",
    "steps": """
        SELECT e.symbol, e.side, e.zone_id, e.far, b.bar_no - e.fill_no AS step, CASE WHEN side = 'bull' THEN b.high ELSE -b.low END AS hi,
               e.far - CASE WHEN side = 'bull' THEN b.low ELSE -b.high END AS beyond
        FROM episodes e JOIN bars b ON b.symbol = e.symbol AND b.bar_no BETWEEN e.fill_no AND e.fill_no + 120""",
    "back": "SELECT symbol, side, zone_id, min(step) FILTER (step > 0 AND hi >= far) AS back_after FROM steps GROUP BY ALL",
    "beyonds": "SELECT symbol, side, zone_id, max(beyond) AS excursion FROM steps JOIN back USING (symbol, side, zone_id) WHERE back_after IS NULL OR step <= back_after GROUP BY ALL",
    "returned": "SELECT e.*, b.back_after, x.excursion FROM episodes e LEFT JOIN back b USING (symbol, side, zone_id) LEFT JOIN beyonds x USING (symbol, side, zone_id)",
    "states": f"""
        SELECT *, CASE WHEN bar_no < 30 THEN 'N' WHEN avg(high - low) OVER p5 < 0.5 * atr50 THEN 'C'
            WHEN high > max(high) OVER p10 + 1.5 AND volume > 1.5 * med AND (high - close) / nullif(high - low, 0) > 0.35 THEN 'SU'
            WHEN low < min(low) OVER p10 - 1.5 AND volume > 1.5 * med AND (close - low) / nullif(high - low, 0) > 0.35 THEN 'SD'
            WHEN close - lag(close) OVER w > 2 * atr50 THEN 'DU' WHEN close - lag(close) OVER w < -2 * atr50 THEN 'DD'
            WHEN close > max(high) OVER p15 AND volume > med THEN 'BU' WHEN close < min(low) OVER p15 AND volume > med THEN 'BD' ELSE 'N' END AS state
        FROM (SELECT *, quantile_cont(volume, 0.5) OVER ({W} ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS med FROM atr50)
        WINDOW w AS ({W}), p5 AS ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), p10 AS ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), p15 AS ({W} ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING)""",
    "build_runs": """
        SELECT o.o_orderkey AS run_id, o.o_orderdate AS created_at, CASE o.o_orderstatus WHEN 'F' THEN 'LONDON' WHEN 'O' THEN 'NY' ELSE 'ASIA' END AS session,
               string_agg(DISTINCT p.p_type, ' + ' ORDER BY p.p_type) AS idea
        FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey GROUP BY 1, 2, 3""",
    "results": """
        SELECT l_orderkey AS run_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rank,
               0.5 + CAST(l_quantity AS DOUBLE) / 20.0 AS pf, CAST(l_quantity AS INT) AS num_trades, 0.3 + CAST(l_discount AS DOUBLE) * 4 AS winrate,
               CAST(l_tax AS DOUBLE) AS param_tax, CAST(l_discount AS DOUBLE) AS param_discount FROM lineitem""",
}


def frame_sql(prefix: str, interval: str) -> dict[str, str]:
    """Expressions {prefix}_bars: the bars resampled to an interval, numbered per symbol."""
    return {
        f"{prefix}_bars": f"""SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_no FROM (
            SELECT symbol, time_bucket(INTERVAL {interval}, ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM raw_bars GROUP BY 1, 2)"""
    }


def zone_sql(prefix: str, bars: str) -> dict[str, str]:
    """Expressions up to {prefix}_active: the gap zones that are active at each bar of the table ``bars``: {bull, bear}_top and _bottom, null if none is."""
    p = prefix
    return {
        f"{p}_gaps": f"""SELECT *, coalesce(low - lag(high, 2) OVER ({W}) > 0, false) AS bull, coalesce(lag(low, 2) OVER ({W}) - high > 0, false) AS bear, lag(high, 2) OVER ({W}) AS h2, lag(low, 2) OVER ({W}) AS l2 FROM {bars}""",
        f"{p}_ids": f"SELECT *, sum(bull::INT) OVER ({W}) AS bull_id, sum(bear::INT) OVER ({W}) AS bear_id FROM {p}_gaps",
        f"{p}_sides": f"""SELECT symbol, 'bull' AS side, bull_id AS zone_id, bar_no, low AS lo, bull AS birth, low AS e, h2 AS f FROM {p}_ids UNION ALL SELECT symbol, 'bear', bear_id, bar_no, -high, bear, -high, -l2 FROM {p}_ids""",
        f"{p}_born": f"SELECT symbol, side, zone_id, bar_no AS born_no, e, f FROM {p}_sides WHERE birth",
        f"{p}_lives": f"""SELECT b.*, (SELECT min(z.bar_no) FROM {p}_sides z WHERE z.symbol = b.symbol AND z.side = b.side AND z.bar_no > b.born_no AND z.zone_id - z.birth::INT = b.zone_id AND z.lo <= b.f) AS gone_no FROM {p}_born b""",
        f"{p}_active": f"""SELECT i.symbol, i.ts, i.bar_no, i.close, u.e AS bull_top, u.f AS bull_bottom, -d.f AS bear_top, -d.e AS bear_bottom FROM {p}_ids i
            LEFT JOIN {p}_lives u ON u.symbol = i.symbol AND u.side = 'bull' AND u.zone_id = i.bull_id AND (u.gone_no IS NULL OR i.bar_no < u.gone_no)
            LEFT JOIN {p}_lives d ON d.symbol = i.symbol AND d.side = 'bear' AND d.zone_id = i.bear_id AND (d.gone_no IS NULL OR i.bar_no < d.gone_no)""",
    }


def compose(body: str, **more: str) -> str:
    """``body`` with the table expressions that it and they refer to, in order of need. ``more``: further named expressions."""
    known = CTES | more
    order: list[str] = []

    def need(text: str) -> None:
        for name in known:
            if re.search(rf"\b{name}\b", text) and name not in order and name != current[-1]:
                current.append(name)
                need(known[name])
                current.pop()
                if name not in order:
                    order.append(name)

    current = [""]
    need(body)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({known[n]})" for n in order) + "\n" + body if order else body
