"""Wall time of the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one line of JSON.

Beside them, ``scale``: bar operators over minute bars as many as two years of one instrument have (717,665), as one symbol, as 50 symbols, and
ten times as many as ten symbols.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "zone_outcomes", "zone_returns", "fair_value_gaps", "structure_breaks", "displacements", "bar_states", "hurst_exponents", "level_touches",
    "forward_excursions", "barrier_sweep", "moving_stops", "chain_lifts", "state_transitions", "run_tiers", "best_results", "block_effects",
    "parameter_sensitivity", "stream_bars",
)


BARS = 717_665


def minute_bars(spark: SparkSession, symbols: int, each: int):
    """Stored bars with waves and hashed noise."""
    from tapewise.sources import bars
    from tapewise.sources.store import stage

    rows = spark.range(symbols * each).selectExpr(f"concat('s', id div {each}) AS symbol", f"id % {each} AS k").selectExpr(
        "symbol", "timestamp_seconds(1704067200 + 60 * k) AS ts",
        "17000 + 300 * sin(k / 9000) + 40 * sin(k / 331) + (xxhash64(symbol, k) % 1000) / 100 AS open", "17000 + 300 * sin((k + 1) / 9000) + 40 * sin((k + 1) / 331) + (xxhash64(symbol, k + 1) % 1000) / 100 AS close",
        "abs(xxhash64(symbol, k, 1) % 400) / 100 AS up", "abs(xxhash64(symbol, k, 2) % 400) / 100 AS down", "abs(xxhash64(symbol, k, 3) % 5000) AS volume",
    ).selectExpr("symbol", "ts", "open", "greatest(open, close) + up AS high", "least(open, close) - down AS low", "close", "volume")
    return stage(bars.keyed(rows), "bars")


def scale(spark: SparkSession) -> dict[str, float]:
    from tapewise.operators import outcomes, signals, zones

    def measured(df) -> float:
        began = time.perf_counter()
        df().write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - began, 3)

    def sweep(b):
        atrs = signals.atr(b).withColumn("hit", (F.col("bar_no") % 50) == 0)
        return outcomes.barrier_sweep(outcomes.first_barrier(outcomes.atr_barriers(atrs, "hit", [1.0, 2.0]), b, 120))

    from pyspark.sql import functions as F

    one, many = minute_bars(spark, 1, BARS), minute_bars(spark, 50, BARS // 50)
    out = {}
    for name, b in (("one_symbol", one), ("50_symbols", many)):
        out[f"fair_value_gap_{name}"] = measured(lambda b=b: signals.fair_value_gap(b))
        out[f"zone_outcomes_{name}"] = measured(lambda b=b: zones.outcomes(zones.zone_bars(signals.fair_value_gap(b))))
        out[f"states_{name}"] = measured(lambda b=b: signals.states(b))
        out[f"barrier_sweep_{name}"] = measured(lambda b=b: sweep(b))
    ten = minute_bars(spark, 10, BARS)
    out["fair_value_gap_10_times"] = measured(lambda: signals.fair_value_gap(ten))
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tapewise.plans.registered import QUERIES

    QUERIES["bars_from_ticks"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "scale": scale(spark)}))
    spark.stop()


if __name__ == "__main__":
    main()
