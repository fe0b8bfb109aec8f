import pytest

from tapewise.operators import search


def test_design(spark):
    space = search.SPACE | {"entry_type": search.Choice(("ft", "dp", "st50"))}
    rows = search.design(spark, 400, space).orderBy("config_id").collect()
    assert rows == search.design(spark, 500, space).where("config_id < 400").orderBy("config_id").collect() and rows != search.design(spark, 400, space, 2).orderBy("config_id").collect()
    for name, axis in space.items():
        seen = [r[name] for r in rows]
        if isinstance(axis, search.Choice):
            assert set(seen) == set(axis.values)
        elif isinstance(axis, search.Whole):
            assert set(seen) == set(range(axis.low, axis.high + 1))
        else:
            third = (axis.high - axis.low) / 3
            assert all(axis.low <= v <= axis.high for v in seen) and min(seen) < axis.low + third and max(seen) > axis.high - third
    with pytest.raises(ValueError):
        search.design(spark, search.MOST_CONFIGS + 1)


def test_windows_and_best_of_each(spark):
    bars = spark.range(1000).selectExpr("'s' AS symbol", "id AS bar_no")
    spans = {(r.window, r.phase): (r.first_no, r.last_no) for r in search.window_bounds(bars).collect()}
    assert spans == {(0, "is"): (0, 749), (0, "oos"): (750, 832), (1, "is"): (83, 832), (1, "oos"): (833, 915), (2, "is"): (166, 915), (2, "oos"): (916, 998)}
    # configuration 1 gains early and loses late, configuration 0 the other way round; each trade lasts four bars
    rows = [("s", c, e, e + 4, (1.0 if (e < 760) == bool(c) else -1.0) + 0.01 * (e % 7)) for c in (0, 1) for e in range(0, 1000, 10)]
    rows += [("s", 1, 748, 752, 99.0), ("s", 1, 12, 13, 50.0)]  # not closed within the first window's bars; begins while another is open
    trades = spark.createDataFrame(rows, "symbol string, config_id long, entry_no long, exit_no long, pnl double").selectExpr("*", "pnl > 0 AS win")
    evaluation = search.evaluated(trades, search.window_bounds(bars))
    got = {(r.window, r.phase, r.config_id): (r.trades, round(r.total, 6)) for r in evaluation.collect()}
    for (w, phase), (first, last) in spans.items():
        for c in (0, 1):
            kept, till = [], -1
            for _, _, entry, end, pnl in sorted(r for r in rows if r[1] == c and r[2] >= first and r[3] <= last):
                if entry > till:
                    kept.append(pnl)
                    till = end
            assert got[w, phase, c] == (len(kept), pytest.approx(sum(kept), abs=1e-5))
    out = {r.window: r for r in search.walked_forward(evaluation, spark.createDataFrame([(0, 1.5), (1, 2.0)], "config_id long, atr_mult double")).collect()}
    assert all(out[w].config_id == 1 and out[w].atr_mult == 2.0 for w in out) and out[2].oos_so_far == pytest.approx(sum(out[w].oos_total for w in out)) and out[0].oos_total < 0
    held = search.held_out(spark.createDataFrame([("s", 1, 3.0)], "symbol string, config_id long, avg_oos_pf double"), trades, 900).first()
    assert held.holdout_trades == 10 and held.holdout_pf == 0
