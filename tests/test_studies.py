import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tapewise.operators import signals, studies
from tests.test_core import frame, walk


def test_pandas_signal_does_not_depend_on_chunks(spark):
    def mean5(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"mean5": g["close"].rolling(5, min_periods=1).mean()})

    rows = walk(80)
    want = pd.Series([r[5] for r in rows]).rolling(5, min_periods=1).mean()
    for chunk in (9, 1000):
        got = studies.pandas_signal(frame(spark, rows, chunk), mean5, "mean5 double", back=4).orderBy("bar_no").collect()
        assert np.allclose([r.mean5 for r in got], want)


def test_audit_tells_causal_signals_from_others(spark):
    bars = frame(spark, walk(80))
    good = studies.UserSignal("range", signals.dealing_range)
    bad = studies.UserSignal("ahead", lambda b: b.join(b.groupBy("symbol").agg(F.max("bar_no").alias("_m")), "symbol").withColumn("newest", F.col("bar_no") == F.col("_m")).drop("_m"))
    assert studies.audit(good, bars) == {"keys": True, "causal": True, "fires": True}
    assert studies.audit(bad, bars)["causal"] is False


def test_entropy_and_fluctuations():
    rng = np.random.default_rng(0)
    noise, wave = rng.normal(size=400), np.sin(np.arange(400) / 3)
    assert studies._entropy(wave) < studies._entropy(noise) and studies._entropy(np.zeros(50)) is None
    assert abs(studies._fluctuation(noise) - 0.5) < 0.15 and studies._fluctuation(np.cumsum(noise)) > 1.2 and studies._fluctuation(np.zeros(50)) is None


def test_ema_of_a_short_series(spark):
    rows = walk(30)
    got = studies.ema_trend(frame(spark, rows, 11), n=4, reach=40).orderBy("bar_no").collect()
    assert np.allclose([r.ema for r in got], pd.Series([r[5] for r in rows]).ewm(span=4, adjust=False).mean())
