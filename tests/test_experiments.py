"""The whole analyses on small data, and the composition's new parts against plain forms."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from tideflow.operators import events, flow, lagcorr, nulls, phase
from tideflow.plans import experiments
from tideflow.sources import bars, synthetic

SF = "/root/testdata/sf0.01"


def daily(spark):
    return bars.daily_bars(spark.read.parquet(f"{SF}/lineitem.parquet"))


def test_counting(spark):
    out = experiments.counting(daily(spark), (1, 2, 4), 5, 2)
    for name in ("gamma", "closure", "fano", "permutation", "affinity"):
        assert out[name].count() > 0
    assert abs(out["slopes"].first()["slope_k2"] - 1) < 0.4


def test_post_shock(spark):
    r = flow.log_returns(daily(spark))
    out = experiments.post_shock(r, 20, (0, 4, 8, 12), 4, 2, 11, quantile=0.97, distance=60, before=50)
    got = out["spearman_null"].collect()  # holds the observed statistic too
    assert {x["series"] for x in got} == {"lineitem", "POOL"}
    assert out["omori"].count() == 2
    out["field"].unpersist(), out["null_field"].unpersist()


def test_phase_and_second_order(spark):
    e = bars.event_bars(spark.read.parquet(f"{SF}/events.parquet"))
    prepared = phase.prepare(e.select("series", "idx", "day", "hour", F.col("flow").alias("e"), F.col("price").alias("p"), F.col("flow").alias("raw"), "volume", "trades"))
    out = experiments.phase_of_day(prepared, 4)
    assert out["verdict"].count() == 5
    hourly = bars.hourly_bars(spark.read.parquet(f"{SF}/events.parquet"))
    out = experiments.second_order(hourly, prepared, F.hour("ts"), 20)
    assert out["teff"].count() == 20 and out["transfer"].count() == 8


def test_crossover_blocks_move_with_a_ramp_and_wavelets_do_not(spark):
    x = synthetic.fractional_noise(spark, 1 << 14, 0.7)
    out = experiments.crossover(x, (3, 7), (3.0,))
    nu = {n: {r["case"]: r["nu"] for r in out[n].collect()} for n in ("blocks", "db3")}
    assert abs(nu["db3"]["clean"] - 1.4) < 0.15
    assert nu["blocks"]["ramp 3.0"] - nu["blocks"]["clean"] > 0.1
    assert abs(nu["db3"]["ramp 3.0"] - nu["db3"]["clean"]) < 0.05


def test_resampling_each_unit_once_changes_nothing(spark):
    rng = np.random.default_rng(0)
    field = spark.createDataFrame(pd.DataFrame([("s", k, u, float(rng.normal(1, 0.3))) for k in range(25) for u in range(1, 13)], columns=["series", "shock", "u", "w"]))
    want = {(r["age_bin"], r["lag"]): r["rho"] for r in events.age_correlation(field, [0, 4, 8], 3).collect()}
    w = nulls.bootstrap_weights(field, 2, 1)
    got = {(r["age_bin"], r["lag"]): r["rho"] for r in events.resampled_age_correlation(field, w, [0, 4, 8], 3).where("draw = 0").collect()}
    assert want.keys() == got.keys() and all(abs(want[k] - got[k]) < 1e-9 for k in want)


def test_correlation_sums(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=200), rng.normal(size=200)
    d = spark.createDataFrame(pd.DataFrame({"series": "s", "idx": np.arange(200), "a": a, "b": b}))
    for r in lagcorr.correlation_sums(d, "a", "b", 5, 32).collect():
        assert abs(r["s"] - (a[: 200 - r["lag"]] * b[r["lag"] :]).sum()) < 1e-9


def test_labels_by_suffix(spark):
    d = spark.createDataFrame([("B|1h",), ("A|1h",), ("A|4h",)], "series string")
    assert [r[0] for r in experiments.with_suffix(d, "|1h").collect()] == ["A|1h", "B|1h"]
