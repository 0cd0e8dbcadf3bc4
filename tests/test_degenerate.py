"""Empty, short, constant and missing input; files and streams."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tideflow.functions import numerics, scalar
from tideflow.operators import blocks, evaluation, fits, lagcorr, surface, symmetry, wavelet
from tideflow.sources import bars
from tideflow.streaming import bars as stream


def frame(spark, **cols):
    n = len(next(iter(cols.values())))
    return spark.createDataFrame(pd.DataFrame({"series": "s", "idx": np.arange(n), **cols}), "series string, idx long, " + ", ".join(f"{c} double" for c in cols))


def test_empty_and_short_series_give_no_rows(spark):
    for n in (0, 5):
        d = frame(spark, x=np.ones(n))
        assert blocks.cumulants(d, [1, 2]).count() == 0
        assert symmetry.symmetry_function(blocks.net_charge(d, [1]), ["series"]).count() == 0
        assert wavelet.decompose(d, 6).count() == 0
        assert blocks.haar_variance(d, [1]).count() == 0
    assert fits.fit_profile(frame(spark, x=np.ones(3)).select("series", F.col("idx").alias("lag"), F.col("x").alias("rho"))).first()["valid"] is False


def test_missing_values_are_compacted_and_blocks_truncated(spark):
    q = blocks.net_charge(frame(spark, x=np.array([1, np.nan, 2, np.inf, 3, 4, 5.0])), [2]).orderBy("block").collect()
    assert [r["q"] for r in q] == [3.0, 7.0]


def test_constant_flow_gives_null(spark):
    d = frame(spark, p=np.arange(100.0), e=np.ones(100))
    assert lagcorr.response_function(d, 3).where("r IS NOT NULL").count() == 0
    s = surface.two_time_surface(frame(spark, r=np.ones(60)), 40, 3)
    assert s.where("rho IS NOT NULL").count() == 0
    assert surface.correlation_time(s).where("tau IS NOT NULL").count() == 0


def test_bad_arguments(spark):
    d = frame(spark, r=np.ones(60))
    for f in (
        lambda: surface.two_time_surface(d, 10, 3), lambda: surface.two_time_surface(d, 40, 20), lambda: scalar.volatility_field(F.col("r"), "x"),
        lambda: scalar.flow_imbalance(F.col("r"), F.col("r"), "x"), lambda: scalar.phase_bin(F.col("r"), 25), lambda: scalar.phase_bin(F.col("r"), 0), lambda: wavelet.filters(3),
        lambda: surface.correlation_time(surface.two_time_surface(d, 40, 3), "x"), lambda: surface.tti_breaking(surface.two_time_surface(d, 40, 3), "x"),
    ):
        with pytest.raises(ValueError):
            f()


def test_scalar_functions(spark):
    row = spark.range(1).select(
        scalar.erfc(F.lit(0.7)).alias("e"), scalar.digamma(F.lit(3.5)).alias("d"), scalar.trigamma(F.lit(3.5)).alias("t"),
        scalar.market_symbol(F.lit("BTC-USD")).alias("m"), scalar.market_symbol(F.lit("EURUSD=X")).alias("n"), scalar.phase_label(F.lit(2), 8).alias("l"),
    ).first()
    assert abs(row["e"] - 0.3221988) < 1e-6 and abs(row["d"] - 1.1031566) < 1e-7 and abs(row["t"] - 0.3303577) < 1e-6
    assert (row["m"], row["n"], row["l"]) == ("BTCUSDT", "EURUSDX", "06-09")


def test_generators():
    x = numerics.synthetic_stretched(20_000, 5, 1.0, 1)
    assert abs(np.corrcoef(x[:-5], x[5:])[0, 1] - np.exp(-1)) < 0.06
    assert numerics.fractional_noise(1000, 0.5, 2).std() == pytest.approx(1, abs=0.1)


def test_losses_need_ten_rows(spark):
    assert evaluation.losses(frame(spark, rv=np.ones(9), sigma=np.ones(9))).first()["qlike"] is None
    assert evaluation.losses(frame(spark, rv=np.ones(10), sigma=np.ones(10))).first()["qlike"] == 0


def test_files_round_trip(spark, tmp_path):
    lines = ["1700000000000,1,2,0.5,1.5,10,1700000059999,1,5,4,1,0", "1700000060000,2,3,1.5,2.5,10,1700000119999,1,5,6,1,0", "1700000000000,9,9,9,9,10,1700000059999,1,5,4,1,0"]
    (tmp_path / "k.csv").write_text("\n".join(lines))
    k = bars.read_klines(spark, f"file://{tmp_path}/k.csv", "S")
    assert [r["idx"] for r in k.orderBy("idx").collect()] == [0, 1]
    b = k.select("series", "ts", "open", "high", "low", "close", "volume", "tb_base", "trades", "idx")
    for fmt in ("parquet", "csv"):
        bars.write_bars(b, f"file://{tmp_path}/{fmt}", fmt)
        assert bars.read_bars(spark, f"file://{tmp_path}/{fmt}", fmt).count() == 2
    bars.write_json(bars.report(b.select("series", "idx", "close"), ["series"]), f"file://{tmp_path}/j")
    assert "report" in bars.read_json_report(spark, f"file://{tmp_path}/j").columns


def test_stream_equals_batch(spark):
    src = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{src}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(src)
    q = stream.stream_bars(bars.event_ticks(raw)).writeStream.outputMode("complete").format("memory").queryName("stream_bars").start()
    q.processAllAvailable()
    q.stop()
    want = {(r["ts"], round(r["volume"], 6), r["close"]) for r in bars.hourly_bars(spark.read.parquet(f"{src}/events.parquet")).collect()}
    assert {(r["ts"], round(r["volume"], 6), r["close"]) for r in spark.table("stream_bars").collect()} == want


def test_stream_ewma_keeps_state(spark, tmp_path):
    r = np.random.default_rng(0).normal(0, 0.01, 40)
    for k in range(2):
        frame(spark, r=r).where((F.col("idx") >= 20 * k) & (F.col("idx") < 20 * (k + 1))).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    src = spark.readStream.schema("series string, idx long, r double").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = stream.stream_ewma(src).writeStream.outputMode("append").format("memory").queryName("stream_ewma").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("stream_ewma").count() == 40


def test_phase_bins_that_do_not_divide_the_day(spark):
    """7 bins of 3 hours: the last three hours belong to none."""
    got = spark.range(24).select(scalar.phase_bin(F.col("id"), 7).alias("b")).collect()
    assert [r["b"] for r in got] == [h // 3 if h < 21 else None for h in range(24)]
