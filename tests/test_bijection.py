"""Random orders by keyed bijections: one to one for every length, different for every key, and as even as a shuffle."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideflow.functions.bijection import place, place_keys
from tideflow.operators import nulls


def placed(spark, n, draws):
    keys = place_keys(spark.range(draws).select(F.col("id").alias("draw"), F.lit(n).cast("long").alias("n")), [F.lit("k"), F.col("draw")])
    rows = spark.range(n).crossJoin(keys).select("draw", "id", place(F.col("id")).alias("to")).toPandas()
    return rows.sort_values(["draw", "id"])["to"].to_numpy().reshape(draws, n)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 64, 65, 257, 10_007])
def test_every_place_is_taken_once(spark, n):
    for row in placed(spark, n, 4):
        assert (np.sort(row) == np.arange(n)).all()


def test_orders_are_even_and_differ(spark):
    n, draws = 23, 3000
    to = placed(spark, n, draws)
    assert len({tuple(r) for r in to}) == draws
    # where a row goes, and where neighbours go, is spread evenly: chi-squared within six deviations of its mean
    for cells, size in ((to[:, 3], n), (to[:, 22], n), ((to[:, 4] - to[:, 3]) % n - 1, n - 1)):
        seen = np.bincount(cells, minlength=size)
        chi2 = ((seen - draws / size) ** 2 / (draws / size)).sum()
        assert abs(chi2 - (size - 1)) < 6 * np.sqrt(2 * (size - 1))


def test_no_order_is_left(spark):
    n = 4999
    for row in placed(spark, n, 3):
        for lag in (1, 2, 71, 72):
            assert abs(np.corrcoef(row[:-lag], row[lag:])[0, 1]) < 4.5 / np.sqrt(n)
        assert abs(np.corrcoef(np.arange(n), row)[0, 1]) < 4.5 / np.sqrt(n)


def test_permutation_keeps_values(spark):
    x = {"a": np.arange(50.0), "b": np.arange(7.0)}
    d = spark.createDataFrame(pd.concat([pd.DataFrame({"series": k, "idx": np.arange(len(v)), "x": v}) for k, v in x.items()]))
    d = d.withColumn("x", F.when(F.col("x") != 4, F.col("x")))
    got = nulls.permutation(d, 5, 1).toPandas()
    assert len(got) == 6 * 57
    for (k, draw), g in got.groupby(["series", "draw"]):
        g = g.sort_values("idx")
        want = np.where(x[k] == 4, np.nan, x[k])
        assert (g["idx"].to_numpy() == np.arange(len(want))).all()
        assert np.array_equal(np.sort(g["x"]), np.sort(want), equal_nan=True)
        assert np.array_equal(g["x"], want, equal_nan=True) == (draw == 0)
    assert nulls.permutation(d.limit(0), 5, 1).count() == 0
