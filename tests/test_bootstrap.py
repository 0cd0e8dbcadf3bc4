"""The bootstrap's whole ensembles, and the power law fitted to each draw."""

import numpy as np

from tideflow.functions import numerics
from tideflow.plans import catalogue

SF = "/root/testdata/sf0.01"


def test_all_ages_of_all_draws(spark):
    got = catalogue.queries()["bootstrap_ensemble"](spark, SF)
    assert {r["u"] for r in got.select("u").distinct().collect()} == set(range(1, catalogue.U_MAX + 1))


def test_every_draw_is_fitted(spark):  # draw 0 is the ensemble itself
    got = catalogue.queries()["bootstrap_omori"](spark, SF).collect()
    assert sorted(r["draw"] for r in got) == list(range(catalogue.DRAWS + 1))
    ensemble = catalogue.queries()["bootstrap_ensemble"](spark, SF).toPandas()
    for r in got:
        m = ensemble[ensemble.draw == r["draw"]].sort_values("u").m.to_numpy()
        want = numerics.fit_omori(m)
        assert abs(r["p"] - want["p"]) < 2e-3 and r["n"] == len(m)
    q = catalogue.queries()["bootstrap_omori_interval"](spark, SF).first()
    p = np.array([r["p"] for r in got if r["draw"]])
    assert abs(q["median"] - np.median(p)) < 1e-5 and q["q025"] <= q["median"] <= q["q975"]
