"""The curve queries and the clearest differences cover every run of the predictions, not one."""

import pytest

from sluice import catalogue
from sluice.plans.predictions import KEYS, predictions

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["roc_curve", "pr_curve", "pr_auc_trapz", "curve_downsample"])
def test_curves_of_every_run(spark, name):
    want = {tuple(r) for r in predictions(spark, SMALL).select(*KEYS).distinct().collect()}
    rows = catalogue.QUERIES[f"{name}_all_runs"](spark, SMALL)
    assert {tuple(r) for r in rows.select(*KEYS).distinct().collect()} == want and len(want) == 135
    # The run that the query of one run shows comes out the same.
    one = catalogue.QUERIES[name](spark, SMALL)
    assert sorted(map(tuple, rows.where("pipeline = 1 and mode = 'normal'").select(one.columns).collect())) == sorted(map(tuple, one.collect()))


def test_three_differences_of_every_run(spark):
    got = sorted(map(tuple, catalogue.QUERIES["mcnemar_top3"](spark, SMALL).collect()))
    runs = {}
    for r in catalogue.QUERIES["mcnemar_within"](spark, SMALL).collect():
        runs.setdefault((r["pipeline"], r["mode"]), []).append(r)
    want = [(*run, r["a"], r["b_name"], r["b"], r["c"], r["p_holm"]) for run, rows in runs.items() for r in sorted(rows, key=lambda r: (r["p_holm"], -r["statistic"], r["a"], r["b_name"]))[:3]]
    assert got == sorted(want) and len(got) == 27
