import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.operators import probes
from quernel.plans import bridge, queries

SF = "/root/testdata/sf0.001"


def plain(x, y, fit):
    """Newton's method on all rows at once."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd < 1e-12] = 1
    z = np.hstack([(x - mean) / sd, np.ones((len(x), 1))])
    ridge, w = np.append(np.ones(x.shape[1]), 0), np.zeros(x.shape[1] + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-z[fit] @ w))
        w += np.linalg.solve((z[fit].T * (p * (1 - p))) @ z[fit] + np.diag(ridge), z[fit].T @ (y[fit] - p) - ridge * w)
    return w, mean, sd


def test_summed_newton_equals_newton_on_all_rows(spark):
    h, _ = queries._probe(spark, SF)
    rows = h.where("split <> 'test'").withColumn("fit", F.col("split") == "train").repartition(7)
    got = {r["layer"]: r for r in probes.logistic_probe(rows, ["layer"]).collect()}
    data = rows.collect()
    assert len(got) == bridge.LAYERS
    for layer, r in got.items():
        own = [d for d in data if d["layer"] == layer]
        x, y, fit = np.array([d["vec"] for d in own]), np.array([d["label"] for d in own]), np.array([d["fit"] for d in own])
        w, mean, sd = plain(x, y, fit)
        assert np.abs(np.array([*r["coef"], r["bias"]]) - w).max() < 1e-6 and np.abs(np.array(r["mean"]) - mean).max() < 1e-9
        s = np.hstack([(x - mean) / sd, np.ones((len(x), 1))])[~fit] @ w
        a, b = s[y[~fit] == 1], s[y[~fit] == 0]
        assert abs(r["auroc"] - np.mean((a[:, None] > b) + (a[:, None] == b) / 2)) < 1e-9


def test_groups_of_one_class_constant_columns_and_separable_rows(spark):
    rows = [("one", 1, [float(i), 1.0], True) for i in range(5)] + [("none", i % 2, [float(i), 1.0], False) for i in range(6)]
    rows += [("split", int(i > 20), [float(i) * 1000, 1.0], i % 3 > 0) for i in range(60)] + [("split", 1, None, True)]
    got = {r["name"]: r for r in probes.logistic_probe(spark.createDataFrame(rows, "name string, label int, vec array<double>, fit boolean"), ["name"]).collect()}
    assert got["one"]["coef"] == got["none"]["coef"] == [0.0, 0.0] and got["one"]["auroc"] == 0.5
    assert got["split"]["auroc"] == 1.0 and abs(got["split"]["coef"][1]) < 1e-9 and got["split"]["sd"][1] == 1.0


def test_no_rows(spark):
    assert probes.logistic_probe(spark.createDataFrame([], "layer int, label int, vec array<double>, fit boolean"), ["layer"]).count() == 0


def test_a_name_registers_once():
    def probe_logreg(spark, d):
        return None

    with pytest.raises(ValueError, match="registered"):
        queries.query(probe_logreg)
