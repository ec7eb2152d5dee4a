"""Model queries take the operators' full sizes and end with what those sizes give."""

import pytest

from packetloom.operators import clusters, iforest, models
from packetloom.plans import queries


@pytest.fixture
def fitted(monkeypatch):
    """Tree models made by a query."""
    made = []
    for name in ("fit_forest", "fit_boosted"):
        fit = getattr(models, name)
        monkeypatch.setattr(models, name, lambda *a, fit=fit, **b: made.append(fit(*a, **b)) or made[-1])
    return made


def test_forest_takes_all_trees(spark, small, fitted):
    rows = queries.REGISTRY["rf_predict"](spark, small).collect()
    (model,) = fitted
    assert {r.tree for r in model.nodes.select("tree").distinct().collect()} == set(range(models.FOREST_TREES))
    assert sum(r.label == r.prediction for r in rows) > 0.95 * len(rows)


def test_sweep_takes_all_restarts(spark, small, monkeypatch):
    given, fit_many = [], clusters.fit_many
    monkeypatch.setattr(clusters, "fit_many", lambda df, starts, *a, **b: given.append(len(starts)) or fit_many(df, starts, *a, **b))
    rows = queries.REGISTRY["kmeans_sweep"](spark, small).orderBy("k").collect()
    # All restarts of all k in one fit, then those of the best k on all rows.
    assert given == [len(clusters.K_RANGE) * clusters.RESTARTS, clusters.RESTARTS]
    assert [r.k for r in rows] == list(clusters.K_RANGE)
    assert all(a.inertia > b.inertia for a, b in zip(rows, rows[1:])) and all(-1 <= r.silhouette <= 1 for r in rows)


def test_scores_flag_the_share(spark, small):
    rows = queries.REGISTRY["anomaly_scores"](spark, small).collect()
    flagged = sum(r.is_anomaly for r in rows)
    assert 0 < flagged <= iforest.CONTAMINATION * len(rows) + 1
    assert all(r.is_anomaly == (r.anomaly_score > 0) for r in rows if r.anomaly_score != 0)
