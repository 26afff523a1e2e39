"""The registered training queries hand the operators' own sizes on."""

import pytest

from hourcast.plans import q_ml

SIZES = {"n_estimators", "max_depth", "learning_rate"}


class Stop(Exception):
    pass


@pytest.mark.parametrize("query,operator", [
    ("forest", "train_grid"), ("gbt", "train_grid"), ("xgboost", "train_grid"), ("lightgbm", "train_grid"),
    ("horizon_grid", "horizon_grid"), ("train_save_best", "train_grid"), ("ts_cv", "cv_folds"), ("stacking", "stack"), ("tuning", "tune")])
def test_sizes(monkeypatch, query, operator):
    seen = []

    def spy(*args, **kwargs):
        seen.extend([*args, *kwargs.values()])
        raise Stop

    monkeypatch.setattr(q_ml, "feature_frame", lambda spark, sf: (None, []))
    monkeypatch.setattr(q_ml.ml, operator, spy)
    with pytest.raises(Stop):
        q_ml.QUERIES[query](None, None)
    grids = [x for x in seen if isinstance(x, dict) and x and all(isinstance(k, str) for k in x)]
    if query == "tuning":
        (space,) = grids
        forest, boost = space["random_forest"], space["gradient_boosting"]
        assert {(g["n_estimators"], g["max_depth"]) for g in forest} == {(n, d) for n in (100, 200, 300, 500) for d in (5, 10, 15, 20, 30)}
        assert {(g["n_estimators"], g["learning_rate"], g["max_depth"]) for g in boost} == {
            (n, r, d) for n in (100, 200, 300) for r in (0.01, 0.05, 0.1, 0.2) for d in (3, 5, 7, 10)}
    else:
        assert grids and not any(SIZES & set(params) for g in grids for params in g.values())
