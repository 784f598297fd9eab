import numpy as np
import pytest

from assayer.errors import AssayError
from assayer.operators import linear as K
from assayer.plans.queries import queries

from .test_forest import _frame


def some_rows(n=400, width=6):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, width)) * 10.0 ** np.arange(width) + 50
    x[:, 5] = x[:, 0] + x[:, 1]  # collinear
    return x, x @ rng.normal(size=width) + rng.normal(size=n)


@pytest.mark.parametrize("penalty", [0.0, 1.0, 500.0])
@pytest.mark.parametrize("cells", [16_000_000, 15])
def test_fit_is_the_optimum(spark, monkeypatch, penalty, cells):
    monkeypatch.setattr(K, "GRAM_CELLS", cells)
    x, y = some_rows()
    df = _frame(spark, x, y)
    model = K.fit(df, "features", "label", penalty)
    centred, z = x - x.mean(axis=0), y - y.mean()
    if penalty:
        want = np.linalg.solve(centred.T @ centred + penalty * np.eye(6), centred.T @ z)
        assert model.coefficients == pytest.approx(want, rel=1e-4, abs=1e-6)
    else:
        best = np.linalg.lstsq(centred, z, rcond=None)[0]
        assert centred @ model.coefficients == pytest.approx(centred @ best, abs=1e-4)
    told = {r["id"]: r["prediction"] for r in model.transform(df, "features").collect()}
    assert told == pytest.approx({k: v for k, v in enumerate(
        centred @ model.coefficients + y.mean())}, abs=1e-6)


def test_equal_rows_and_limits(spark, monkeypatch):
    df = _frame(spark, np.ones((20, 2)), np.arange(20) * 1.0)
    model = K.fit(df, "features", "label")
    assert model.coefficients.tolist() == [0, 0] and model.intercept == 9.5
    monkeypatch.setattr(K, "MOST_FEATURES", 1)
    with pytest.raises(AssayError, match="too_many_features"):
        K.fit(df, "features", "label")


def test_ridge_query_predicts(spark, tmp_path):
    """Every test row's prediction, by a solve of all slots at once."""
    rows = [(k, k % 7 + k * k % 5, "abc"[k % 3], f"p{k % 4}", float(k * k % 11)) for k in range(200)]
    spark.createDataFrame(
        rows, "event_id long, user_id long, event_type string, props string, value double"
    ).write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: r for r in queries()["model_predictions_ridge_regression"](
        spark, str(tmp_path)).collect()}
    train = [r for r in rows if r[0] not in got]
    mean, scale = np.mean([r[1] for r in train]), np.std([r[1] for r in train])

    def slots(r):
        return [(r[1] - mean) / scale, *[r[2] == c for c in "abc"],
                *[r[3] == f"p{k}" for k in range(4)]]

    x, y = np.array([slots(r) for r in train], float), np.array([r[4] for r in train])
    centre = x.mean(axis=0)
    weights = np.linalg.solve((x - centre).T @ (x - centre) + np.eye(8), (x - centre).T @ (y - y.mean()))
    assert len(got) == 40 and all(r.optimal for r in got.values())
    assert all(got[r[0]].prediction == pytest.approx(
        y.mean() + (np.array(slots(r), float) - centre) @ weights, abs=1e-4)
        for r in rows if r[0] in got)
