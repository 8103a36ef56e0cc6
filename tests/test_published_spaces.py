"""The search queries run the published spaces, and a failing forecast candidate is a row."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from loomtab.catalog import trained
from loomtab.models.linear import LinearScore
from loomtab.operators.prepare import as_vector
from loomtab.plans.forecast import horizon_table, scaled_features, searched_forecasts
from loomtab.plans.leaderboard import Entry, forecast_entries
from tests.conftest import SMALL


class Seen(Exception):
    pass


def call_of(monkeypatch, spark, query, step):
    """Arguments with which ``query`` calls ``step`` first."""

    def stop(*args, **named):
        raise Seen(args, named)

    monkeypatch.setattr(trained, step, stop)
    with pytest.raises(Seen) as seen:
        query(spark, SMALL)
    return seen.value.args


def test_margin_and_network_searches_run_every_candidate(spark, monkeypatch):
    args, named = call_of(monkeypatch, spark, trained.margin_search, "kernel_search")
    assert len(args[1]) == 75 and {c[2].get("degree") for c in args[1]} == {None, "2", "3", "5", "8"}
    assert named.get("components", 128) >= 128
    args, named = call_of(monkeypatch, spark, trained.network_search, "shared_search")
    assert len(args[1]) == 42 and named["max_iter"] == 200


def test_boosting_search_fits_the_published_rounds(spark, monkeypatch):
    args, _ = call_of(monkeypatch, spark, trained.boosting_search, "adaboost_rates")
    assert list(args[1]) == [0.001, 1.0] and args[2] == 300


def test_regressors_are_compared_at_fifty_rounds(spark, monkeypatch):
    args, named = call_of(monkeypatch, spark, trained.leaderboard_regressors, "regressor_entries")
    assert named.get("rounds", 50) == 50


def test_forecasts_cover_six_horizons_and_every_regressor(spark, monkeypatch):
    args, _ = call_of(monkeypatch, spark, trained.forecast_horizons, "linear_forecasts")
    assert args[0].select("horizon").distinct().count() == 6
    args, _ = call_of(monkeypatch, spark, trained.forecast_search, "searched_forecasts")
    ready, _, entries = args
    assert ready.select("horizon").distinct().count() == 6 and ready.select(F.size("features")).first()[0] == 5
    assert len(entries) == len({e.name for e in entries}) == 31
    ready.unpersist()


def test_a_failing_forecast_candidate_is_reported(spark):
    frame = spark.range(120).select(F.col("id").alias("t"), F.sin(F.col("id") / 5).alias("v"))
    ready = scaled_features(horizon_table(frame, "t", "v", {"one": 1}, lags=2), ["lag_1", "lag_2"]).persist()
    sigmoid = next(e for e in forecast_entries("position", "target") if "sigmoid" in e.name)
    out = searched_forecasts(ready, "t", [Entry("line", LinearScore(labelCol="target", loss="squared", C=1e6)), sigmoid])
    found = {r["candidate"]: r for r in out["search"].collect()}
    assert found["line"]["mean"] > 0.9 and found["line"]["error"] is None
    assert found[sigmoid.name]["mean"] is None and "sigmoid" in found[sigmoid.name]["error"]
    assert out["metrics"].first()["candidate"] == "line"
    ready.unpersist()


def test_candidates_searched_together_score_as_alone(spark):
    """Neighbours and rbf machines to rounding; trees nearly, for their bins come from all folds."""
    frame = spark.range(150).select(F.col("id").alias("t"), (F.sin(F.col("id") / 5) + 0.1 * F.sin(F.col("id") * 7.3)).alias("v"))
    ready = scaled_features(horizon_table(frame, "t", "v", {"one": 1, "two": 4}, lags=3), ["lag_1", "lag_2", "lag_3"])
    ready = as_vector(ready).withColumn("key", F.col("position")).persist()
    every = forecast_entries("key", "target", rounds=5, components=16)
    chosen = [next(e for e in every if e.name.startswith(name)) for name in ("neighbors n_neighbors=4", "svr kernel=rbf", "tree", "boosting loss=lad max_depth=3")]
    scores = []
    for entries in (chosen, [replace(e, shared=None) for e in chosen]):
        out = searched_forecasts(ready, "t", entries, folds=2)["search"]
        scores.append({(r["horizon"], r["candidate"]): (r["mean"], r["error"]) for r in out.collect()})
    together, alone = scores
    assert together.keys() == alone.keys() and len(alone) == 8 and not any(e for _, e in [*together.values(), *alone.values()])
    for cell, (mean, _) in alone.items():
        assert together[cell][0] == pytest.approx(mean, abs=1e-3 if cell[1].startswith(("neigh", "svr")) else 0.3)
    ready.unpersist()
