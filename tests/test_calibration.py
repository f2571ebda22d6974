"""Out-of-sample probabilities without leaks, their Platt step, the queries over them, and status files by their time of change."""

from __future__ import annotations

import datetime
import json
import os
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import calibration
from tapeloom.plans import jobs, scanner, trading
from tapeloom.sources import events
from tapeloom.sources.bars import bars_orders
from tapeloom.sources.shared import cut, files, new_folder

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    parts = []
    for s in "abcdef":
        x = rng.normal(size=(300, 2))
        y = (x[:, 0] + 0.7 * rng.normal(size=300) > 0).astype(float)
        parts.append(pd.DataFrame({"symbol": s, "date": pd.date_range("2020-01-01", periods=300).date, "f": x[:, 0], "g": x[:, 1], "y": y}))
    return cut(spark.createDataFrame(pd.concat(parts)))


def fitted(spark, rows, **more):
    path = new_folder(spark, "models")
    return path, calibration.fit(rows, path, ("f", "g"), **more).toPandas().sort_values(["symbol", "date"], ignore_index=True)


def test_probabilities_of_learnable_labels(spark, rows):
    path, got = fitted(spark, rows)
    assert got["fold"].nunique() == 4 and 1100 < len(got) < 1500 and ((got["prob"] > 0.5) == (got["y"] > 0)).mean() > 0.75
    high = got[(got["prob"] > 0.75) & (got["fold"] > 1)]
    assert abs(high["y"].mean() - high["prob"].mean()) < 0.06
    again = calibration.score(rows, path, 3).join(spark.createDataFrame(got[got["fold"] == 3][["symbol", "date", "prob"]].rename(columns={"prob": "want"})), ["symbol", "date"])
    assert again.where("abs(prob - want) > 1e-12").count() == 0 and again.count() > 200  # the stored models give the same


def test_folds_do_not_see_what_follows(spark, rows):
    """Labels from shortly before a fold on turned over: the scores of that fold and those before it stay."""
    edges = calibration.spans(rows)
    _, want = fitted(spark, rows)
    turned = rows.withColumn("y", F.when(F.col("date") >= F.lit(edges[2] - datetime.timedelta(days=calibration.EMBARGO_DAYS)), 1 - F.col("y")).otherwise(F.col("y")))
    _, got = fitted(spark, cut(turned))
    early = want["fold"] <= 3
    assert np.allclose(got["prob"][early], want["prob"][early]) and not np.allclose(got["prob"][~early], want["prob"][~early], atol=1e-3)


def test_platt_equals_newton(spark):
    rng = np.random.default_rng(9)
    m = rng.normal(size=800)
    y = (rng.random(800) < 1 / (1 + np.exp(-(1.7 * m - 0.4)))).astype(float)
    model = calibration.platt(spark.createDataFrame(pd.DataFrame({"margin": m, "y": y})))
    x, b = np.column_stack([m, np.ones(800)]), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        b += np.linalg.solve(x.T * (p * (1 - p)) @ x, x.T @ (y - p))
    assert np.allclose([model.coefficients[0], model.intercept], b, atol=1e-5)


def test_the_probability_queries_take_a_table(spark):
    bars = bars_orders(spark, DATA)
    table = cut(bars.select("symbol", "date", (0.3 + F.pmod(F.xxhash64("symbol", "date"), F.lit(40)) / 100).alias("prob")))
    for q in (trading.perf_metrics, trading.prob_backtest, trading.post_cv_validation, trading.prob_drift, trading.fold_metrics, trading.prob_threshold, trading.t2_backtest, jobs.candidates, jobs.bulk_edge, jobs.winners, jobs.confident, scanner.flagship_sector_score, scanner.top_picks):
        assert set(q(spark, DATA, table).columns) == set(q(spark, DATA).columns)
    mean = {r.symbol: r.mean for r in trading.prob_drift(spark, DATA, table).collect()}
    want = trading.history(spark, DATA).select("symbol", "date").join(table, ["symbol", "date"]).groupBy("symbol").agg(F.avg("prob").alias("p")).collect()
    assert all(abs(mean[r.symbol] - r.p) < 1e-6 for r in want)


def test_newest_status_file(spark, tmp_path):
    root = tmp_path / "jobs"
    for k, (job, status) in enumerate([("cv", "running"), ("cv", "failed"), ("risk", "done"), ("cv", "completed")]):
        (root / f"day{k % 2}").mkdir(parents=True, exist_ok=True)
        at = root / f"day{k % 2}" / f"{9 - k}.json"
        at.write_text(json.dumps({"job": job, "status": status, "detail": str(k)}, indent=1))
        os.utime(at, (1_700_000_000 + [5, 30, 20, 10][k],) * 2)
    (root / "broken.json").write_text('{"job": "cv", "sta')
    (root / "note.txt").write_text("no event")
    x = events.read_events(spark, str(root))
    assert x.count() == 5
    got = {r.job: (r.status, r.detail) for r in events.latest_events(x).collect()}
    assert got == {"cv": ("failed", "1"), "risk": ("done", "2")}
    newest = events.latest_events(x, ()).first()
    assert newest.status == "failed" and newest.file.endswith("8.json")


def test_read_events_are_archived(spark, tmp_path):
    root, archive = tmp_path / "pending", tmp_path / "archive"
    root.mkdir()
    seen, check = [], new_folder(spark, "state")

    def run():
        q = events.follow_events(spark, str(root), str(archive)).writeStream.foreachBatch(lambda b, n: seen.extend(r.job for r in b.collect())).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()

    for job in ("a", "b", "c"):
        (root / f"{job}.json").write_text(json.dumps({"job": job, "status": "done"}))
        run()
    deadline = time.time() + 20
    while len(list(root.glob("*.json"))) > 1 and time.time() < deadline:
        time.sleep(0.2)
    assert seen == ["a", "b", "c"] and len(files(spark, str(archive))) >= 2  # the last batch's files move with the next batch
