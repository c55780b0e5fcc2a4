"""The model queries' predictions against a computation by hand."""

from math import isclose, sqrt

from pyspark.sql import functions as F

from cyclewise import config
from cyclewise.functions import scalars as S
from cyclewise.operators import models
from cyclewise.plans import catalog, q_model, views


def scored(spark, small):
    model, rows = q_model._model(views.Fleet(config.prepare(spark), small))
    labelled = models.score(model, rows).withColumn("engine", S.engine_id(rows.unit))
    return labelled.select("split", "engine", "cycle", "label", "pred_norm").collect()


def test_rmse(spark, small):
    errors = {}
    for r in scored(spark, small):
        errors.setdefault(r.split, []).append(min(max(r.pred_norm * 125, 0), 125) - r.label)
    got = {r.split: r.rmse for r in catalog.queries()["train_rul_model_rmse"](spark, small).collect()}
    assert got.keys() == errors.keys() == {"train", "val"}
    assert all(isclose(got[s], sqrt(sum(e * e for e in own) / len(own)), rel_tol=1e-9) for s, own in errors.items())


def test_records(spark, small):
    last = {}
    for r in scored(spark, small):
        if r.engine not in last or r.cycle > last[r.engine].cycle:
            last[r.engine] = r
    records = catalog.queries()["batch_score_records"](spark, small).collect()
    assert len(records) == len(last) > 0 and {r.engine_id for r in records} == last.keys()
    for r in records:
        rul = min(max(last[r.engine_id].pred_norm, 0), 1) * 125
        level = next((n for n, cut in (("CRITICAL", 0.8), ("HIGH", 0.6), ("MEDIUM", 0.3)) if r.failure_risk >= cut), "LOW")
        assert r.cycle == last[r.engine_id].cycle and r.confidence == 1.0 and r.risk_level == level
        assert abs(r.remaining_cycles - rul) <= 0.5 + 1e-6 and abs(r.failure_risk - (1 - rul / 125)) <= 0.0005 + 1e-6


def test_history_and_restored_trees(spark, small):
    """Each round's loss is that of the first trees alone, and the model keeps those of the first smallest validation loss."""
    _, rows = q_model._model(views.Fleet(config.prepare(spark), small))
    model, history = models.train_with_history(rows, trees=6, depth=3)
    told = sorted(map(tuple, history.collect()))
    assert [r[0] for r in told] == [1, 2, 3, 4, 5, 6]
    best = min(told, key=lambda r: (r[2], r[0]))[0]
    kept = model.stages[-1]
    assert kept.getNumTrees == best
    full = models.train(rows, trees=6, depth=3).stages[-1]
    points = model.stages[0].transform(rows).select("split", "y", "features").collect()
    for n in (1, best, 6):
        errors = {"train": [], "val": []}
        for p in points:
            guess = sum(w * t.predict(p.features) for w, t in zip(full.treeWeights[:n], full.trees[:n]))
            errors[p.split].append((p.y - guess) ** 2)
        epoch, loss, val_loss, error, val_error = told[n - 1]
        assert isclose(loss, sum(errors["train"]) / len(errors["train"]), rel_tol=1e-9) and isclose(error, sqrt(loss))
        assert isclose(val_loss, sum(errors["val"]) / len(errors["val"]), rel_tol=1e-9) and isclose(val_error, sqrt(val_loss))
        if n == best:
            got = [r.prediction for r in kept.transform(model.stages[0].transform(rows)).collect()]
            assert len(got) == len(points)


def test_boosting_ends_when_it_gets_worse(spark):
    """A target that the train units know and the others contradict: the first worse round is the last."""
    rows = spark.range(400).selectExpr(
        "id % 40 as unit", "id as cycle", "0L as label", "if(id % 5 = 0, 'val', 'train') as split", "cast(id % 2 as double) as x",
        "cast(id % 7 as double) as z", "if(id % 5 = 0, -1, 1) * (id % 2 + id % 7 * 0.1D) as y", "1.0D as weight",
    )
    early, short = models.train_with_history(rows, trees=8, depth=1, stop_early=True)
    whole, long = models.train_with_history(rows, trees=8, depth=1)
    assert long.count() == 8 and short.count() < 8 and early.stages[-1].getNumTrees == whole.stages[-1].getNumTrees == 1


def test_history_query(spark, small):
    rows = sorted(catalog.queries()["training_history"](spark, small).collect())
    assert [r.epoch for r in rows] == list(range(1, len(rows) + 1))
    (kept,) = [r for r in rows if r.restored]
    assert kept.val_loss == min(r.val_loss for r in rows) and all(r.val_loss > kept.val_loss for r in rows[: kept.epoch - 1])
    model, _ = q_model._model(views.Fleet(config.prepare(spark), small))
    assert model.stages[-1].getNumTrees == kept.epoch


def test_model_is_held_against_the_mean_in_the_error_it_was_fitted_for(spark):
    """Readings that say next to nothing: the weights move the model off the mean label, so that its plain error is the larger one."""
    rows = spark.range(4000).selectExpr(
        "id % 100 as unit", "id as cycle", "xxhash64(id) % 63 + 62 as label", "if(id % 5 = 0, 'val', 'train') as split",
        "cast(id % 2 as double) as x",
    )
    rows = rows.selectExpr("*", "label / 125D as y", "1 + 1.5D * label / 125 as weight")
    model, _ = models.train_with_history(rows, trees=2, depth=1)
    told = {r.split: r for r in q_model.model_check(model, rows).collect()}
    plain = [((r.pred_norm * 125) - r.label) ** 2 for r in models.score(model, rows).where("split = 'train'").collect()]
    assert sqrt(sum(plain) / len(plain)) > told["train"].baseline and told["train"].within and told["val"].within
    worse = q_model.model_check(model, rows.withColumn("x", F.lit(0.0)).withColumn("label", F.lit(125) - rows.label)).collect()
    assert not {r.split: r for r in worse}["train"].within
