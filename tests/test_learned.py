"""Ridge against the closed form, trees against their definition, recursions against step-by-step scoring, the freeze."""

import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from demandloom.catalog.domain import Retail
from demandloom.operators import folds as fo
from demandloom.operators import learned as ln
from demandloom.operators import ridge as rd
from demandloom.operators import selection as sl
from demandloom.operators import trees as tr
from demandloom.sources import parameters as P
from demandloom.sources.parameters import SERIES

QUICK = {"histogram": tr.BASE["histogram"] | {"rounds": 8, "rate": 0.3}, "depthwise": tr.BASE["depthwise"] | {"rounds": 8, "rate": 0.3, "depth": 3}}


@pytest.fixture(scope="module")
def domain(spark, folder):
    return Retail(spark, folder)


@pytest.fixture(scope="module")
def training(domain):
    return fo.training_rows(domain.features).where("fold = 'f1'").cache()


@pytest.fixture(scope="module")
def weights(training):
    return rd.fit_ridge(training).cache()


@pytest.fixture(scope="module")
def nodes(training):
    return tr.fit_trees(tr.training_table(training), QUICK, ["f1"]).cache()


def made_up(n=600, seed=1):
    draw = np.random.default_rng(seed)
    frame = pd.DataFrame({c: draw.choice(list("abcdefgh"[: 2 + i]), n) for i, c in enumerate(ln.CATEGORICAL)})
    for c in tr.NUMERIC:
        frame[c] = draw.integers(0, 5, n).astype(float) if len(c) % 2 else draw.normal(size=n)
    return frame.assign(label=frame["sales_lag_1"] * 2 + (frame["item_id"] == "b") * 5 + draw.normal(size=n))


def design(frame, categories):
    hot = [(frame[c].to_numpy(object) == v).astype(float) for c in ln.CATEGORICAL for v in categories[c]]
    numbers = [frame[c].to_numpy(float) for c in tr.NUMERIC]
    return np.stack(hot + [(x - x.mean()) / (x.std() or 1.0) for x in numbers], 1)


def test_ridge_is_the_closed_form(spark):
    frame = made_up()
    rows = spark.createDataFrame(frame.assign(fold="f", sales=frame["label"]))
    got = {(r.column_name, r.category): r.weight for r in rd.fit_ridge(rows, alpha=2.5).collect()}
    categories = {c: sorted(frame[c].unique()) for c in ln.CATEGORICAL}
    x, y = design(frame, categories), frame["label"].to_numpy()
    centred = x - x.mean(0)
    want = np.linalg.solve(centred.T @ centred + 2.5 * np.eye(x.shape[1]), centred.T @ (y - y.mean()))
    names = [(c, v) for c in ln.CATEGORICAL for v in categories[c]] + [(c, None) for c in tr.NUMERIC]
    assert np.allclose([got[k] for k in names], want, atol=1e-8)
    assert got[rd.INTERCEPT, None] == pytest.approx(y.mean() - x.mean(0) @ want, abs=1e-8)


def test_ridge_takes_ten_thousand_items(spark):
    n = 30_000
    columns = [F.concat(F.lit("item"), (F.col("id") % 10_000).cast("string")).alias("item_id"), F.lit("s").alias("store_id")]
    columns += [F.lit("x").alias(c) for c in ln.CATEGORICAL if c not in SERIES]
    columns += [F.pmod(F.xxhash64("id", F.lit(c)), F.lit(97)).cast("double").alias(c) for c in tr.NUMERIC]
    rows = spark.range(n).select(F.lit("f").alias("fold"), *columns, F.pmod(F.xxhash64("id"), F.lit(50)).alias("sales"))
    fitted = rd.fit_ridge(rows)
    assert fitted.count() == 10_000 + 6 + len(tr.NUMERIC) + 1
    assert rd.gradient(rows, fitted).agg(F.max(F.abs("gradient"))).first()[0] < 1e-6


def test_ridge_gradient_vanishes_on_the_panel(training, weights):
    assert rd.gradient(training, weights).agg(F.max(F.abs("gradient"))).first()[0] < 1e-6


def test_category_without_a_weight_scores_finite(training, weights):
    odd = training.limit(3).withColumn("event_name_1", F.lit("NeverSeen"))
    assert all(np.isfinite(r.score) for r in rd.score(odd, weights).collect())


def naive_split(frame, codes, gradient, setting):
    """Best gain over every single cut, for one-hot categories and sorted category sets."""
    def gain(left):
        n, m = left.sum(), (~left).sum()
        if min(n, m) < setting["least"]:
            return -np.inf
        p, g = setting["penalty"], gradient
        return g[left].sum() ** 2 / (n + p) + g[~left].sum() ** 2 / (m + p) - g.sum() ** 2 / (len(g) + p)
    best = -np.inf
    for c in tr.NUMERIC:
        for v in np.unique(frame[c])[:-1]:
            best = max(best, gain(frame[c].to_numpy() <= v))
    for c in ln.CATEGORICAL:
        kinds = frame[c].to_numpy(object)
        if setting["family"] == "depthwise":
            best = max([best, *(gain(kinds == v) for v in np.unique(frame[c]))])
        else:
            mean = {v: gradient[kinds == v].sum() / ((kinds == v).sum() + tr.SET_ROWS) for v in np.unique(frame[c]) if (kinds == v).sum() >= tr.SET_ROWS}
            order = sorted(mean, key=mean.get)
            best = max([best, *(gain(np.isin(kinds, order[: i + 1])) for i in range(len(order)))])
    return best


@pytest.mark.parametrize("family", list(tr.BASE))
def test_best_split_is_the_best_of_all_cuts(family):
    frame = made_up(200, 5)
    for c in tr.NUMERIC:
        frame[c] = frame[c].round(1)
    bins, gradient = tr.Bins(frame), np.random.default_rng(2).normal(size=200)
    setting = tr.BASE[family]
    got, _, _ = tr.best_split(bins, bins.histogram(np.arange(200), gradient), setting, bins.splits)
    assert got == pytest.approx(naive_split(frame, None, gradient, setting), abs=1e-9)


@pytest.mark.parametrize("family", list(tr.BASE))
def test_boosting_fits_and_its_tables_predict_the_same(family):
    frame = made_up()
    trees, base, fitted = tr.boost(frame, tr.BASE[family] | {"rounds": 30, "rate": 0.2})
    error = lambda f: ((frame["label"] - f) ** 2).mean()
    assert error(fitted) < 0.3 * error(base) and base == pytest.approx(frame["label"].mean())
    model = tr.Ensemble(trees, base)
    codes = [model.codes(f, frame[c].to_numpy(object)) for f, c in enumerate(ln.CATEGORICAL)]
    assert np.allclose(model.predict(np.stack([*codes, *(frame[c].to_numpy(float) for c in tr.NUMERIC)], 1)), fitted)
    for tree in trees:
        leaves = [n for n in tree if n["left"] < 0]
        assert len(leaves) <= (31 if family == "histogram" else 64) and len(tree) == 2 * len(leaves) - 1


def test_five_thousand_categories():
    frame = made_up(20_000, 3)
    frame["item_id"] = [f"item{i % 5000}" for i in range(20_000)]
    frame["label"] = frame["label"] + (frame["item_id"].str[-1] == "7") * 30
    for family in tr.BASE:
        _, base, fitted = tr.boost(frame, tr.BASE[family] | {"rounds": 3, "rate": 0.5, "least": 3})
        assert np.isfinite(fitted).all() and ((frame["label"] - fitted) ** 2).mean() < ((frame["label"] - base) ** 2).mean()


def test_fit_does_not_depend_on_partitioning(training, nodes):
    again = tr.fit_trees(tr.training_table(training.repartition(7, "date")), QUICK, ["f1"])
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(again) == plain(nodes)


def test_fit_rows_are_a_documented_bound(training):
    n = training.count()
    assert tr.training_table(training).count() == n
    assert 0.3 * n < tr.training_table(training, n // 2).count() < 0.7 * n


def _features(v):
    return (v[-1], v[-7], v[-14], v[-28], *[float(np.mean(v[-n:])) for n in (7, 14, 28)], *[float(np.std(v[-n:], ddof=1)) for n in (7, 28)])


@pytest.mark.parametrize("family", ["ridge", "histogram", "depthwise"])
def test_recursion_feeds_predictions_back(domain, weights, nodes, family):
    states = ln.origin_states(domain.origins).where("fold = 'f1'")
    context = ln.fold_context(domain.features).where("fold = 'f1'")
    models = {k: m for k, m in tr.ensembles(nodes).items() if k[1] == family}
    made = rd.recursive_forecast(weights, states, context) if family == "ridge" else tr.recursive_forecast(models, states, context)
    got = {(r.store_id, r.item_id, r.horizon_day): r.raw_forecast for r in made.collect()}
    assert len(got) == P.HORIZON * states.count()
    state = {(r.store_id, r.item_id): list(r.state) for r in states.collect()}
    for day in (1, 2, 3):
        step = context.where(F.col("date") == F.date_add(F.lit(P.FOLDS[0][1]).cast("date"), day - 1))
        rows = [(s, i, *_features(v)) for (s, i), v in state.items()]
        demand = domain.spark.createDataFrame(rows, "store_id string, item_id string, " + ", ".join(f"{c} double" for c in ln.RECURSIVE))
        given = step.join(demand, SERIES)
        scored = rd.score(given, weights) if family == "ridge" else tr.score_rows(models, given)
        for r in scored.collect():
            assert got[r.store_id, r.item_id, day] == pytest.approx(r.score, abs=1e-7)
            state[r.store_id, r.item_id] = state[r.store_id, r.item_id][1:] + [max(r.score, 0.0)]


def test_forecast_api_needs_whole_context(domain, weights):
    states = ln.origin_states(domain.origins).where("fold = 'f1'")
    short = ln.fold_context(domain.features).where((F.col("fold") == "f1") & (F.col("date") == P.FOLDS[0][1]))
    with pytest.raises(Exception, match="one row per series and target day"):
        sl.produce("ridge", weights, states, short, 7).collect()
    with pytest.raises(ValueError):
        sl.produce("ridge", weights, states, short, 5)
    assert sl.produce("mean", None, states, short, 1).count() == states.count()


def test_bundle_contract_is_checked(spark, tmp_path, weights):
    path = sl.save_bundle(weights, "ridge", str(tmp_path / "ridge"))
    assert sl.load_bundle(spark, path)[0] == "ridge"
    weights.drop("weight").write.mode("overwrite").parquet(f"{path}/model")
    with pytest.raises(ValueError, match="lacks"):
        sl.load_bundle(spark, path)
    spark.createDataFrame([("ridge", ["other"], [1, 7, 30])], sl.CONTRACT_SCHEMA).write.mode("overwrite").parquet(f"{path}/contract")
    with pytest.raises(ValueError, match="other predictors"):
        sl.load_bundle(spark, path)


def test_locked_window_opens_once_after_a_freeze(spark, tmp_path):
    ranking = spark.createDataFrame([("b", 1, 1.5), ("a", 1, 1.5), ("c", 3, 2.0)], "model_name string, selection_rank int, balanced_rank_score double")
    folder = str(tmp_path)
    with pytest.raises(PermissionError, match="no selection"):
        sl.open_locked_run(spark, folder)
    assert sl.freeze(spark, ranking, folder) == "a"
    with pytest.raises(PermissionError, match="already"):
        sl.freeze(spark, ranking, folder)
    outcomes = []

    def run():
        try:
            outcomes.append(sl.open_locked_run(spark, folder))
        except PermissionError:
            outcomes.append(None)

    runs = [threading.Thread(target=run) for _ in range(4)]
    [r.start() for r in runs], [r.join() for r in runs]
    assert sorted(outcomes, key=str) == [None, None, None, "a"]
