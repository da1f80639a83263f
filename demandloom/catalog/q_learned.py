"""Learned forecasters: encodings, fits, recursive forecasts, tuning, selection, persistence.

A fitted model has no SQL form. These queries return what SQL can state about it: counts, the optimality of the fit,
equality of two ways to the same forecast, and the sums that any correct ranking has.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.catalog.q_features import rounded
from demandloom.catalog.registry import query
from demandloom.functions.quantiles import quantiles
from demandloom.operators import folds as fo
from demandloom.operators import forecast as fc
from demandloom.operators import learned as ln
from demandloom.operators import metrics as mt
from demandloom.operators import ranking as rk
from demandloom.operators import ridge as rd
from demandloom.operators import selection as sl
from demandloom.operators import trees as tr
from demandloom.sources import parameters as P
from demandloom.sources import sinks
from demandloom.sources.parameters import SERIES
from demandloom.sources.tables import through_date

TRAIN = "t AS (SELECT f.*, fold FROM features f JOIN fold_table ON date < start_date WHERE is_feature_ready)"
WINDOW = "w AS (SELECT f.*, fold, start_date, end_date FROM features f JOIN fold_table ON date BETWEEN start_date AND end_date)"
CATS = "c AS (" + " UNION ALL ".join(
    f"SELECT fold, '{c}' AS column_name, coalesce({c}, '__NONE__') AS category, count(*) AS n_rows FROM t GROUP BY 1, 3" for c in ln.CATEGORICAL) + ")"
CODES = "k AS (SELECT *, row_number() OVER (PARTITION BY fold, column_name ORDER BY category) - 1 AS code FROM c)"
LEARNED = ["ridge", *tr.BASE]
LEARNED_SQL = "(SELECT unnest([" + ", ".join(f"'{m}'" for m in LEARNED) + "]) AS model_name)"


@query("ml_03_one_hot_categories", f"WITH {TRAIN}, {CATS}, {CODES} SELECT fold, column_name, category, n_rows, CAST(code AS INTEGER) AS code FROM k")
def one_hot_categories(d):
    return ln.category_table(fo.training_rows(d.features), "fold")


@query("ml_04_ordinal_codes", f"""
WITH {TRAIN}, {WINDOW}, {CATS}, {CODES}, v AS ({" UNION ALL ".join(f"SELECT fold, '{c}' AS column_name, coalesce({c}, '__NONE__') AS category, count(*) AS n_rows FROM w GROUP BY 1, 3" for c in ln.CATEGORICAL)})
SELECT v.fold, v.column_name, v.category, CAST(coalesce(code, -1) AS INTEGER) AS code, v.n_rows FROM v LEFT JOIN k USING (fold, column_name, category)""")
def ordinal_codes(d):
    """All categorical predictors of the target days, coded by the training rows of their fold."""
    known = ln.category_table(fo.training_rows(d.features), "fold").select("fold", "column_name", "category", "code")
    seen = ln.category_counts(fo.fold_rows(d.features), "fold")
    return seen.join(known, ["fold", "column_name", "category"], "left").withColumn("code", F.coalesce("code", F.lit(-1)))


@query("ml_05_standard_scaling", f"WITH {TRAIN} SELECT fold, feature, n_rows, round(mean, 6) AS mean, round(deviation, 6) AS deviation FROM (" + " UNION ALL ".join(
    f"SELECT fold, '{c}' AS feature, count({c}) AS n_rows, avg({c}::DOUBLE) AS mean, stddev_pop({c}::DOUBLE) AS deviation FROM t GROUP BY 1" for c in ln.KNOWN_NUMERIC + ln.RECURSIVE) + ")")
def standard_scaling(d):
    return rounded(ln.scaling_table(fo.training_rows(d.features), "fold"), ["mean", "deviation"])


@query("ml_06_median_imputation", f"WITH {TRAIN} " + " UNION ALL ".join(
    f"SELECT fold, '{c}' AS feature, quantile_cont({c}::DOUBLE, 0.5) AS median FROM t GROUP BY 1" for c in tr.NUMERIC))
def median_imputation(d):
    """Training medians of all numeric predictors."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in tr.NUMERIC])
    rows = fo.training_rows(d.features).select("fold", F.inline(pairs)).where("value IS NOT NULL")
    return quantiles(rows, "value", {"median": 0.5}, ["fold", "feature"])


@query("ml_07_ridge_optimality", f"""
WITH {TRAIN}, {CATS}, n AS (SELECT fold, count(*) AS training_rows FROM t GROUP BY 1), k AS (
  SELECT fold, column_name, count(*) AS n_weights FROM c GROUP BY 1, 2
  UNION ALL SELECT fold, unnest([{", ".join(f"'{c}'" for c in [*tr.NUMERIC, rd.INTERCEPT])}]), 1 FROM n)
SELECT fold, column_name, n_weights, training_rows, true AS is_optimal FROM k JOIN n USING (fold)""")
def ridge_optimality(d):
    """Per fold and predictor: weights, and whether the gradient of the penalised squares vanishes (below 1e-6) there."""
    slopes = rd.gradient(fo.training_rows(d.features), d.ridge_weights)
    sizes = d.ridge_weights.groupBy("fold").agg(F.max("training_rows").alias("training_rows"))
    return slopes.groupBy("fold", "column_name").agg(
        F.count(F.lit(1)).alias("n_weights"), (F.max(F.abs("gradient")) < 1e-6).alias("is_optimal")).join(sizes, "fold")


@query("ml_08_boosted_tree_fit", f"""
WITH {TRAIN}, n AS (SELECT fold, count(*) AS training_rows, round(avg(sales::DOUBLE), 6) AS base FROM t GROUP BY 1),
s AS (SELECT unnest(['histogram', 'depthwise']) AS configuration, unnest([{tr.BASE["histogram"]["rounds"]}, {tr.BASE["depthwise"]["rounds"]}]) AS rounds)
SELECT fold, configuration, CAST(rounds AS BIGINT) AS rounds, training_rows, base, true AS within_size, true AS fits_better_than_base, 0::BIGINT AS misplaced_rows FROM n, s""")
def boosted_tree_fit(d):
    """Both families, base settings, all folds. ``misplaced_rows``: difference between the rows that the first cut of a
    tree fitted on all rows sent left and those that meet its condition in the training table."""
    nodes, training = d.tree_nodes, d.tree_training
    leaves = nodes.where("left < 0").groupBy("fold", "configuration", "tree").agg(F.count(F.lit(1)).alias("leaves"))
    most = leaves.groupBy("fold", "configuration").agg(F.count(F.lit(1)).alias("rounds"), F.max("leaves").alias("leaves"))
    facts = nodes.groupBy("fold", "configuration").agg(*[F.max(c).alias(c) for c in ("base", "training_rows", "training_mae")])
    names = F.col("configuration") == "histogram"
    plain = training.join(facts.where(names).select("fold", "base"), "fold").groupBy("fold").agg(F.avg(F.abs(F.col("label") - F.col("base"))).alias("base_mae"))
    first = nodes.where(names & (F.col("tree") == 0) & F.col("node").isin(0, 1)).groupBy("fold").agg(
        *[F.max(F.when(F.col("node") == 0, F.col(c))).alias(c) for c in ("feature", "threshold", "members")],
        F.max(F.when(F.col("node") == 1, F.col("n_rows"))).alias("went_left"))
    value = F.create_map(*[x for c in tr.NUMERIC for x in (F.lit(c), F.col(c))])[F.col("feature")]
    kind = F.create_map(*[x for c in ln.CATEGORICAL for x in (F.lit(c), F.col(c))])[F.col("feature")]
    meets = F.when(F.col("members").isNotNull(), F.array_contains("members", kind)).otherwise(value <= F.col("threshold"))
    left = training.join(F.broadcast(first), "fold").groupBy("fold").agg((F.count_if(meets) - F.max("went_left")).alias("misplaced"))
    joined = facts.join(most, ["fold", "configuration"]).join(plain, "fold").join(left, "fold")
    size = F.when(names, F.lit(tr.BASE["histogram"]["leaves"])).otherwise(1 << tr.BASE["depthwise"]["depth"])
    return rounded(joined.select(
        "fold", "configuration", "rounds", "training_rows", "base", (F.col("leaves") <= size).alias("within_size"),
        (F.col("training_mae") < F.col("base_mae")).alias("fits_better_than_base"), F.when(names, F.col("misplaced")).otherwise(0).alias("misplaced_rows")), ["base"])


@query("ml_09_fold_wise_evaluation", f"""
WITH {WINDOW} SELECT model_name, fold, count(*) AS observations, CAST(sum(sales) AS DOUBLE) AS actual_sum, true AS error_is_plausible FROM w, {LEARNED_SQL} GROUP BY 1, 2""")
def fold_wise_evaluation(d):
    """Every learned model on every fold; plausible: its error is at most 1.5 times that of the 28-day mean."""
    scored = mt.basic_metrics(d.learned_predictions, "model_name", "fold")
    mean = mt.basic_metrics(d.predictions.where("model_name = 'mean_28'"), "fold").select("fold", F.col("mae").alias("mean_mae"))
    return scored.join(mean, "fold").select(
        "model_name", "fold", "observations", F.col("actual_sum").cast("double").alias("actual_sum"), (F.col("mae") <= 1.5 * F.col("mean_mae")).alias("error_is_plausible"))


@query("ml_10_limited_tree_tuning", f"""
WITH {WINDOW}, n AS (SELECT count(*) AS observations FROM w)
SELECT setting, observations, 3::BIGINT AS folds, 21.0::DOUBLE AS position_sum, true AS best_is_no_worse_than_base FROM n, (SELECT CAST(unnest([0, 1, 2, 3, 4, 5]) AS INTEGER) AS setting)""")
def limited_tree_tuning(d):
    """The better tree family over its six settings on all folds, best mean error first."""
    scored = d.tuned_predictions.withColumn("setting", F.regexp_extract("model_name", "_([0-9])$", 1).cast("int"))
    errors = scored.groupBy("setting").agg(
        F.round(F.avg(F.abs(F.col("forecast") - F.col("actual"))), 9).alias("mae"), F.count(F.lit(1)).alias("observations"), F.count_distinct("fold").alias("folds"))
    ranked = errors.withColumn("_all", F.lit(1)).withColumn("position", rk.rank_average(["_all"], "mae"))
    best = ranked.agg(F.min("mae").alias("best"), F.max(F.when(F.col("setting") == 0, F.col("mae"))).alias("base"), F.sum("position").alias("position_sum"))
    return ranked.join(F.broadcast(best)).select(
        "setting", "observations", "folds", "position_sum", (F.col("best") <= F.col("base")).alias("best_is_no_worse_than_base"))


@query("ml_11_preprocessing_audits", f"""
WITH {TRAIN}, {CATS}, w AS (SELECT f.*, fold FROM features f JOIN fold_table ON date BETWEEN start_date AND end_date),
s AS ({" UNION ALL ".join(f"SELECT DISTINCT fold, '{c}' AS column_name, coalesce({c}, '__NONE__') AS category FROM w" for c in ln.CATEGORICAL)})
SELECT c.fold, c.column_name, count(*) AS training_categories, CAST(sum(n_rows) AS BIGINT) AS encoder_rows,
  (SELECT count(*) FROM (SELECT fold, column_name, category FROM s EXCEPT SELECT fold, column_name, category FROM c) e WHERE e.fold = c.fold AND e.column_name = c.column_name) AS unseen_categories FROM c GROUP BY 1, 2""")
def preprocessing_audits(d):
    categories = ln.category_table(fo.training_rows(d.features), "fold")
    return ln.unseen_categories(fo.fold_rows(d.features), categories, "fold")


HORIZONS_SQL = "(SELECT CAST(unnest([1, 7, 30]) AS INTEGER) AS horizon)"
FAMILIES_SQL = "(SELECT unnest(['mean', 'ridge', 'trees']) AS family)"


def fold_three(d, horizon):
    """States, context and models of the last fold for a horizon: (states, context, {family: model rows})."""
    start = F.lit(P.FOLDS[2][1]).cast("date")
    states = ln.origin_states(d.origins).where("fold = 'f3'")
    context = ln.fold_context(d.features).where((F.col("fold") == "f3") & (F.col("date") < F.date_add(start, horizon)))
    last = {"mean": states.select(*SERIES, F.col("state").alias("recent")), "ridge": d.ridge_weights.where("fold = 'f3'"),
            "trees": d.tree_nodes.where("fold = 'f3' AND configuration = 'histogram'")}
    return states, context, last


@query("ml_12_model_persistence", f"""
WITH {WINDOW} SELECT family, horizon, count(*) AS n_rows, 0::BIGINT AS differing_rows FROM w, {HORIZONS_SQL}, {FAMILIES_SQL}
WHERE fold = 'f3' AND date < start_date + horizon GROUP BY 1, 2""")
def model_persistence(d):
    """Forecasts of a stored and loaded bundle of each family against those of the model it was made from."""
    parts = None
    stored = {}
    for horizon in sl.HORIZONS:
        states, context, models = fold_three(d, horizon)
        for family, model in models.items():
            if family not in stored:
                stored[family] = sl.load_bundle(d.spark, sl.save_bundle(model, family, sinks.scratch_path(d.spark, f"bundle-{family}")))
            before = sl.produce(family, model, states, context, horizon)
            after = sl.produce(*stored[family], states, context, horizon)
            joined = before.join(after.select(*SERIES, "target_date", F.col("forecast").alias("stored")), [*SERIES, "target_date"])
            counted = joined.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.abs(F.col("forecast") - F.col("stored")) > 1e-9).alias("differing_rows"))
            part = counted.select(F.lit(family).alias("family"), F.lit(horizon).alias("horizon"), "n_rows", "differing_rows")
            parts = part if parts is None else parts.unionByName(part)
    return parts


@query("ml_13_frozen_winner_final_fit", f"""
SELECT store_id, item_id, DATE '{P.LOCKED[2]}' AS trained_through, round(avg(sales), 6) AS level FROM active WHERE date > DATE '{P.LOCKED[2]}' - 28 AND date <= DATE '{P.LOCKED[2]}' GROUP BY 1, 2""")
def frozen_winner_final_fit(d):
    table = fc.last_values(through_date(d.active, P.LOCKED[2]))
    return rounded(table.select(*SERIES, "trained_through", fc.mean(F.col("recent"), 28).alias("level")), ["level"])


RECURSION_SQL = """
SELECT {name} AS model_name, fold, count(*) AS n_rows, max(date - start_date) + 1 AS horizon_days, 0::BIGINT AS negative_forecasts, 0::BIGINT AS first_day_differs
FROM w GROUP BY 1, 2"""


def recursion_check(d, forecasts, direct):
    """Rows per model and fold, and first days that differ from a one-step forecast on the true features."""
    joined = forecasts.join(direct.withColumnRenamed("date", "target_date"), ["model_name", "fold", *SERIES, "target_date"], "left")
    return joined.groupBy("model_name", "fold").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("horizon_day").cast("bigint").alias("horizon_days"), F.count_if(F.col("forecast") < 0).alias("negative_forecasts"),
        F.count_if((F.col("horizon_day") == 1) & ~(F.abs(F.col("raw_forecast") - F.col("score")) < 1e-6)).alias("first_day_differs"))


def first_days(d):
    """Feature rows of the first target day of each fold."""
    return fo.fold_rows(d.features).where("date = start_date")


@query("fc_08_recursive_ridge_forecast", f"WITH {WINDOW}" + RECURSION_SQL.format(name="'ridge'"))
def recursive_ridge_forecast(d):
    direct = rd.score(first_days(d), d.ridge_weights).select(F.lit("ridge").alias("model_name"), "fold", *SERIES, "date", "score")
    return recursion_check(d, d.learned_predictions.where("model_name = 'ridge'"), direct)


@query("fc_08_recursive_tree_forecast", f"WITH {WINDOW}, m AS (SELECT unnest(['histogram', 'depthwise']) AS name)" + RECURSION_SQL.format(name="name").replace("FROM w", "FROM w, m"))
def recursive_tree_forecast(d):
    direct = tr.score_rows(tr.ensembles(d.tree_nodes), first_days(d)).withColumnRenamed("configuration", "model_name")
    return recursion_check(d, d.learned_predictions.where(F.col("model_name").isin(*tr.BASE)), direct)


@query("fc_10_forecast_api", f"""
WITH {WINDOW} SELECT family, horizon, count(*) AS n_rows, CAST(horizon AS BIGINT) AS last_day, max(date) AS last_date, 0::BIGINT AS negative_forecasts
FROM w, {HORIZONS_SQL}, {FAMILIES_SQL} WHERE fold = 'f3' AND date < start_date + horizon GROUP BY 1, 2""")
def forecast_api(d):
    """The forecast API over every family and horizon."""
    parts = None
    for horizon in sl.HORIZONS:
        states, context, models = fold_three(d, horizon)
        for family, model in models.items():
            made = sl.produce(family, model, states, context, horizon).agg(
                F.count(F.lit(1)).alias("n_rows"), F.max("horizon_day").cast("bigint").alias("last_day"), F.max("target_date").alias("last_date"),
                F.count_if(F.col("forecast") < 0).alias("negative_forecasts"))
            part = made.select(F.lit(family).alias("family"), F.lit(horizon).alias("horizon"), "*")
            parts = part if parts is None else parts.unionByName(part)
    return parts


@query("fc_14_learned_mutation_audit", f"""
WITH {WINDOW} SELECT fold, model_name, count(*) AS n_rows, 0::BIGINT AS changed_forecasts, count(*) FILTER (sales <> 9999) AS changed_actuals FROM w, {LEARNED_SQL} GROUP BY 1, 2""")
def learned_mutation_audit(d):
    """Every sale from a fold's start on is overwritten; states are rebuilt from the changed panel, forecasts must stay."""
    parts = None
    models, active = tr.ensembles(d.tree_nodes), d.active.join(d.series_bands, SERIES)
    for name, start, end in P.FOLDS:
        changed = fc.mutate_future(active, start)
        states = ln.origin_states(fc.origins(fc.series_history(changed))).where(F.col("fold") == name)
        context = fo.future_context(changed).where(F.col("fold") == name)
        again = rd.recursive_forecast(d.ridge_weights, states, context).withColumn("model_name", F.lit("ridge"))
        mine = {k: v for k, v in models.items() if k[0] == name}
        again = again.unionByName(tr.recursive_forecast(mine, states, context).withColumnRenamed("configuration", "model_name"))
        sold = changed.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select(*SERIES, F.col("date").alias("target_date"), F.col("sales").alias("sold"))
        both = d.learned_predictions.where(F.col("fold") == name).select("fold", "model_name", *SERIES, "target_date", "forecast", "actual").join(
            again.select("model_name", *SERIES, "target_date", F.col("forecast").alias("again")), ["model_name", *SERIES, "target_date"], "left").join(sold, [*SERIES, "target_date"], "left")
        part = both.groupBy("fold", "model_name").agg(
            F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.coalesce(F.abs(F.col("forecast") - F.col("again")) < 1e-9, F.lit(False))).alias("changed_forecasts"),
            F.count_if(~F.col("actual").eqNullSafe(F.col("sold"))).alias("changed_actuals"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


@query("met_07_ranking_with_learned_models", f"""
WITH m AS (SELECT unnest([{", ".join(f"'{m}'" for m in [*P.MODELS, *LEARNED])}]) AS model_name), n AS (SELECT count(*) AS n FROM m)
SELECT model_name, {len(P.HORIZON_SPECS) * 5 + 2 * len(P.FOLDS) + 1}::BIGINT AS comparison_components, round({sum(P.RANK_HORIZON_WEIGHTS.values()) * sum(P.RANK_METRIC_WEIGHTS.values()) + 2 * len(P.FOLDS) * P.RANK_FOLD_WEIGHT + P.RANK_STABILITY_WEIGHT}::DOUBLE, 6) AS total_weight,
  round((n + 1) / 2.0, 6)::DOUBLE AS mean_rank_of_all FROM m, n""")
def ranking_with_learned_models(d):
    """Baselines, ridge and both tree families in one balanced ranking: average ranks of n models have the mean (n + 1) / 2."""
    ranks = rk.balanced_ranking(d.all_metrics)
    mean = ranks.agg(F.avg("balanced_rank_score").alias("mean_rank_of_all"))
    return rounded(ranks.select("model_name", "comparison_components", "total_weight").join(F.broadcast(mean)), ["total_weight", "mean_rank_of_all"])


@query("met_08_learned_against_benchmarks", f"""
WITH {WINDOW}, b AS (SELECT fold, avg(abs(forecast - actual)) AS mean_mae FROM predictions WHERE model_name = 'mean_28' GROUP BY 1)
SELECT model_name, fold, round(mean_mae, 6) AS mean_28_mae, 0::BIGINT AS wrong_improvements FROM b, {LEARNED_SQL}""")
def learned_against_benchmarks(d):
    """Improvements of each learned model over the 28-day mean, recomputed from its prediction rows."""
    parts = None
    for model in LEARNED:
        cube = mt.compare_to_benchmarks(d.all_metrics, model).where("horizon = 'days_1_30_daily' AND segment_type = 'overall' AND fold <> 'combined'")
        own = mt.basic_metrics(d.learned_predictions.where(F.col("model_name") == model), "fold").select("fold", F.col("mae").alias("own_mae"))
        gain = 100 * (F.col("mean_28_mae") - F.col("own_mae")) / F.col("mean_28_mae")
        part = cube.join(own, "fold").select(
            F.lit(model).alias("model_name"), "fold", "mean_28_mae",
            F.when(F.abs(gain - F.col("mae_improvement_vs_mean_28_pct")) < 1e-6, 0).otherwise(1).cast("bigint").alias("wrong_improvements"))
        parts = part if parts is None else parts.unionByName(part)
    return rounded(parts, ["mean_28_mae"])


@query("met_14_raw_negative_diagnostics", f"""
WITH {WINDOW} SELECT model_name, fold, count(*) AS n_rows, true AS counts_agree, true AS clipped_at_zero FROM w, {LEARNED_SQL} GROUP BY 1, 2""")
def raw_negative_diagnostics(d):
    """Raw negatives of every learned model and fold, against the rows that clipping changed."""
    rows = d.learned_predictions
    told = ln.raw_negatives(rows, "model_name", "fold")
    clipped = rows.groupBy("model_name", "fold").agg(
        F.count_if(F.col("forecast") != F.col("raw_forecast")).alias("clipped"), (F.min("forecast") >= 0).alias("clipped_at_zero"))
    agree = (F.col("negative_rows") == F.col("clipped")) & (F.abs(F.col("negative_pct") * F.col("n_rows") / 100 - F.col("clipped")) < 1e-6)
    agree &= F.coalesce(F.col("most_negative") < 0, F.col("clipped") == 0)
    return told.join(clipped, ["model_name", "fold"]).select("model_name", "fold", "n_rows", agree.alias("counts_agree"), "clipped_at_zero")


@query("met_16_frozen_selection", """
SELECT unnest(['locked run before freeze', 'freeze', 'second freeze', 'locked run', 'second locked run']) AS step, unnest(['refused', 'done', 'refused', 'done', 'refused']) AS outcome""")
def frozen_selection(d):
    """The ranking over all models is frozen once, and opens the locked window once."""
    folder = sinks.scratch_path(d.spark, "selection")
    ranking = rk.balanced_ranking(d.all_metrics)
    steps = [("locked run before freeze", lambda: sl.open_locked_run(d.spark, folder)), ("freeze", lambda: sl.freeze(d.spark, ranking, folder)),
             ("second freeze", lambda: sl.freeze(d.spark, ranking, folder)), ("locked run", lambda: sl.open_locked_run(d.spark, folder)),
             ("second locked run", lambda: sl.open_locked_run(d.spark, folder))]
    out = []
    for step, run in steps:
        try:
            run()
            out.append((step, "done"))
        except PermissionError:
            out.append((step, "refused"))
    return d.spark.createDataFrame(out, "step string, outcome string")
