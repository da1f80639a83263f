"""Global ridge from sufficient statistics, for all folds at once.

The penalised normal equations need only sums: products of the scaled numbers, and for every category and every pair
of categories the rows, sums of numbers and sums of labels. Spark aggregates them in two passes (rows collapse to the
distinct combinations of categories first, map-side), so training rows are never encoded and there is no limit on the
number of one-hot columns. What remains is one sparse symmetric system per fold whose entries are the pairs of
categories that occur together; it is solved by conjugate gradients on the driver, within ``MAX_ENTRIES``.

A fitted model is a weight table, one row per one-hot column or number; scoring joins categories to their weights, and
a category without a row weighs nothing.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.functions.columns import none_token
from demandloom.operators.forecast import demand_state_features
from demandloom.operators.learned import CATEGORICAL, KNOWN_NUMERIC, RECURSIVE
from demandloom.sources.parameters import SERIES

NUMERIC = KNOWN_NUMERIC + RECURSIVE
MAX_ENTRIES = 20_000_000
WEIGHT_SCHEMA = "fold string, column_name string, category string, weight double, mean double, deviation double, training_rows long"
INTERCEPT = "(intercept)"


def scaling(rows: DataFrame) -> DataFrame:
    """(fold, means, deviations) of the numbers: one row a fold, deviations of the population, 1 where there is none."""
    spread = [F.coalesce(F.nullif(F.stddev_pop(F.col(c).cast("double")), F.lit(0.0)), F.lit(1.0)) for c in NUMERIC]
    return rows.groupBy("fold").agg(F.array(*[F.avg(F.col(c).cast("double")) for c in NUMERIC]).alias("means"), F.array(*spread).alias("deviations"))


def scaled_rows(rows: DataFrame, scales: DataFrame) -> DataFrame:
    """(fold, categories, z, label): numbers scaled by the fold's training rows."""
    numbers = F.array(*[F.col(c).cast("double") for c in NUMERIC])
    columns = [none_token(F.col(c).cast("string")).alias(c) for c in CATEGORICAL]
    z = F.transform(F.arrays_zip(numbers.alias("x"), F.col("means").alias("m"), F.col("deviations").alias("s")), lambda v: (v["x"] - v["m"]) / v["s"])
    joined = rows.join(F.broadcast(scales), "fold")  # one row a fold
    return joined.select("fold", *columns, z.alias("z"), F.col("sales").cast("double").alias("label"))


def statistics(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(products of numbers, sums of categories and their pairs) of scaled rows, both by fold."""
    size = range(len(NUMERIC))
    products = [F.sum(F.col("z")[i] * F.col("z")[j]).alias(f"p{i}_{j}") for i in size for j in range(i, len(NUMERIC))]
    numbers = rows.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("label"), F.array(*[F.sum(F.col("z")[i]) for i in size]).alias("z"),
        F.array(*[F.sum(F.col("z")[i] * F.col("label")) for i in size]).alias("zy"), F.array(*products).alias("zz"),
    )
    combos = rows.groupBy("fold", *CATEGORICAL).agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("label"), *[F.sum(F.col("z")[i]).alias(f"z{i}") for i in size])
    sums = F.array(*[f"z{i}" for i in size])
    none = F.lit(None)
    pieces = [F.struct(F.lit(i).alias("a"), F.col(c).alias("ca"), none.cast("int").alias("b"), none.cast("string").alias("cb"), F.col("label"), sums.alias("z")) for i, c in enumerate(CATEGORICAL)]
    pieces += [F.struct(F.lit(i).alias("a"), F.col(c).alias("ca"), F.lit(j).alias("b"), F.col(d).alias("cb"), none.cast("double").alias("label"), none.cast("array<double>").alias("z"))
               for (i, c), (j, d) in combinations(enumerate(CATEGORICAL), 2)]
    cells = combos.select("fold", "n", F.inline(F.array(*pieces)))
    return numbers, cells.groupBy("fold", "a", "ca", "b", "cb").agg(
        F.sum("n").alias("n"), F.sum("label").alias("label"), F.array(*[F.sum(F.col("z")[i]) for i in size]).alias("z"))


def solve(entries: tuple[np.ndarray, np.ndarray, np.ndarray], right: np.ndarray, tolerance: float = 1e-12) -> np.ndarray:
    """Conjugate gradients with the diagonal as preconditioner on a symmetric matrix of (row, column, value) entries."""
    row, column, value = entries
    diagonal = np.bincount(row[row == column], value[row == column], len(right))

    def times(v: np.ndarray) -> np.ndarray:
        return np.bincount(row, value * v[column], len(right))

    x = np.zeros(len(right))
    for _ in range(4):  # restarts from the true residual take off what rounding has added
        residual = right - times(x)
        ready = residual / diagonal
        step, before = ready.copy(), residual @ ready
        for _ in range(4 * len(right)):
            if np.abs(residual).max(initial=0.0) <= tolerance * max(1.0, np.abs(right).max(initial=0.0)):
                break
            moved = times(step)
            length = before / (step @ moved)
            x += length * step
            residual -= length * moved
            ready = residual / diagonal
            after = residual @ ready
            step, before = ready + after / before * step, after
    return x


def fit_ridge(training: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Weight rows (WEIGHT_SCHEMA) that minimise ||y - Xw - b||^2 + alpha ||w||^2 in each fold of ``training``.

    Categories are one-hot over those of the training rows, numbers are scaled by population deviation, the intercept
    has no penalty.
    """
    spark = training.sparkSession
    scales = scaling(training)
    numbers, cells = statistics(scaled_rows(training, scales))
    cells = cells.cache()
    n_cells = cells.count()
    if n_cells > MAX_ENTRIES:
        raise ValueError(f"{n_cells} pairs of categories occur together; the solver takes {MAX_ENTRIES}")
    per_fold = {r["fold"]: r for r in numbers.collect()}  # one row a fold, as the next
    scale_of = {r["fold"]: r for r in scales.collect()}
    table = cells.toPandas()  # at most MAX_ENTRIES small rows, counted above
    cells.unpersist()
    out = []
    k = len(NUMERIC)
    for fold, own in table.groupby("fold"):
        facts, scale = per_fold[fold], scale_of[fold]
        single, pair = own[own["b"].isna()].sort_values(["a", "ca"]), own[own["b"].notna()]
        place = {key: k + i for i, key in enumerate(zip(single["a"], single["ca"]))}
        d = k + len(place)
        cell = np.arange(k, d)
        i, j = np.array([place[key] for key in zip(pair["a"], pair["ca"])], int), np.array([place[key] for key in zip(pair["b"].astype(int), pair["cb"])], int)
        upper = np.triu_indices(k)
        zz = np.array(facts["zz"])
        with_numbers = np.array(single["z"].tolist(), float).reshape(len(place), k)
        ci, cj = np.repeat(cell, k), np.tile(np.arange(k), len(place))
        off = upper[0] != upper[1]
        everything = np.arange(d)
        ones = np.concatenate([np.array(facts["z"]), single["n"].to_numpy(float)])
        row = np.concatenate([upper[0], upper[1][off], cell, i, j, ci, cj, everything, everything, np.full(d, d), [d]])
        column = np.concatenate([upper[1], upper[0][off], cell, j, i, cj, ci, everything, np.full(d, d), everything, [d]])
        value = np.concatenate([
            zz, zz[off], single["n"].to_numpy(float), pair["n"].to_numpy(float), pair["n"].to_numpy(float),
            with_numbers.ravel(), with_numbers.ravel(), np.full(d, alpha), ones, ones, [float(facts["n"])],
        ])
        right = np.concatenate([np.array(facts["zy"]), single["label"].to_numpy(float), [facts["label"]]])
        weights = solve((row, column, value), right)
        n = int(facts["n"])
        out += [(fold, name, None, float(weights[p]), float(scale["means"][p]), float(scale["deviations"][p]), n) for p, name in enumerate(NUMERIC)]
        out += [(fold, CATEGORICAL[a], c, float(weights[p]), None, None, n) for (a, c), p in place.items()]
        out.append((fold, INTERCEPT, None, float(weights[d]), None, None, n))
    return spark.createDataFrame(out, WEIGHT_SCHEMA)


def numeric_terms(weights: DataFrame) -> DataFrame:
    """(fold, intercept, slopes, offsets): per fold, slope and mean of each number as maps by name."""
    number = F.col("mean").isNotNull()
    return weights.groupBy("fold").agg(
        F.max(F.when(F.col("column_name") == INTERCEPT, F.col("weight"))).alias("intercept"),
        F.map_from_entries(F.collect_list(F.when(number, F.struct("column_name", F.col("weight") / F.col("deviation"))))).alias("slopes"),
        F.map_from_entries(F.collect_list(F.when(number, F.struct("column_name", "mean")))).alias("offsets"),
    )


def score(rows: DataFrame, weights: DataFrame, numbers: list[str] = NUMERIC) -> DataFrame:
    """Adds ``score``: intercept, weights of the row's categories and the listed numbers; others stand at their mean."""
    scored = rows.join(F.broadcast(numeric_terms(weights)), "fold")  # one row a fold
    total = F.col("intercept")
    for name in numbers:
        total = total + F.col("slopes")[name] * (F.col(name).cast("double") - F.col("offsets")[name])
    scored = scored.withColumn("score", total)
    for name in CATEGORICAL:
        own = weights.where((F.col("column_name") == name) & F.col("category").isNotNull()).select("fold", F.col("category").alias("_c"), F.col("weight").alias("_w"))
        scored = scored.withColumn("_c", none_token(F.col(name).cast("string"))).join(own, ["fold", "_c"], "left")
        scored = scored.withColumn("score", F.col("score") + F.coalesce("_w", F.lit(0.0))).drop("_c", "_w")
    return scored


def gradient(training: DataFrame, weights: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(fold, column_name, category, gradient): the penalised normal equations at the fitted weights, from the rows."""
    rows = score(training, weights).withColumn("_r", F.col("sales").cast("double") - F.col("score"))
    scale = weights.where(F.col("mean").isNotNull()).groupBy("fold").agg(F.map_from_entries(F.collect_list(F.struct("column_name", "deviation"))).alias("deviations"))
    rows = rows.join(F.broadcast(scale), "fold")
    terms = [F.struct(F.lit(c).alias("column_name"), none_token(F.col(c).cast("string")).alias("category"), F.col("_r").alias("g")) for c in CATEGORICAL]
    terms += [F.struct(F.lit(c).alias("column_name"), F.lit(None).cast("string").alias("category"),
                       (F.col("_r") * (F.col(c).cast("double") - F.col("offsets")[c]) / F.col("deviations")[c]).alias("g")) for c in NUMERIC]
    terms.append(F.struct(F.lit(INTERCEPT).alias("column_name"), F.lit(None).cast("string").alias("category"), F.col("_r").alias("g")))
    sums = rows.select("fold", F.inline(F.array(*terms))).groupBy("fold", "column_name", "category").agg(F.sum("g").alias("g"))
    same = F.col("s.fold") == F.col("w.fold")
    same &= (F.col("s.column_name") == F.col("w.column_name")) & F.col("s.category").eqNullSafe(F.col("w.category"))
    penalty = F.when(F.col("w.column_name") == INTERCEPT, 0.0).otherwise(alpha * F.col("w.weight"))
    return sums.alias("s").join(weights.alias("w"), same).select("s.fold", "s.column_name", "s.category", (F.col("s.g") - penalty).alias("gradient"))


def recursive_forecast(weights: DataFrame, states: DataFrame, context: DataFrame) -> DataFrame:
    """(fold, series, target_date, horizon_day, raw_forecast, forecast): all days of a series in one projection.

    What is known in advance is scored once per day with the demand features at their means; the recursion then adds
    the nine demand terms. ``states`` has (fold, series, state), ``context`` one row per fold, series and target day.
    """
    scored = score(context, weights, KNOWN_NUMERIC).select("fold", *SERIES, "date", "score", "slopes", "offsets")
    days = scored.groupBy("fold", *SERIES).agg(
        F.sort_array(F.collect_list(F.struct("date", "score"))).alias("days"), F.first("slopes").alias("slopes"), F.first("offsets").alias("offsets"))
    joined = states.select("fold", *SERIES, "state").join(days, ["fold", *SERIES])

    def step(acc: Column, day: Column) -> Column:
        demand = demand_state_features(acc["state"])
        raw = day["score"]
        for name in RECURSIVE:
            raw = raw + F.col("slopes")[name] * (demand[name] - F.col("offsets")[name])

        def extend(value: Column) -> Column:
            return F.struct(
                F.slice(F.concat(acc["state"], F.array(F.greatest(value, F.lit(0.0)))), 2, 28).alias("state"),
                F.concat(acc["raw"], F.array(value)).alias("raw"),
            )

        return F.element_at(F.transform(F.array(raw), extend), 1)

    start = F.struct(F.col("state").alias("state"), F.array().cast("array<double>").alias("raw"))
    folded = joined.withColumn("raw", F.aggregate("days", start, step, lambda acc: acc["raw"]))
    steps = folded.select("fold", *SERIES, F.posexplode(F.arrays_zip(F.col("days.date").alias("d"), F.col("raw").alias("r"))).alias("p", "z"))
    return steps.select(
        "fold", *SERIES, F.col("z.d").alias("target_date"), (F.col("p") + 1).alias("horizon_day"),
        F.col("z.r").alias("raw_forecast"), F.greatest(F.col("z.r"), F.lit(0.0)).alias("forecast"),
    )
