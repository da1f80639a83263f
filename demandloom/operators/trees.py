"""Boosted regression trees in two families, their grids, and recursive forecasts with them.

A fit is one partition of a Spark job, for one (fold, configuration), so all folds and configurations are fitted at the
same time, each in its own task, from one staged training table. What a fit holds is bounded: at most ``FIT_ROWS`` rows
of a fold, chosen by the hash of their keys when there are more (a documented parameter, far above the rows that the
settings were made for). Rows are sorted by key before anything is summed or drawn, so a fit does not depend on how the
table is partitioned.

The two families differ in how they grow and in how they see a category:

* ``histogram``: best leaf first up to a number of leaves, categories split into two sets ordered by mean gradient;
* ``depthwise``: all leaves to a depth, a category against all others (one-hot columns), rows and columns drawn.

A fitted ensemble is a flat node table with category names and thresholds, so it is stored, compared and applied as
rows. Its size is bounded by the settings (rounds x leaves); tasks that forecast get it as arrays.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.functions.columns import none_token
from demandloom.operators.learned import CATEGORICAL, KNOWN_NUMERIC, RECURSIVE
from demandloom.sources.parameters import HORIZON, SERIES

FIT_ROWS = 1_000_000
MAX_BINS = 255
#: A category needs so many rows before it may join the left set, and its mean gradient is smoothed by as many.
SET_ROWS = 10
NUMERIC = KNOWN_NUMERIC + RECURSIVE
FEATURES = CATEGORICAL + NUMERIC

# Base settings of both families, and the six settings each may be tuned over.
_H = {"family": "histogram", "rate": 0.08, "rounds": 300, "leaves": 31, "penalty": 1.0, "least": 20}
_D = {"family": "depthwise", "rate": 0.05, "rounds": 500, "depth": 6, "penalty": 1.0, "least": 3, "rows": 0.9, "columns": 0.9}
BASE = {"histogram": _H, "depthwise": _D}
GRIDS = {
    "histogram": [_H, _H | {"rate": 0.05, "rounds": 400}, _H | {"rate": 0.10, "rounds": 250}, _H | {"leaves": 15}, _H | {"leaves": 63}, _H | {"penalty": 3.0}],
    "depthwise": [_D, _D | {"rate": 0.07, "rounds": 400}, _D | {"rate": 0.04, "rounds": 650}, _D | {"depth": 4}, _D | {"depth": 8}, _D | {"least": 6, "penalty": 2.0}],
}
SEED = 42

NODE_SCHEMA = (
    "fold string, configuration string, tree int, node int, feature string, threshold double, members array<string>, "
    "left int, right int, value double, n_rows long, base double, training_rows long, training_mae double"
)


def training_table(rows: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(fold, keys, predictors, label) of the training rows of each fold, at most about ``fit_rows`` a fold."""
    columns = [none_token(F.col(c).cast("string")).alias(c) for c in CATEGORICAL] + [F.col(c).cast("double").alias(c) for c in NUMERIC]
    table = rows.select("fold", *columns, "date", F.col("sales").cast("double").alias("label"))
    counts = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a fold
    ticket = F.pmod(F.xxhash64(*SERIES, "date"), F.lit(1 << 30))
    for fold, n in counts.items():
        if n > fit_rows:
            table = table.where((F.col("fold") != fold) | (ticket < int((1 << 30) * fit_rows / n)))
    return table


class Bins:
    """Codes of a training frame: categories by name, numbers by at most MAX_BINS intervals; all bins lie on one axis."""

    def __init__(self, frame: pd.DataFrame):
        self.values, codes = [], []
        for name in CATEGORICAL:
            kinds = np.sort(frame[name].unique().astype(str))
            self.values.append(kinds)
            codes.append(np.searchsorted(kinds, frame[name].to_numpy(str)))
        for name in NUMERIC:
            column = frame[name].to_numpy(float)
            median = np.nanmedian(column) if np.isfinite(column).any() else 0.0
            column = np.where(np.isnan(column), median, column)
            distinct = np.unique(column)
            if len(distinct) > MAX_BINS:
                edges = np.unique(np.quantile(column, np.arange(1, MAX_BINS) / MAX_BINS, method="lower"))
            else:
                edges = (distinct[:-1] + distinct[1:]) / 2
            self.values.append(edges)
            codes.append(np.searchsorted(edges, column, "left"))
        sizes = [len(v) + (i >= len(CATEGORICAL)) for i, v in enumerate(self.values)]
        self.starts = np.cumsum([0, *sizes[:-1]])
        self.total = int(sum(sizes))
        self.of_bin = np.repeat(np.arange(len(sizes)), sizes)
        self.is_category = self.of_bin < len(CATEGORICAL)
        # the last interval of a number has nothing to its right
        self.splits = np.ones(self.total, bool)
        self.splits[self.starts[len(CATEGORICAL):] + np.array(sizes[len(CATEGORICAL):]) - 1] = False
        self.places = np.stack(codes, 1) + self.starts

    def histogram(self, rows: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        """(sum of gradients, rows) of each bin."""
        places = self.places[rows].ravel()
        sums = np.bincount(places, np.repeat(gradient[rows], self.places.shape[1]), self.total)
        return np.stack([sums, np.bincount(places, minlength=self.total)])


def best_split(bins: Bins, histogram: np.ndarray, setting: dict, allowed: np.ndarray) -> tuple[float, int, np.ndarray | None]:
    """(gain, bin, order of the axis): the best cut of a node; the order tells which bins lie left of the cut."""
    total, n = histogram[:, bins.starts[-1]:].sum(1)  # the last feature is a number: its bins hold all rows of the node
    order = None
    if setting["family"] == "histogram":
        categories = np.flatnonzero(bins.is_category)
        mean = histogram[0, categories] / (histogram[1, categories] + SET_ROWS)
        mean = np.where(histogram[1, categories] < SET_ROWS, np.inf, mean)  # rare ones stay right
        order = np.arange(bins.total)
        order[categories] = categories[np.lexsort((mean, bins.of_bin[categories]))]
        ordered = histogram[:, order]
    else:
        ordered = histogram
    running = np.cumsum(ordered, 1)
    left = running - (running[:, bins.starts] - ordered[:, bins.starts])[:, bins.of_bin]
    if order is None:
        left = np.where(bins.is_category, histogram, left)
    sums, rows = left
    penalty = setting["penalty"]
    fit = allowed & (rows >= setting["least"]) & (n - rows >= setting["least"])
    if order is not None:
        fit &= ~bins.is_category | (ordered[1] >= SET_ROWS)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fit, sums**2 / (rows + penalty) + (total - sums) ** 2 / (n - rows + penalty) - total**2 / (n + penalty), -np.inf)
    at = int(gain.argmax())
    return float(gain[at]), at, order


def grow(bins: Bins, gradient: np.ndarray, drawn: np.ndarray, setting: dict, allowed: np.ndarray) -> list[dict]:
    """One tree: nodes with their cut or their value, and in ``rows`` of a leaf all rows that end there. Cuts and
    values are learned from the drawn rows."""
    most = setting.get("leaves", 1 << 30)
    deepest = setting.get("depth", 1 << 30)
    nodes: list[dict] = []
    waiting: list = []
    numeric = slice(bins.starts[-1], None)  # the bins of the last number hold all drawn rows of a node

    def add(own: np.ndarray, histogram: np.ndarray, depth: int) -> int:
        n = int(histogram[1, numeric].sum())
        value = -setting["rate"] * histogram[0, numeric].sum() / (n + setting["penalty"])
        nodes.append({"left": -1, "right": -1, "value": float(value), "n_rows": n, "rows": own})
        if depth < deepest and n >= 2 * setting["least"]:
            gain, at, order = best_split(bins, histogram, setting, allowed)
            if gain > 1e-12:
                heapq.heappush(waiting, (-gain, len(nodes) - 1, at, order, histogram, depth))
        return len(nodes) - 1

    rows = np.arange(len(gradient))
    add(rows, bins.histogram(rows[drawn], gradient), 0)
    leaves = 1
    while waiting and leaves < most:
        _, node, at, order, histogram, depth = heapq.heappop(waiting)
        own = nodes[node].pop("rows")
        feature = int(bins.of_bin[at])
        place = bins.places[own, feature]
        if not bins.is_category[at]:
            goes_left, cut = place <= at, {"threshold": float(bins.values[feature][at - bins.starts[feature]]), "members": None}
        else:
            lefts = np.array([at]) if order is None else order[bins.starts[feature] : at + 1]
            goes_left = np.isin(place, lefts)
            cut = {"threshold": None, "members": [str(bins.values[feature][b - bins.starts[feature]]) for b in np.sort(lefts)]}
        low, high = own[goes_left], own[~goes_left]
        small, large = (low, high) if len(low) <= len(high) else (high, low)
        counted = bins.histogram(small[drawn[small]], gradient)
        rest = histogram - counted
        nodes[node] |= {"feature": FEATURES[feature], **cut}
        nodes[node]["left"] = add(low, counted if small is low else rest, depth + 1)
        nodes[node]["right"] = add(high, rest if small is low else counted, depth + 1)
        leaves += 1
    return nodes


def boost(frame: pd.DataFrame, setting: dict, seed: int = SEED) -> tuple[list[list[dict]], float, np.ndarray]:
    """(trees, base value, fitted values) of squared-error boosting on a frame sorted by its keys."""
    bins, label = Bins(frame), frame["label"].to_numpy(float)
    base = float(label.mean())
    fitted, trees = np.full(len(label), base), []
    for number in range(setting["rounds"]):
        draw = np.random.default_rng([seed, number])
        drawn = draw.random(len(label)) < setting.get("rows", 1.0)
        allowed = bins.splits.copy()
        if "columns" in setting:  # a category is a column of its own, a number is one column
            column = np.where(bins.is_category, np.arange(bins.total), bins.starts[bins.of_bin])
            allowed &= draw.random(bins.total)[column] < setting["columns"]
        tree = grow(bins, fitted - label, drawn, setting, allowed)
        for node in tree:
            rows = node.pop("rows", None)
            if rows is not None:
                fitted[rows] += node["value"]
        trees.append(tree)
    return trees, base, fitted


class Ensemble:
    """Trees as flat arrays; all trees of all rows go down one level at a time."""

    def __init__(self, trees: list[list[dict]], base: float):
        sizes = [len(t) for t in trees]
        self.base, self.roots = base, np.cumsum([0, *sizes[:-1]]) if trees else np.zeros(0, np.int64)
        nodes = [(n, start) for tree, start in zip(trees, self.roots) for n in tree]
        inner = [n["left"] >= 0 for n, _ in nodes]
        self.feature = np.array([FEATURES.index(n["feature"]) if i else 0 for (n, _), i in zip(nodes, inner)], np.int64)
        self.threshold = np.array([n["threshold"] if i and n["threshold"] is not None else np.nan for (n, _), i in zip(nodes, inner)], float)
        self.left = np.array([s + n["left"] if i else k for k, ((n, s), i) in enumerate(zip(nodes, inner))], np.int64)
        self.right = np.array([s + n["right"] if i else k for k, ((n, s), i) in enumerate(zip(nodes, inner))], np.int64)
        self.value = np.array([n["value"] for n, _ in nodes], float)
        self.inner = np.array(inner, bool)
        names: list[set] = [set() for _ in CATEGORICAL]
        for (n, _), f, i in zip(nodes, self.feature, inner):
            if i and n["members"] is not None:
                names[f].update(n["members"])
        self.names = [np.array(sorted(s), str) for s in names]
        self.set_start, flags, end = np.full(len(nodes), -1), [], 0
        for k, ((n, _), f, i) in enumerate(zip(nodes, self.feature, inner)):
            if i and n["members"] is not None:
                flags.append(np.isin(self.names[f], n["members"]))
                self.set_start[k], end = end, end + len(self.names[f])
        self.flags = np.concatenate([*flags, np.zeros(1, bool)])

    def codes(self, category: int, names: np.ndarray) -> np.ndarray:
        """Numbers of the names of one category column as the ensemble knows them; names in no cut are -1."""
        known = self.names[category]
        if not len(known):
            return np.full(len(names), -1.0)
        names = names.astype(str)
        at = np.minimum(np.searchsorted(known, names), len(known) - 1)
        return np.where(known[at] == names, at, -1).astype(float)

    def predict(self, rows: np.ndarray) -> np.ndarray:
        """Values for rows of (category codes, numbers) in the order of FEATURES."""
        node = np.broadcast_to(self.roots, (len(rows), len(self.roots)))
        at = np.arange(len(rows))[:, None]
        while self.inner[node].any():
            x = rows[at, self.feature[node]]
            start = self.set_start[node]
            is_set = start >= 0
            member = self.flags[np.where(is_set & (x >= 0), start + np.where(is_set, x, 0).astype(np.int64), -1)]
            node = np.where(np.where(is_set, member, x <= self.threshold[node]), self.left[node], self.right[node])
        return self.base + self.value[node].sum(1)


def fit_trees(training: DataFrame, settings: dict[str, dict], folds: list[str]) -> DataFrame:
    """Node rows (NODE_SCHEMA) of one ensemble per fold and named setting."""

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        frame = pd.concat(parts).sort_values([*SERIES, "date"], kind="stable").reset_index(drop=True)
        fold, name = frame["fold"].iloc[0], frame["configuration"].iloc[0]
        trees, base, fitted = boost(frame, settings[name])
        rows = [
            (fold, name, t, k, n.get("feature"), n.get("threshold"), n.get("members"), n["left"], n["right"], n["value"], n["n_rows"])
            for t, tree in enumerate(trees) for k, n in enumerate(tree)
        ]
        out = pd.DataFrame(rows, columns=["fold", "configuration", "tree", "node", "feature", "threshold", "members", "left", "right", "value", "n_rows"])
        yield out.assign(base=base, training_rows=len(frame), training_mae=float(np.abs(frame["label"] - fitted).mean()))

    # one partition a fit: a hash of the keys would put some fits into one task and leave others without
    places = {(f, c): i for i, (f, c) in enumerate((f, c) for f in folds for c in settings)}
    numbered = [F.struct(F.lit(c).alias("configuration"), F.create_map(*[F.lit(x) for f in folds for x in (f, places[f, c])])[F.col("fold")].alias("fit")) for c in settings]
    rows = training.select("*", F.explode(F.array(*numbered)).alias("_s")).select("*", "_s.*").drop("_s")
    return rows.repartitionById(len(places), "fit").drop("fit").mapInPandas(fit, NODE_SCHEMA)


def ensembles(nodes: DataFrame) -> dict[tuple[str, str], Ensemble]:
    """The ensembles of a node table, bounded by rounds x leaves of its settings."""
    out = {}
    for key, frame in nodes.select("fold", "configuration", "tree", "node", "feature", "threshold", "members", "left", "right", "value", "base").toPandas().groupby(["fold", "configuration"]):
        frame = frame.sort_values(["tree", "node"]).astype({"threshold": object, "members": object})
        frame["threshold"] = frame["threshold"].where(frame["threshold"].notna(), None)
        trees = [tree.to_dict("records") for _, tree in frame.groupby("tree", sort=True)]
        out[key] = Ensemble(trees, float(frame["base"].iloc[0]))
    return out


def demand_features(state: np.ndarray) -> np.ndarray:
    """RECURSIVE columns of the next day from the last 28 values of each row."""
    return np.stack([
        state[:, -1], state[:, -7], state[:, -14], state[:, -28], state[:, -7:].mean(1), state[:, -14:].mean(1), state.mean(1),
        state[:, -7:].std(1, ddof=1), state.std(1, ddof=1),
    ], 1)


def recursive_forecast(models: dict[tuple[str, str], Ensemble], states: DataFrame, context: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """(configuration, fold, series, target_date, horizon_day, raw_forecast, forecast) of every model on its fold.

    ``states`` has (fold, series, state of 28 values), ``context`` one row per fold, series and target day. A day's
    forecast, clipped at zero, becomes the newest value of the state of the next. One row holds a series with its
    days, so a task steps all series of a batch together.
    """
    days = context.select("fold", *SERIES, F.struct("date", *[none_token(F.col(c).cast("string")).alias(f"_{c}") for c in CATEGORICAL], *[F.col(c).cast("double").alias(c) for c in KNOWN_NUMERIC]).alias("day"))
    days = days.groupBy("fold", *SERIES).agg(F.sort_array(F.collect_list("day")).alias("days")).where(F.size("days") == horizon)
    rows = states.select("fold", *SERIES, "state").join(days, ["fold", *SERIES])

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for fold, frame in batch.groupby("fold"):
                table = pd.DataFrame.from_records([list(d.values()) if isinstance(d, dict) else list(d) for own in frame["days"] for d in own])
                known = table.iloc[:, 1 : 1 + len(CATEGORICAL)].to_numpy(object)
                numbers = table.iloc[:, 1 + len(CATEGORICAL) :].to_numpy(float).reshape(len(frame), horizon, -1)
                dates = table.iloc[:, 0].to_numpy(object).reshape(len(frame), horizon)
                start = np.array(frame["state"].tolist(), float)
                for (own, name), model in models.items():
                    if own != fold:
                        continue
                    codes = np.stack([model.codes(f, names) for f, names in enumerate(known.T)], 1).reshape(len(frame), horizon, -1)
                    state, raw = start, []
                    for h in range(horizon):
                        raw.append(model.predict(np.concatenate([codes[:, h], numbers[:, h], demand_features(state)], 1)))
                        state = np.concatenate([state[:, 1:], np.maximum(raw[-1], 0)[:, None]], 1)
                    yield pd.DataFrame({
                        "configuration": name, "fold": fold, **{c: np.repeat(frame[c].to_numpy(object), horizon) for c in SERIES},
                        "target_date": dates.ravel(), "horizon_day": np.tile(np.arange(1, horizon + 1), len(frame)),
                        "raw_forecast": np.stack(raw, 1).ravel(),
                    })

    schema = "configuration string, fold string, store_id string, item_id string, target_date date, horizon_day int, raw_forecast double"
    return rows.mapInPandas(step, schema).withColumn("forecast", F.greatest("raw_forecast", F.lit(0.0)))


def score_rows(models: dict[tuple[str, str], Ensemble], rows: DataFrame) -> DataFrame:
    """(configuration, fold, series, date, score) of rows that hold all predictors, by every model of their fold."""
    columns = [none_token(F.col(c).cast("string")).alias(f"_{c}") for c in CATEGORICAL] + [F.col(c).cast("double").alias(c) for c in NUMERIC]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (own, name), model in models.items():
                frame = batch[batch["fold"] == own]
                if len(frame):
                    codes = [model.codes(f, frame[f"_{c}"].to_numpy(object)) for f, c in enumerate(CATEGORICAL)]
                    values = model.predict(np.stack([*codes, *(frame[c].to_numpy(float) for c in NUMERIC)], 1))
                    yield frame[["fold", *SERIES, "date"]].assign(configuration=name, score=values)

    given = rows.select("fold", *SERIES, "date", *columns)
    return given.mapInPandas(score, "fold string, store_id string, item_id string, date date, configuration string, score double")
