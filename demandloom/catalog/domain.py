"""Domain views over one data folder.

Small views are plans. The four stage tables (daily sales, features, predictions,
recommendations) are written once per application to the shared checkpoint folder as
Parquet and read back, so the line items are scanned once and later queries get pruning
and pushdown on the stage table instead of recomputing it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.operators import features, folds, forecast, inventory, learned, metrics, ranking, ridge, trees
from demandloom.sources import retail
from demandloom.sources.parameters import FOLDS, LOCKED, SERIES
from demandloom.sources.sinks import scratch_path
from demandloom.sources.tables import read_table, through_date

_STAGED: dict[tuple[str, str, str], tuple] = {}


class Retail:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str, *columns: str) -> DataFrame:
        return read_table(self.spark, self.folder, name, columns or None)

    def _key(self, name: str) -> tuple[str, str, str]:
        return self.spark.sparkContext.applicationId, self.folder, name

    def stage(self, name: str, build: Callable[[], DataFrame], *partition_by: str) -> DataFrame:
        """Write a stage table on first use in this application, then scan it."""
        key = self._key(name)
        if key not in _STAGED:
            path = scratch_path(self.spark, name)
            df = build()
            rows = df.repartition(*partition_by) if partition_by else df
            rows.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
            _STAGED[key] = (path, df.schema)
        path, schema = _STAGED[key]
        return self.spark.read.schema(schema).parquet(path)

    def _lines(self) -> list[DataFrame]:
        return [self.table(name) for name in ("lineitem", "part", "supplier", "nation", "region")]

    @cached_property
    def facts(self) -> DataFrame:
        return self.stage("daily-sales", lambda: retail.store_item_sales(*self._lines()))

    @cached_property
    def item_facts(self) -> DataFrame:
        return self.stage("item-daily-sales", lambda: retail.store_item_sales(*self._lines(), item="p_partkey"))

    @cached_property
    def item_days(self) -> int:
        """Rows of the item facts."""
        return self.item_facts.count()

    @cached_property
    def bounds(self) -> retail.Bounds:
        key = self._key("bounds")
        if key not in _STAGED:
            _STAGED[key] = retail.date_bounds(self.table("lineitem"))
        return _STAGED[key]

    @cached_property
    def calendar(self) -> DataFrame:
        return retail.calendar(self.spark, self.bounds)

    @cached_property
    def prices(self) -> DataFrame:
        return retail.weekly_prices(self.facts)

    @cached_property
    def series(self) -> DataFrame:
        return self.facts.select(*SERIES).distinct()

    @cached_property
    def panel(self) -> DataFrame:
        return retail.daily_panel(self.facts, self.bounds)

    @cached_property
    def stored_panel(self) -> DataFrame:
        """The panel by year, for extracts that need only its newest part."""
        return self.stage("panel-by-year", lambda: self.panel, "year")

    @cached_property
    def bands(self) -> DataFrame:
        return features.assign_bands(features.item_mean_demand(self.facts, self.bounds.days))

    @cached_property
    def series_bands(self) -> DataFrame:
        """The item's band on every series."""
        return self.series.join(self.bands.select("item_id", "demand_band"), "item_id")

    @cached_property
    def flagged(self) -> DataFrame:
        return features.flag_availability(self.panel).join(self.series_bands, SERIES)

    @cached_property
    def active(self) -> DataFrame:
        return features.active_period(self.panel)

    @cached_property
    def features(self) -> DataFrame:
        return self.stage("features", lambda: features.feature_table(self.panel, self.series_bands))

    @cached_property
    def folds(self) -> DataFrame:
        return retail.folds(self.spark.range(1))

    @cached_property
    def all_folds(self) -> DataFrame:
        return retail.folds(self.spark.range(1), locked=True)

    @cached_property
    def predictions(self) -> DataFrame:
        return self.stage(
            "predictions", lambda: forecast.fold_predictions(self.active.join(self.series_bands, SERIES))
        )

    @cached_property
    def origins(self) -> DataFrame:
        """Per fold and series, what is known at the fold's origin."""
        return forecast.origins(forecast.series_history(self.active.join(self.series_bands, SERIES), "dept_id", "demand_band"))

    @cached_property
    def ridge_weights(self) -> DataFrame:
        return self.stage("ridge-weights", lambda: ridge.fit_ridge(folds.training_rows(self.features)))

    @cached_property
    def tree_training(self) -> DataFrame:
        return self.stage("tree-training", lambda: trees.training_table(folds.training_rows(self.features)))

    @cached_property
    def tree_nodes(self) -> DataFrame:
        """Both families with their base settings on all folds."""
        return self.stage("tree-nodes", lambda: trees.fit_trees(self.tree_training, trees.BASE, [f[0] for f in FOLDS]))

    def forecasts_of(self, nodes: DataFrame) -> DataFrame:
        steps = trees.recursive_forecast(trees.ensembles(nodes), learned.origin_states(self.origins), learned.fold_context(self.features))
        return learned.with_actuals(steps.withColumnRenamed("configuration", "model_name"), self.features, self.origins)

    @cached_property
    def learned_predictions(self) -> DataFrame:
        """Ridge and both tree families, forecast recursively on all folds, with actuals."""

        def build() -> DataFrame:
            steps = ridge.recursive_forecast(self.ridge_weights, learned.origin_states(self.origins), learned.fold_context(self.features))
            scored = learned.with_actuals(steps.withColumn("model_name", F.lit("ridge")), self.features, self.origins)
            return scored.unionByName(self.forecasts_of(self.tree_nodes))

        return self.stage("learned-predictions", build)

    @cached_property
    def better_family(self) -> str:
        """The tree family that the balanced ranking puts first with its base settings."""
        ranks = ranking.balanced_ranking(self.all_metrics).where(F.col("model_name").isin(*trees.BASE))
        return ranks.orderBy("selection_rank", "model_name").first()["model_name"]

    @cached_property
    def tuned_predictions(self) -> DataFrame:
        """The better family with each of its six settings; the first is the base, already forecast."""

        def build() -> DataFrame:
            family = self.better_family
            settings = {f"{family}_{i}": s for i, s in enumerate(trees.GRIDS[family])}
            base, *_ = settings
            nodes = trees.fit_trees(self.tree_training, {n: s for n, s in settings.items() if n != base}, [f[0] for f in FOLDS])
            stored = self.stage("tuned-nodes", lambda: nodes)
            known = self.learned_predictions.where(F.col("model_name") == family).withColumn("model_name", F.lit(base))
            return known.unionByName(self.forecasts_of(stored))

        return self.stage("tuned-predictions", build)

    @cached_property
    def all_metrics(self) -> DataFrame:
        """Metric cube over baselines, ridge and both tree families."""
        shared = [c for c in self.predictions.columns if c in self.learned_predictions.columns]
        both = self.predictions.select(*shared).unionByName(self.learned_predictions.select(*shared))
        return self.stage("all-metrics", lambda: metrics.metrics(both))

    @cached_property
    def deployed(self) -> DataFrame:
        """Recursive mean forecast from the end of the locked window."""
        return self.stage(
            "deployed", lambda: forecast.deployment_forecast(forecast.last_values(through_date(self.active, LOCKED[2])))
        )

    @cached_property
    def state(self) -> DataFrame:
        return retail.inventory_state(self.series)

    @cached_property
    def decision_inputs(self) -> DataFrame:
        return inventory.decision_inputs(self.deployed, self.state, inventory.calibrate(self.predictions))

    @cached_property
    def recommendations(self) -> DataFrame:
        return self.stage("recommendations", lambda: inventory.recommend(self.decision_inputs))
