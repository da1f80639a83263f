"""Model bundles, the forecast API, and a selection that is frozen before the locked window may be read.

A bundle is a folder: the rows of a model table (trees, ridge weights or last values) and one row that says what they
are. The freeze and the record of the locked run are files that the shared file system creates only if they are not
there yet, so of two runs that start at once one fails.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.operators import ridge, trees
from demandloom.operators.forecast import recursive_mean
from demandloom.operators.learned import CATEGORICAL, KNOWN_NUMERIC, RECURSIVE
from demandloom.sources.parameters import LOCKED, SERIES

FAMILIES = ("mean", "ridge", "trees")
HORIZONS = (1, 7, 30)
CONTRACT_SCHEMA = "family string, predictors array<string>, horizons array<int>"


def save_bundle(model: DataFrame, family: str, path: str) -> str:
    """Store a fitted model of any family with the contract it is to be used under."""
    if family not in FAMILIES:
        raise ValueError(f"family must be one of {FAMILIES}")
    predictors = [] if family == "mean" else CATEGORICAL + KNOWN_NUMERIC + RECURSIVE
    model.write.mode("overwrite").parquet(f"{path}/model")
    contract = model.sparkSession.createDataFrame([(family, predictors, list(HORIZONS))], CONTRACT_SCHEMA)
    contract.coalesce(1).write.mode("overwrite").parquet(f"{path}/contract")
    return path


def load_bundle(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """(family, model rows); refuses a bundle whose contract or columns are not those this code would write."""
    contract = spark.read.parquet(f"{path}/contract").first()
    missing = {"family", "predictors", "horizons"} - set(contract.asDict() if contract else {})
    if missing or contract.family not in FAMILIES or tuple(contract.horizons) != HORIZONS:
        raise ValueError(f"the bundle's contract is not valid: {contract}")
    if contract.family != "mean" and list(contract.predictors) != CATEGORICAL + KNOWN_NUMERIC + RECURSIVE:
        raise ValueError("the stored model was fitted on other predictors")
    model = spark.read.parquet(f"{path}/model")
    needed = {"mean": [*SERIES, "recent"], "ridge": [c.split()[0] for c in ridge.WEIGHT_SCHEMA.split(", ")], "trees": [c.split()[0] for c in trees.NODE_SCHEMA.split(", ")]}
    absent = set(needed[contract.family]) - set(model.columns)
    if absent:
        raise ValueError(f"the stored model lacks {sorted(absent)}")
    return contract.family, model


def produce(family: str, model: DataFrame, states: DataFrame, context: DataFrame, horizon: int) -> DataFrame:
    """Forecast API (fold, series, target_date, horizon_day, raw_forecast, forecast) for horizons 1, 7 and 30.

    ``states`` holds (fold, series, state); ``context`` must hold exactly one row per fold, series and target day.
    """
    if horizon not in HORIZONS:
        raise ValueError(f"horizon must be one of {HORIZONS}")
    keys = ["fold", *SERIES]
    counted = context.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("date").alias("_d"), F.sort_array(F.collect_set("date")).alias("_dates"))
    whole = (F.col("_n") == horizon) & (F.col("_d") == horizon)
    fail = F.raise_error(F.lit("context must hold one row per series and target day")).cast("boolean")
    checked = states.join(counted, keys, "left").where(F.when(whole, True).otherwise(fail)).drop("_n", "_d")
    if family == "mean":
        values = checked.select(*keys, F.arrays_zip(F.col("_dates").alias("d"), recursive_mean(F.col("state"), horizon).alias("r")).alias("z"))
        steps = values.select(*keys, F.posexplode("z").alias("p", "v"))
        return steps.select(*keys, F.col("v.d").alias("target_date"), (F.col("p") + 1).alias("horizon_day"),
                            F.col("v.r").alias("raw_forecast"), F.greatest(F.col("v.r"), F.lit(0.0)).alias("forecast"))
    checked = checked.drop("_dates")
    if family == "ridge":
        return ridge.recursive_forecast(model, checked, context)
    return trees.recursive_forecast(trees.ensembles(model), checked, context, horizon)


def _create_file(spark: SparkSession, path: str, content: dict) -> None:
    """Create a file on the shared file system, or fail because it is there: one atomic step of the file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        stream = files.create(target, False)
    except Exception as error:
        if files.exists(target):
            raise PermissionError(f"{path} is already recorded; a second run is refused") from error
        raise
    stream.write(json.dumps(content, sort_keys=True).encode())
    stream.close()


def _read_file(spark: SparkSession, path: str) -> dict | None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))  # one short file


def freeze(spark: SparkSession, ranking: DataFrame, folder: str) -> str:
    """Write down the winner of a validation ranking, once, before the locked window is read; returns its name."""
    best = ranking.orderBy("selection_rank", "model_name").select("model_name", "balanced_rank_score").first()
    if best is None:
        raise ValueError("nothing to select from")
    _create_file(spark, f"{folder}/selection.json", {
        "model_name": best.model_name, "score": best.balanced_rank_score, "locked_start": LOCKED[1], "locked_end": LOCKED[2], "status": "frozen",
    })
    return best.model_name


def open_locked_run(spark: SparkSession, folder: str) -> str:
    """Name of the frozen model, for the one run on the locked window that a selection allows.

    Fails without a freeze, with a freeze for other dates, and when the run was opened before.
    """
    frozen = _read_file(spark, f"{folder}/selection.json")
    if frozen is None:
        raise PermissionError("no selection was frozen; the locked window stays closed")
    if frozen.get("status") != "frozen" or (frozen["locked_start"], frozen["locked_end"]) != LOCKED[1:]:
        raise PermissionError("the frozen selection is for another locked window")
    _create_file(spark, f"{folder}/locked-run.json", {"model_name": frozen["model_name"]})
    return frozen["model_name"]
