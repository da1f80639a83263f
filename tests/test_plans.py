"""The composed stages end to end on the smallest tables."""

from demandloom.catalog.domain import Retail
from demandloom.plans import evaluation, feature_build, replenishment
from demandloom.sources import retail
from demandloom.sources.parameters import LOCKED
from demandloom.sources.tables import read_table


def test_stages_agree_with_the_catalogue(spark, folder, tmp_path):
    domain = Retail(spark, folder)
    facts = feature_build.build_daily_sales(spark, folder, str(tmp_path / "daily"))
    bounds = retail.date_bounds(read_table(spark, folder, "lineitem"))
    features = feature_build.build_features(facts, bounds, str(tmp_path / "features"))
    assert features.count() == domain.features.count()
    predictions = evaluation.build_predictions(features, str(tmp_path / "predictions"))
    assert predictions.exceptAll(domain.predictions.select(*predictions.columns)).count() == 0
    cube, order = evaluation.evaluate(predictions)
    assert order.count() == 5 and cube.where("segment_type = 'overall'").count() == 100
    decisions = replenishment.build_recommendations(
        features, predictions, domain.state, LOCKED[2], str(tmp_path / "decisions")
    )
    assert decisions.count() == domain.recommendations.count()
