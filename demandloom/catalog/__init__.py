"""All registered queries and their SQL twins."""

from demandloom.catalog.registry import ORACLES, QUERIES  # noqa: F401
from demandloom.catalog import (  # noqa: F401
    q_explore,
    q_features,
    q_forecast,
    q_inventory,
    q_learned,
    q_panel,
    q_profile,
    q_serving,
)
