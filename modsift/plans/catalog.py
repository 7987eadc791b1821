"""All registered queries; importing a module registers its part."""

from modsift.plans import (
    dataset_queries,
    feature_queries,
    ml_queries,
    relational_queries,
    source_queries,
    text_queries,
)  # noqa: F401
from modsift.plans.registry import QUERIES, SQL  # noqa: F401
