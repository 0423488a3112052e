"""All registered queries; importing this package fills the registry."""

from . import collection_plans, evaluation_plans, relational_plans, retrieval_plans, storage_plans, text_plans  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
