"""All registered queries."""

from lexloom.plans import q_retrieval, q_review, q_scope, q_stream, q_text  # noqa: F401
from lexloom.plans.registry import REGISTRY  # noqa: F401
