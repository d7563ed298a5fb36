"""All registered queries."""

from docloom.plans import (  # noqa: F401
    q_conversation, q_library, q_metrics, q_normalize, q_oplog, q_sessions, q_translate,
)
from docloom.plans import q_sources  # noqa: F401  (reuses SQL of the others)
from docloom.plans.registry import ORACLES, QUERIES  # noqa: F401
