"""All registered queries; importing a module registers what it holds."""

from tickweave.plans import (  # noqa: F401
    q_align,
    q_charts,
    q_decode,
    q_estimators,
    q_fleet,
    q_registry,
    q_quality,
    q_scalars,
    q_sources,
    q_streams,
)
from tickweave.plans.registry import ORACLES, QUERIES  # noqa: F401
