"""All registered queries."""

from jointwork.plans import (  # noqa: F401
    administering,
    checking,
    counting,
    extracting,
    filtering,
    ingesting,
    networking,
    relating,
    reporting,
    trending,
)
from jointwork.plans.registry import ORACLES, QUERIES  # noqa: F401
