"""Every registered query; importing the package fills the registry."""

from . import explore_q, metrics_q, model_q, panel_q, queue_q, schema_q, stats_q  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
