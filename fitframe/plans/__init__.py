"""Query plans on the driver tables: each registered with its SQL oracle."""

from . import q_core, q_fitted, q_group, q_io, q_metrics, q_models, q_rowlocal  # noqa: F401
from .registry import ORACLE, QUERIES, table  # noqa: F401
