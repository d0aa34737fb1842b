"""All registered queries."""

from . import (  # noqa: F401
    q_bygroup, q_columns, q_merge, q_parity, q_program, q_reshape, q_scalar, q_sources, q_summary, q_text,
)
from .registry import ORACLES, QUERIES  # noqa: F401
