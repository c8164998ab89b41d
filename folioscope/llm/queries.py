"""Every query of this package."""

from __future__ import annotations

from . import queries_exchange, queries_other, queries_text, queries_tokens  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
