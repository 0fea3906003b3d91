"""All core queries and their SQL by name."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _name in ("reference", "control", "data_problems"):
    _m = importlib.import_module(f"condnet.plans.{_name}")
    QUERIES |= _m.QUERIES
    ORACLE |= _m.ORACLE
