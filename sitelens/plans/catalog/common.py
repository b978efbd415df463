"""Shared parameters and SQL building blocks for registered queries."""

from __future__ import annotations

import datetime as _dt

from sitelens.sources.sites import SITES_SQL
from sitelens.sources.store_view import STORE_SQL

# Fixed parameters of the registered queries.
AS_OF = "2001-06-30"
RUN_TS_OLD = _dt.datetime(2000, 1, 1, 3, 0, 0)
RUN_TS_NEW = _dt.datetime(2001, 7, 1, 3, 0, 0)
PREVIOUS_RUN_CUTOFF = "2000-01-01"


def with_store(body: str, *ctes: str) -> str:
    parts = [STORE_SQL.strip()] + [c.strip() for c in ctes]
    recursive = any(p.startswith("RECURSIVE ") for p in parts)
    parts = [p[len("RECURSIVE "):] if p.startswith("RECURSIVE ") else p for p in parts]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + body.strip()


def with_store_sites(body: str, *ctes: str) -> str:
    return with_store(body, SITES_SQL, *ctes)
