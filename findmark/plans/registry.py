"""Names of the queries of this library and their SQL counterparts."""

from __future__ import annotations

from findmark.plans import core, judged, results

MODULES = (core, judged, results)


def queries() -> dict:
    return dict(core.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(core.ORACLES)
