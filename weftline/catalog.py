"""All registered queries and their SQL twins."""

from __future__ import annotations

from weftline.plans import intel, more, scalars, watching

_ALL = {**watching.QUERIES, **intel.QUERIES, **scalars.QUERIES, **more.QUERIES}


def queries() -> dict:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql() if callable(sql) else sql for name, (_, sql) in _ALL.items() if sql}
