"""Where queries register under their names, with the DuckDB SQL that each is held against."""

from __future__ import annotations

from . import views

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL over the tables and views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {views.SQL.strip()}, q AS ({sql.strip()}) SELECT * FROM q"
        return f

    return add
