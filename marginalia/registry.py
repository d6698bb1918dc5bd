"""Registry of queries with the SQL that states their rows."""

from __future__ import annotations

from collections.abc import Callable

from .views import DUCK

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
#: The statements alone, for use in others.
BODY: dict[str, str] = {}


def literal(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def oracle(body: str, views: str = "") -> str:
    """DuckDB SQL with the named derived views before the statement."""
    ctes = [f"{v} AS MATERIALIZED ({DUCK[v]})" for v in views.split()]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        ctes.append(body[len("WITH RECURSIVE ") :])
    elif body.upper().startswith("WITH "):
        ctes.append(body[len("WITH ") :])
    else:
        return ("WITH " + ", ".join(ctes) + " " if ctes else "") + body
    return "WITH RECURSIVE " + ", ".join(ctes)


def query(name: str, sql: str | None = None, views: str = ""):
    """Register ``f(spark, sf_dir)`` under a name, with its SQL if it has one."""

    def wrap(f):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql:
            SQL[name], BODY[name] = oracle(sql, views), sql
        return f

    return wrap
