"""Queries by name, each with the SQL that gives the same rows over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwright.plans.views import VIEWS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: tuple[str, ...] = (), recursive: bool = False) -> Callable[[Query], Query]:
    """Registers a query under its function's name.  ``views`` are put before ``sql`` as common table expressions."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            parts = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in views)
            body = sql.strip()
            if parts and body.upper().startswith("WITH "):
                body = f"{parts},\n{body[5:]}"
                ORACLES[function.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{body}"
            elif parts:
                ORACLES[function.__name__] = f"WITH {parts}\n{body}"
            else:
                ORACLES[function.__name__] = body if not recursive else body.replace("WITH ", "WITH RECURSIVE ", 1)
        return function

    return register
