"""Guards: predicates over wildcards, config, environment and files, as two-valued Column expressions.

A guard is a dict with an ``op``.  Every leaf is two-valued: a missing field makes ``in``, ``eq`` and ``regex`` false
and ``not_in`` and ``not_eq`` true, an invalid expression is false, an unknown ``@list`` is empty.  So nulls never
reach AND, OR and NOT, whose three-valued forms would differ."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = ("in", "not_in", "eq", "not_eq", "regex", "config_eq", "env_set", "env_eq", "file_exists", "and", "or", "not")


class GuardError(ValueError):
    """A guard that isn't a table with a known ``op`` and its fields."""


def members(guard: dict, config: dict) -> list[str]:
    """The values of ``in``; ``@name`` stands for a config list."""
    values = guard.get("values", guard.get("set"))
    if isinstance(values, str) and values.startswith("@"):
        found = config.get(values[1:], [])
        return [found] if isinstance(found, str) else list(found)
    if not isinstance(values, list):
        raise GuardError("a set is a list or @name")
    return [str(v) for v in values]


def check(guard) -> None:
    if not isinstance(guard, dict) or guard.get("op") not in OPS:
        raise GuardError(f"not a guard: {guard!r}")
    op = guard["op"]
    for g in guard.get("guards", []) if op in ("and", "or") else [guard.get("guard")] if op == "not" else []:
        check(g)


def field(guard: dict) -> str:
    if not isinstance(guard.get("field"), str):
        raise GuardError(f"{guard['op']} needs a field")
    return guard["field"]


def as_column(guard: dict, wildcards: Column, config: dict | None = None, environ: dict | None = None, exists: Callable[[str], bool] | None = None) -> Column:
    """The guard over a map column of wildcards."""
    check(guard)
    config, environ, exists = config or {}, os.environ if environ is None else environ, exists or os.path.exists
    op = guard["op"]

    def value() -> Column:
        return F.try_element_at(wildcards, F.lit(field(guard)))

    if op in ("in", "not_in"):
        found = members(guard, config)
        inside = F.coalesce(value().isin(*found), F.lit(False)) if found else F.lit(False)
        return inside if op == "in" else ~inside
    if op in ("eq", "not_eq"):
        same = F.coalesce(value() == F.lit(str(guard["value"])), F.lit(False))
        return same if op == "eq" else ~same
    if op == "regex":
        try:
            re.compile(guard["pattern"])
        except re.error:
            return F.lit(False)
        return F.coalesce(value().rlike(guard["pattern"]), F.lit(False))
    if op == "config_eq":
        return F.lit(config.get(guard["key"]) == str(guard["value"]))
    if op == "env_set":
        return F.lit(bool(environ.get(guard["name"])))
    if op == "env_eq":
        return F.lit(environ.get(guard["name"]) == str(guard["value"]))
    if op == "file_exists":
        return F.lit(bool(exists(guard["path"])))
    if op == "not":
        return ~as_column(guard["guard"], wildcards, config, environ, exists)
    out = F.lit(op == "and")
    for g in guard["guards"]:
        one = as_column(g, wildcards, config, environ, exists)
        out = out & one if op == "and" else out | one
    return out


def holds(guard: dict, wildcards: dict[str, str], config: dict | None = None, environ: dict | None = None, exists: Callable[[str], bool] | None = None) -> bool:
    """The guard for one set of wildcards on the driver."""
    check(guard)
    config, environ, exists = config or {}, os.environ if environ is None else environ, exists or os.path.exists
    op = guard["op"]
    if op in ("in", "not_in"):
        return (wildcards.get(field(guard)) in members(guard, config)) == (op == "in")
    if op in ("eq", "not_eq"):
        return (wildcards.get(field(guard)) == str(guard["value"])) == (op == "eq")
    if op == "regex":
        try:
            return field(guard) in wildcards and re.search(guard["pattern"], wildcards[field(guard)]) is not None
        except re.error:
            return False
    if op == "config_eq":
        return config.get(guard["key"]) == str(guard["value"])
    if op == "env_set":
        return bool(environ.get(guard["name"]))
    if op == "env_eq":
        return environ.get(guard["name"]) == str(guard["value"])
    if op == "file_exists":
        return bool(exists(guard["path"]))
    if op == "not":
        return not holds(guard["guard"], wildcards, config, environ, exists)
    each = [holds(g, wildcards, config, environ, exists) for g in guard["guards"]]
    return all(each) if op == "and" else any(each)
