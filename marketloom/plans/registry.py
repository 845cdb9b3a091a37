"""Registry of queries: name -> callable(spark, sf_dir), and the equivalent DuckDB SQL over the same tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bind

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of the bound tables. In sql, the names of bound views become common table expressions."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(bind.Tables(spark, sf_dir))
        if sql:
            SQL[name] = with_views(sql)
        return fn

    return add


def with_views(sql: str) -> str:
    """The query behind the definitions of all bound views that it names, directly or through others."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name, body in bind.VIEWS.items():
            if name not in need and re.search(rf"\b(?:from|join)\s+{name}\b", text):
                visit(body)
                need.append(name)

    visit(sql)
    recursive = bool(re.match(r"\s*with\s+recursive\b", sql, re.I))
    tail = re.sub(r"^\s*with\s+(recursive\s+)?", "", sql, flags=re.I)
    if not need:
        return sql
    head = ",\n".join(f"{n} as ({bind.VIEWS[n]})" for n in need)
    joined = tail != sql.lstrip() and re.match(r"\s*with\b", sql, re.I)
    return f"with {'recursive ' if recursive else ''}{head}{',' if joined else ''}\n{tail}"
