
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.adapters import VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def with_views(body: str) -> str:
    """Prefixes the views that a statement names, and those they name."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, view in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(view)
                if name not in needed:
                    needed.append(name)

    visit(body)
    parts = [f"{n} AS ({duck(VIEWS[n])})" for n in needed]
    body = body.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(parts)}, {body[5:]}"
    return f"WITH {', '.join(parts)} {body}"


def duck(sql: str) -> str:
    return re.sub(r"EPOCH_US\((\w+)\)", r"epoch_us(\1)", sql)


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = with_views(sql)
        return f

    return add
