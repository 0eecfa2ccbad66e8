"""Named queries over the given tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixtures import Tables, with_views


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def register(
    name: str, build: Callable[[Tables], DataFrame], sql: str | None = None, views: str = "", also: str = "",
    decimals: str = "", recursive: bool = False,
) -> None:
    """Add a query; ``decimals`` names columns both sides round to six places."""
    cols = decimals.split()
    if sql is not None:
        sql = with_views(sql, *views.split(), also=also)
        if recursive:
            sql = sql.replace("WITH ", "WITH RECURSIVE ", 1)
        if cols:
            rounding = ", ".join(f"round({c}, 6) AS {c}" for c in cols)
            sql = f"SELECT * REPLACE ({rounding}) FROM ({sql})"

    def run(t: Tables) -> DataFrame:
        return build(t).withColumns({c: F.round(c, 6) for c in cols}) if cols else build(t)

    CATALOG[name] = Query(run, sql)
