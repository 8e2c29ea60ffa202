"""All registered queries of the engine and the SQL that checks them.

``register`` pairs a query with its oracle; floating-point columns are rounded to nine places on both
sides, so that the order of additions does not show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeweave.sources.adapters import canonical, definition

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PLACES = 9


def _rounded(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.select(*(F.round(F.col(f"`{c}`"), PLACES).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))

    return run


def register(name: str, query: Query, sql: str | None = None, inputs: str = "", floats: str = "", is_rounded: bool = False) -> None:
    """Add a query; ``inputs`` are the adapters that ``sql`` names, ``floats`` its double columns; ``is_rounded`` if the query rounds them."""
    QUERIES[name] = query if is_rounded else _rounded(query)
    if sql is None:
        return
    heads = [f"\"{n}\" AS ({definition(n)})" for n in inputs.split()]
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        start, body = "WITH RECURSIVE ", ", ".join([*heads, body[len("WITH RECURSIVE ") :]])
    elif body.upper().startswith("WITH "):
        start, body = "WITH ", ", ".join([*heads, body[len("WITH ") :]])
    else:
        start, body = ("WITH " if heads else ""), ", ".join(heads) + (" " if heads else "") + body
    text = start + body
    if floats:
        text = f"SELECT * REPLACE ({', '.join(f'round({c}, {PLACES}) AS {c}' for c in floats.split())}) FROM ({text}) q"
    ORACLES[name] = text


def table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: canonical(spark, sf_dir, name)


from cladeweave.plans import curation_queries, sequence_queries, tree_queries  # noqa: E402, F401
