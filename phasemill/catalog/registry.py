"""Registry of the engine's queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from phasemill.catalog.sqlviews import with_views
from phasemill.session import size_broadcasts_at_runtime

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register a query; `views` names the SQL views (space separated) that `sql` selects from."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")

        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # the tables carry zone-less times, read as UTC; broadcasts follow measured sizes
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            size_broadcasts_at_runtime(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(views.split(), sql)
        return fn

    return add
