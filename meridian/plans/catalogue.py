"""The table of registered queries: each is a plan over derived tables, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meridian.plans.views import duck, view



class Columns:
    """A tuple of Columns that is made when it is used: plans are imported before there is a session."""

    def __init__(self, make):
        self._make = make

    def __iter__(self):
        return iter(self._make())

    def __getitem__(self, i):
        return self._make()[i]

    def __len__(self):
        return len(self._make())


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, views: tuple[str, ...], build, sql: str | tuple[str, str] | None) -> None:
    """Add a query that applies ``build`` to the derived tables ``views``; ``sql`` follows their WITH clause, of which a first item
    ``recursive`` makes a recursive one (None where SQL can't express it)."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(*[view(spark, sf_dir, v) for v in views])

    query.__name__ = name
    QUERIES[name] = query
    if isinstance(sql, tuple):
        ORACLE[name] = duck(views[0], sql[1], *views[1:]).replace("with ", "with recursive ", 1)
    elif sql is not None:
        ORACLE[name] = duck(views[0], sql, *views[1:])
