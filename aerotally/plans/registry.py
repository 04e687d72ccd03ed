"""All queries of the library's own operators, gathered from the binding modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
from aerotally.plans import bind_agreement, bind_annotations, bind_flights, bind_formats, bind_matching, bind_tiling  # noqa: E402

_MODULES: tuple = (bind_matching, bind_flights, bind_annotations, bind_agreement, bind_tiling, bind_formats)


def queries() -> dict[str, Query]:
    return {name: query for module in _MODULES for name, (query, _) in module.BINDINGS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, (_, sql) in module.BINDINGS.items() if sql}
