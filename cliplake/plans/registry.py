"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cliplake.operators import nested, periods
from cliplake.plans import reference


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": periods.p1_found,
        "p3_found": nested.p3_found,
        **reference.QUERIES,
    }


def oracle_sql() -> dict[str, str]:
    return {"p1_found": periods.P1_SQL, **reference.SQL}
