"""Named plans over the test tables, each with its equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickspark.names import quoted
from tickspark.session import tune

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def plan(name: str, oracle: str | None = None) -> Callable[[Plan], Plan]:
    def register(function: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"plan {name} is registered twice")
        PLANS[name] = lambda spark, sf_dir: function(tune(spark), sf_dir)
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def _nudge(digits: int) -> float:
    return 10.0 ** -(digits + 3)


def _round_scaled(value: Column, digits: int) -> Column:
    scale = F.lit(10.0**digits)
    scaled = value * scale
    return F.when(F.abs(scaled) < F.lit(float("inf")), F.round(scaled, 0) / scale).otherwise(value)


def rounded(df: DataFrame, digits: int = 6, exact: tuple[str, ...] = ()) -> DataFrame:
    """Round doubles, since sums in another order differ in their last bits; -0.0 becomes 0.0.

    A nudge far below the last kept digit moves exact ties off the edge, where engines round apart. Large values
    are scaled, rounded to a whole number and scaled back, as SQL engines do; ``F.round`` alone rounds their decimal text.

    ``exact`` columns are copied or divided values that agree to the last bit and stay as they are.
    """
    columns = []
    for field in df.schema.fields:
        column = F.col(quoted(field.name))
        if field.name in exact:
            pass
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = _round_scaled(column + F.lit(_nudge(digits)), digits) + F.lit(0.0)
        elif isinstance(field.dataType, T.IntegerType):
            column = column.cast("bigint")
        columns.append(column.alias(field.name))
    return df.select(*columns)


# --- SQL helpers -----------------------------------------------------------------------------------


def r(expression: str, name: str, digits: int = 6) -> str:
    return f'round(({expression}) + {_nudge(digits)!r}, {digits}) + 0.0 AS "{name}"'


def ratio_sql(a: str, b: str) -> str:
    inf = "CAST('inf' AS DOUBLE)"
    return f"(CASE WHEN ({b}) = 0 THEN CASE WHEN ({a}) > 0 THEN {inf} WHEN ({a}) < 0 THEN -{inf} END ELSE ({a}) / ({b}) END)"


def with_sql(*ctes: tuple[str, str] | str, select: str) -> str:
    parts = [c if isinstance(c, str) else f"{c[0]} AS ({c[1]})" for c in ctes]
    return "WITH " + ",\n".join(parts) + "\n" + select
