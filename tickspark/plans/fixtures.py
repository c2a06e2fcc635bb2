"""Views that give the generic test tables the shape of ticks, events, fills and scored groups.

Each view is one SELECT in SQL that both Spark and DuckDB read, so a query and its check start from
the same rows.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession

from tickspark.names import INTERVALS
from tickspark.operators.features import FeatureWindows

# One user's activity is one symbol's tape.
TICKS = """
SELECT event_id AS trade_id, concat('U', user_id, '-BTC') AS symbol, ts AS trade_time, value AS price,
       CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) + 1 AS DOUBLE) AS quantity,
       event_type IN ('error', 'signup') AS is_buyer_maker
FROM events
"""

# The events that everything is arranged around: purchases of more than 200.
LABELS = """
SELECT concat(concat('U', user_id, '-BTC'), ':BINANCE_SPOT:', CAST(event_id AS STRING)) AS pump_hash,
       concat('U', user_id, '-BTC') AS pumped_currency_pair, ts AS pump_time
FROM events WHERE event_type = 'purchase' AND value > 200
"""

# Several fills per (symbol, day); the order line number makes the tie-breaker.
FILLS = """
SELECT l_orderkey * 10 + l_linenumber AS trade_id, concat('S', l_suppkey, '-USDT') AS symbol, l_shipdate AS trade_time,
       l_extendedprice / l_quantity AS price, l_quantity AS quantity, l_returnflag = 'R' AS is_buyer_maker
FROM lineitem
"""

# Hours are the cross-sections, events their candidates, purchases above 20 the positives.
SCORED = """
SELECT strftime_hour AS pump_hash, CAST(event_id AS STRING) AS currency_pair,
       (event_type = 'purchase' AND value > 20) AS is_pumped,
       round(ln(value + 1) / 5, 3) AS score, round(CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 100, 2) AS score_b,
       pump_time
FROM (SELECT *, {hour_text} AS strftime_hour, {hour_start} AS pump_time FROM events)
"""
SCORED_SPARK = SCORED.format(hour_text="date_format(ts, 'yyyy-MM-dd-HH')", hour_start="to_timestamp_ntz(date_format(ts, 'yyyy-MM-dd HH'), 'yyyy-MM-dd HH')")
SCORED_DUCK = SCORED.format(hour_text="strftime(ts, '%Y-%m-%d-%H')", hour_start="date_trunc('hour', ts)")

PANEL_SLUGS = ["1D", "2D", "7D", "14D"]
PANEL_DECAYS = {"1D": timedelta(days=1), "2D": timedelta(days=2), "5D": timedelta(days=5)}
PANEL_WINDOWS = FeatureWindows(
    offsets={slug: INTERVALS[slug] for slug in PANEL_SLUGS}, decays=PANEL_DECAYS, horizon=timedelta(days=5)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run one of the SELECTs above over the tables of ``sf_dir``."""
    name = "lineitem" if "lineitem" in sql else "events"
    return spark.sql(sql.replace(f"FROM {name}", "FROM {source}"), source=table(spark, sf_dir, name))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, TICKS)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, LABELS)


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, FILLS)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SCORED_SPARK)
