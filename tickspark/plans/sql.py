"""SQL building blocks of the checks, written straight from the definitions and not from the plans."""

from __future__ import annotations

from datetime import timedelta

from tickspark.names import INTERVALS
from tickspark.plans import fixtures as fx
from tickspark.plans.registry import r, ratio_sql

TICKS = ("ticks", fx.TICKS)
FILLS = ("fills", fx.FILLS)
LABELS = ("labelled", fx.LABELS)
SCORED = ("scored", fx.SCORED_DUCK)


def sql_interval(value: timedelta) -> str:
    return f"INTERVAL {int(value.total_seconds())} SECOND"


def orders(source: str = "ticks", name: str = "orders") -> tuple[str, str]:
    return (
        name,
        f"""
SELECT *, quantity_sign >= 0 AS is_long, abs(quote_abs - price_first * quantity_abs) AS quote_slippage_abs,
       abs(quote_abs - price_first * quantity_abs) * sign(quantity_sign) AS quote_slippage_sign
FROM (SELECT symbol, trade_time, arg_min(price, trade_id) AS price_first, arg_max(price, trade_id) AS price_last,
             sum(price * quantity) AS quote_abs, sum(price * quantity * side) AS quote_sign,
             sum(quantity * side) AS quantity_sign, sum(quantity) AS quantity_abs, count(*) AS num_ticks
      FROM (SELECT *, 1 - 2 * CAST(is_buyer_maker AS INT) AS side FROM {source}) GROUP BY symbol, trade_time)""",
    )


def sliced(windows) -> list[tuple[str, str]]:
    back, ahead = sql_interval(windows.lookback), sql_interval(windows.horizon)
    return [
        (
            "sliced",
            f"""
SELECT e.pump_hash, e.pump_time, o.*,
       lag(o.price_last) OVER (PARTITION BY e.pump_hash, o.symbol ORDER BY o.trade_time) AS price_last_prev
FROM labelled e JOIN orders o ON o.trade_time BETWEEN e.pump_time - {back} AND e.pump_time + {ahead}""",
        ),
        (
            "universe",
            f"""
SELECT DISTINCT e.pump_hash, e.pump_time, t.symbol
FROM labelled e JOIN (SELECT DISTINCT symbol, CAST(trade_time AS DATE) AS d FROM ticks) t
  ON t.d BETWEEN CAST(e.pump_time - {back} AS DATE) AND CAST(e.pump_time + {ahead} AS DATE)""",
        ),
        (
            "bars",
            """
SELECT pump_hash, pump_time, symbol, date_trunc('hour', trade_time) AS bar_time,
       (arg_max(price_last, trade_time) / arg_min(price_first, trade_time) - 1) * 1e4 AS ret, sum(quote_abs) AS q
FROM sliced GROUP BY ALL""",
        ),
    ]


def features(windows, baseline: str = "TRUE") -> list[tuple[str, str]]:
    """CTEs ending in ``features`` with one row per (pump_hash, currency_pair)."""
    gap = sql_interval(windows.gap)
    order_cols, bar_cols, final = [], [], []

    def returns(where: str) -> str:
        return (
            f"(arg_max(price_last, trade_time) FILTER ({where}) / arg_min_null(price_last_prev, trade_time) FILTER ({where}) - 1) * 1e4"
        )

    for slug, offset in windows.sorted_offsets:
        lo = f"pump_time - {gap} - {sql_interval(offset)}"
        w = f"WHERE trade_time BETWEEN {lo} AND pump_time - {gap}"
        b = f"WHERE bar_time BETWEEN {lo} AND pump_time - {gap}"
        n = f"count(*) FILTER ({w})"
        order_cols += [
            f'{returns(w)} AS "asset_return@{slug}"',
            f'count(*) FILTER ({w} AND is_long) / nullif({n}, 0) AS "share_of_long_trades@{slug}"',
            f"""CASE WHEN {n} > 0 THEN CASE WHEN min(quote_abs) FILTER ({w}) = max(quote_abs) FILTER ({w}) THEN CAST('inf' AS DOUBLE)
            ELSE 1 + {n} / (sum(ln(quote_abs)) FILTER ({w}) - {n} * ln(min(quote_abs) FILTER ({w}))) END END AS "powerlaw_alpha@{slug}" """,
            f'sum(quote_slippage_sign) FILTER ({w}) / nullif(sum(quote_slippage_abs) FILTER ({w}), 0) AS "slippage_imbalance@{slug}"',
            f'sum(quote_sign) FILTER ({w}) / nullif(sum(quote_abs) FILTER ({w}), 0) AS "flow_imbalance@{slug}"',
            f'{n} AS "num_trades@{slug}"',
        ]
        bar_cols += [f'avg(ret) FILTER ({b}) AS "r@{slug}"', f'avg(q) FILTER ({b}) AS "q@{slug}"']
        final += [
            r(f'o."asset_return@{slug}"', f"asset_return@{slug}"),
            r(ratio_sql(f'b."r@{slug}"', "b.rs"), f"asset_return_zscore@{slug}"),
            r(ratio_sql(f'b."q@{slug}" - b.qm', "b.qs"), f"quote_abs_zscore@{slug}"),
            r(f'o."share_of_long_trades@{slug}"', f"share_of_long_trades@{slug}"),
            r(f'o."powerlaw_alpha@{slug}"', f"powerlaw_alpha@{slug}"),
            r(f'o."slippage_imbalance@{slug}"', f"slippage_imbalance@{slug}"),
            r(f'o."flow_imbalance@{slug}"', f"flow_imbalance@{slug}"),
            f'coalesce(o."num_trades@{slug}", 0) AS "num_trades@{slug}"',
        ]
    for slug, offset in windows.sorted_decays:
        w = f"WHERE trade_time BETWEEN pump_time AND pump_time + {sql_interval(offset)}"
        order_cols.append(f'{returns(w)} AS "target_return@{slug}"')
        final.append(r(f'o."target_return@{slug}"', f"target_return@{slug}"))
    prior = "(SELECT count(*) FROM labelled l WHERE l.pumped_currency_pair = u.symbol AND l.pump_time < u.pump_time)"
    # A correlated count is slow in bulk; an equivalent join keeps the check quick.
    return [
        *sliced(windows),
        ("order_windows", f"SELECT pump_hash, symbol, {', '.join(order_cols)} FROM sliced GROUP BY pump_hash, symbol"),
        (
            "bar_windows",
            f"""SELECT pump_hash, symbol, stddev_samp(ret) FILTER (WHERE {baseline}) AS rs, avg(q) FILTER (WHERE {baseline}) AS qm,
            stddev_samp(q) FILTER (WHERE {baseline}) AS qs, {', '.join(bar_cols)} FROM bars GROUP BY pump_hash, symbol""",
        ),
        (
            "features",
            f"""
SELECT u.pump_hash, u.pump_time, u.symbol AS currency_pair, {', '.join(final)}, {prior} AS num_prev_pump
FROM universe u LEFT JOIN order_windows o ON u.pump_hash = o.pump_hash AND u.symbol = o.symbol
LEFT JOIN bar_windows b ON u.pump_hash = b.pump_hash AND u.symbol = b.symbol""",
        ),
    ]


def panel_windows_ctes(labels=LABELS, windows=fx.PANEL_WINDOWS) -> list[tuple[str, str]]:
    return [TICKS, labels, orders(), *features(windows)]


def panel(labels=LABELS, windows=fx.PANEL_WINDOWS) -> list[tuple[str, str]]:
    """CTEs ending in ``panel``: features of events whose target has a row, with label columns."""
    return [
        *panel_windows_ctes(labels, windows),
        (
            "panel",
            """
SELECT f.*, l.pumped_currency_pair, f.currency_pair = l.pumped_currency_pair AS is_pumped
FROM features f JOIN labelled l ON f.pump_hash = l.pump_hash
WHERE EXISTS (SELECT 1 FROM universe u WHERE u.pump_hash = l.pump_hash AND u.symbol = l.pumped_currency_pair)""",
        ),
    ]


def interval(slug: str) -> str:
    return sql_interval(INTERVALS[slug])
