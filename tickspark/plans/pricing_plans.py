"""Plans for as-of prices, rates, impact fits, execution and equity."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.functions.identifiers import term_asset
from tickspark.names import CANDIDATE, EVENT_TIME, GROUP, LABEL, SCORE, TARGET
from tickspark.operators import asof, bars, impact, orders, portfolio
from tickspark.plans import fixtures as fx
from tickspark.plans.registry import plan, r, rounded, with_sql
from tickspark.plans.sql import LABELS, TICKS
from tickspark.plans.sql import orders as orders_cte
from tickspark.plans.tick_plans import CANDLE_SQL
from tickspark.sources.candles import deduplicate

# --- Shared inputs -------------------------------------------------------------------------------------

# Candidates of an event are the symbols that traded on its date, scored by that date's volume.
_CANDIDATES = (
    "candidates",
    """SELECT e.pump_hash, e.pump_time, e.pumped_currency_pair, v.symbol AS currency_pair, v.symbol = e.pumped_currency_pair AS is_pumped, v.score
    FROM labelled e JOIN (SELECT symbol, CAST(trade_time AS DATE) AS d, round(sum(price * quantity) + 1e-6, 3) AS score FROM ticks GROUP BY 1, 2) v
    ON v.d = CAST(e.pump_time AS DATE)""",
)
_RATES = (
    "rates",
    "SELECT 'BTC-USDT' AS symbol, time_bucket(INTERVAL 1 HOUR, trade_time) AS minute, sum(price * quantity) / sum(quantity) AS rate FROM ticks GROUP BY 2",
)


_LEGS = 3


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates that portfolios of up to three legs can hold: a date's events share its best symbols."""
    volume = fx.ticks(spark, sf_dir).groupBy(F.col("symbol").alias(CANDIDATE), F.to_date("trade_time").alias("d")).agg(
        F.round(F.sum(F.col("price") * F.col("quantity")) + F.lit(1e-6), 3).alias(SCORE)
    )
    labels = fx.labels(spark, sf_dir).withColumn("d", F.to_date(EVENT_TIME))
    return portfolio.shared_candidates(labels, volume, ["d"], _LEGS).select(
        GROUP,
        EVENT_TIME,
        TARGET,
        CANDIDATE,
        (F.col(CANDIDATE) == F.col(TARGET)).alias(LABEL),
        SCORE,
    )


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.vwap_series(fx.ticks(spark, sf_dir), "BTC-USDT")


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders.aggregate_orders(fx.ticks(spark, sf_dir))


def own_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's own target as a leg."""
    return fx.labels(spark, sf_dir).withColumn(CANDIDATE, F.col(TARGET))


_TOP = (
    "portfolio",
    """SELECT *, 1.0 / count(*) OVER (PARTITION BY pump_hash) AS weight FROM
    (SELECT *, row_number() OVER (PARTITION BY pump_hash ORDER BY score DESC, currency_pair) AS rank FROM candidates) WHERE rank <= 3""",
)


def _rate_lookup(name: str, points: str, time: str) -> tuple[str, str]:
    """CTE of distinct times with the day's last rate at or before the minute, else the first after."""
    return (
        name,
        f"""SELECT p.t, coalesce(arg_max(x.rate, x.minute) FILTER (WHERE x.minute <= date_trunc('minute', p.t)),
        arg_min(x.rate, x.minute) FILTER (WHERE x.minute >= date_trunc('minute', p.t))) AS rate
        FROM (SELECT DISTINCT {time} AS t FROM {points}) p JOIN rates x ON CAST(x.minute AS DATE) = CAST(p.t AS DATE) GROUP BY p.t""",
    )


# --- As-of joins ---------------------------------------------------------------------------------------

_ASOF = """SELECT l.pump_hash, o.{price} AS price, o.trade_time AS price_time FROM
(SELECT pump_hash, pumped_currency_pair AS symbol, pump_time {shift} AS t FROM labelled) l
ASOF LEFT JOIN orders o ON l.symbol = o.symbol AND l.t {test} o.trade_time"""


@plan(
    "j02_asof_backward",
    with_sql(TICKS, LABELS, orders_cte(), select=_ASOF.format(price="price_last", shift="- INTERVAL 15 MINUTE", test=">=")),
)
def asof_backward(spark, sf_dir):
    points = fx.labels(spark, sf_dir).select(
        GROUP, F.col(TARGET).alias("symbol"), (F.col(EVENT_TIME) - F.lit(timedelta(minutes=15))).alias("trade_time")
    )
    series = market(spark, sf_dir).withColumnRenamed("price_last", "price")
    return asof.asof_join(points, series, ["symbol"], "trade_time", "price").select(GROUP, "price", "price_time")


@plan(
    "j03_asof_forward",
    with_sql(TICKS, LABELS, orders_cte(), select=_ASOF.format(price="price_first", shift="+ INTERVAL 1 MINUTE", test="<=")),
)
def asof_forward(spark, sf_dir):
    points = fx.labels(spark, sf_dir).select(
        GROUP, F.col(TARGET).alias("symbol"), (F.col(EVENT_TIME) + F.lit(timedelta(minutes=1))).alias("trade_time")
    )
    series = market(spark, sf_dir).withColumnRenamed("price_first", "price")
    found = asof.asof_join(points, series, ["symbol"], "trade_time", "price", "forward")
    return found.select(GROUP, "price", "price_time")


def _leg_prices_cte(source: str = "portfolio", before: str = "INTERVAL 15 MINUTE", after: str = "INTERVAL 1 MINUTE", keys: str = "") -> tuple[str, str]:
    buy = f"WHERE o.trade_time <= l.pump_time - {before}"
    sell = f"WHERE o.trade_time >= l.pump_time + CASE WHEN l.currency_pair = l.pumped_currency_pair THEN {after} ELSE INTERVAL 0 SECOND END"
    return (
        "priced",
        f"""SELECT p.*, CASE WHEN f.entry_ts IS NOT NULL AND f.exit_ts IS NOT NULL THEN f.entry_price END AS entry_price,
        CASE WHEN f.exit_ts IS NOT NULL THEN f.entry_ts END AS entry_ts,
        CASE WHEN f.entry_ts IS NOT NULL AND f.exit_ts IS NOT NULL THEN f.exit_price END AS exit_price,
        CASE WHEN f.entry_ts IS NOT NULL THEN f.exit_ts END AS exit_ts
        FROM {source} p LEFT JOIN (SELECT l.pump_hash, l.currency_pair, {keys} arg_max(o.price_last, o.trade_time) FILTER ({buy}) AS entry_price,
          max(o.trade_time) FILTER ({buy}) AS entry_ts, arg_min(o.price_first, o.trade_time) FILTER ({sell}) AS exit_price,
          min(o.trade_time) FILTER ({sell}) AS exit_ts
          FROM {source} l JOIN orders o ON o.symbol = l.currency_pair AND o.trade_time >= l.pump_time - INTERVAL 1 DAY AND o.trade_time < l.pump_time + INTERVAL 1 DAY
          GROUP BY ALL) f ON p.pump_hash = f.pump_hash AND p.currency_pair = f.currency_pair""",
    )


@plan(
    "j04_leg_prices",
    with_sql(
        TICKS,
        LABELS,
        orders_cte(),
        _CANDIDATES,
        _TOP,
        _leg_prices_cte(),
        select="SELECT pump_hash, currency_pair, entry_price, entry_ts, exit_price, exit_ts FROM priced",
    ),
)
def leg_prices(spark, sf_dir):
    chosen = portfolio.select_top_k(candidates(spark, sf_dir), _LEGS)
    return asof.leg_prices(chosen, market(spark, sf_dir)).select(
        GROUP, CANDIDATE, "entry_price", "entry_ts", "exit_price", "exit_ts"
    )


def minute_rates(spark, sf_dir):
    return bars.vwap_series(fx.ticks(spark, sf_dir), "BTC-USDT")


@plan(
    "j05_nearest_minute_rate",
    with_sql(
        TICKS,
        _RATES,
        _rate_lookup("looked", "ticks", "trade_time"),
        select=f"SELECT t.trade_id, {r('l.rate', 'rate')} FROM ticks t LEFT JOIN looked l ON l.t = t.trade_time",
    ),
)
def nearest_minute_rate(spark, sf_dir):
    points = fx.ticks(spark, sf_dir).select("trade_id", "trade_time", F.lit("BTC-USDT").alias("symbol"))
    return rounded(asof.nearest_minute_rate(points, minute_rates(spark, sf_dir), "trade_time").select("trade_id", "rate"))


@plan(
    "j06_currency_conversion",
    with_sql(
        TICKS,
        _RATES,
        _rate_lookup("looked", "ticks", "trade_time"),
        select=f"""SELECT t.trade_id, {r("CASE t.trade_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN l.rate WHEN 2 THEN 1 / (l.rate / 100) END", 'quote_to_usdt')}
        FROM ticks t LEFT JOIN looked l ON l.t = t.trade_time""",
    ),
)
def currency_conversion(spark, sf_dir):
    """USDT itself, a direct pair, an inverse pair, and an asset without any pair."""
    direct = minute_rates(spark, sf_dir)
    inverse = direct.select(F.lit("USDT-EUR").alias("symbol"), "minute", (F.col("rate") / 100).alias("rate"))
    assets = F.array(F.lit("USDT"), F.lit("BTC"), F.lit("EUR"), F.lit("XYZ"))
    points = fx.ticks(spark, sf_dir).select("trade_id", "trade_time", F.get(assets, F.col("trade_id") % 4).alias("asset"))
    found = asof.quote_to_usdt(points, direct.unionByName(inverse), F.col("asset"), "trade_time")
    return rounded(found.select("trade_id", "quote_to_usdt"))


@plan(
    "w11_buy_and_hold",
    with_sql(
        TICKS,
        LABELS,
        _RATES,
        _rate_lookup("looked", "labelled", "pump_time"),
        select=f"""SELECT l.pump_hash, l.pump_time, {r('coalesce(x.rate / lag(x.rate) OVER (ORDER BY l.pump_time, l.pump_hash) - 1, 0)', 'portfolio_return')}
        FROM labelled l JOIN looked x ON x.t = l.pump_time""",
    ),
)
def buy_and_hold(spark, sf_dir):
    return rounded(asof.buy_and_hold(fx.labels(spark, sf_dir), rates(spark, sf_dir)))


@plan(
    "w12_keep_last",
    """SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice, max(o_orderkey) AS o_orderkey,
    arg_max(o_orderdate, o_orderkey) AS o_orderdate FROM orders GROUP BY o_custkey""",
)
def keep_last(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return deduplicate(rows, ["o_custkey"], "o_orderkey")


# --- Impact ------------------------------------------------------------------------------------------------


def _samples(candle_cte: str, keys: str, rate: str = "1.0", sell_only: bool = False) -> str:
    side = "AND net < 0" if sell_only else ""
    return f"""SELECT {keys}, open_time AS trade_time, previous AS price_first, close_price AS price_last, abs(net) AS notional_quote,
    abs(net) * {rate} AS notional_usdt, CASE WHEN net > 0 THEN 1 ELSE -1 END AS side, abs(close_price / previous - 1) * 1e4 AS impact_bps FROM
    (SELECT *, lag(close_price) OVER (PARTITION BY {keys} ORDER BY open_time) AS previous, 2 * taker_buy_quote_asset_volume - quote_asset_volume AS net
     FROM {candle_cte}) WHERE previous > 0 AND net <> 0 {side}"""


_BETA = "coalesce(greatest(sum(sqrt(notional_usdt) * impact_bps) / nullif(sum(notional_usdt), 0), 0), 0)"
_HOURLY_CANDLES = ("candles", CANDLE_SQL.format(size="1 HOUR", source="ticks"))
_HOURLY_SAMPLES = ("samples", _samples("candles", "symbol", "2.0"))


def hourly_samples(spark, sf_dir):
    return impact.candle_samples(bars.trades_to_candles(fx.ticks(spark, sf_dir), "1 hour"), 2.0)


@plan(
    "a17_candle_samples",
    with_sql(
        TICKS,
        _HOURLY_CANDLES,
        _HOURLY_SAMPLES,
        select=f"""SELECT symbol, trade_time, price_first, price_last, {r('notional_quote', 'notional_quote')}, {r('notional_usdt', 'notional_usdt')}, side,
        {r('impact_bps', 'impact_bps')} FROM samples""",
    ),
)
def candle_samples(spark, sf_dir):
    return rounded(hourly_samples(spark, sf_dir), exact=("price_first", "price_last"))


@plan(
    "a17_sell_samples",
    with_sql(
        TICKS,
        _HOURLY_CANDLES,
        ("samples", _samples("candles", "symbol", sell_only=True)),
        select=f"SELECT symbol, count(*) AS samples, max(side) AS side, {r('sum(impact_bps)', 'impact')} FROM samples GROUP BY symbol",
    ),
)
def sell_samples(spark, sf_dir):
    samples = impact.candle_samples(bars.trades_to_candles(fx.ticks(spark, sf_dir), "1 hour"), sell_only=True)
    return rounded(
        samples.groupBy("symbol").agg(
            F.count("*").alias("samples"), F.max("side").alias("side"), F.sum("impact_bps").alias("impact")
        )
    )


@plan(
    "a18_a19_candle_fit",
    with_sql(
        TICKS,
        _HOURLY_CANDLES,
        _HOURLY_SAMPLES,
        select=f"SELECT symbol, {r(_BETA, 'beta')}, count(*) AS num_samples, '1h' AS sample_frequency FROM samples GROUP BY symbol",
    ),
)
def candle_fit(spark, sf_dir):
    return rounded(impact.fit(hourly_samples(spark, sf_dir), frequency="1h"))


@plan(
    "a19_order_fit",
    with_sql(
        ("fills", fx.FILLS),
        orders_cte("fills"),
        ("samples", "SELECT symbol, quote_abs AS notional_usdt, abs(price_last / price_first - 1) * 1e4 AS impact_bps FROM orders WHERE quote_abs > 0"),
        select=f"SELECT symbol, {r(_BETA, 'beta')}, count(*) AS num_samples, 'trade' AS sample_frequency FROM samples GROUP BY symbol",
    ),
)
def order_fit(spark, sf_dir):
    return rounded(impact.fit(orders.impact_orders(fx.fills(spark, sf_dir)), frequency="trade"))


@plan(
    "a20_side_diagnostics",
    with_sql(
        TICKS,
        _HOURLY_CANDLES,
        _HOURLY_SAMPLES,
        ("models", f"SELECT symbol, {_BETA} AS beta FROM samples GROUP BY symbol"),
        select=f"""SELECT m.symbol, v.name AS side, count(s.side) AS num_samples, {r('coalesce(median(s.impact_bps), 0)', 'median_impact_bps')},
        {r('coalesce(max(s.impact_bps), 0)', 'max_impact_bps')}, {r('max(m.beta)', 'beta')} FROM models m CROSS JOIN (VALUES ('buy', 1), ('sell', -1)) v(name, side)
        LEFT JOIN samples s ON s.symbol = m.symbol AND s.side = v.side GROUP BY m.symbol, v.name""",
    ),
)
def side_diagnostics(spark, sf_dir):
    return rounded(impact.side_diagnostics(hourly_samples(spark, sf_dir)))


@plan(
    "a21_fit_quality",
    with_sql(
        TICKS,
        _HOURLY_CANDLES,
        _HOURLY_SAMPLES,
        ("models", f"SELECT symbol, {_BETA} AS beta FROM samples GROUP BY symbol"),
        ("centred", "SELECT s.*, beta, avg(impact_bps) OVER (PARTITION BY s.symbol, side) AS mean FROM samples s JOIN models m ON s.symbol = m.symbol"),
        select=f"""SELECT symbol, side, {r('CASE WHEN count(*) > 1 THEN 1 - sum(pow(impact_bps - beta * sqrt(notional_usdt), 2)) / sum(pow(impact_bps - mean, 2)) ELSE 0 END', 'r_squared', 4)}
        FROM centred GROUP BY symbol, side""",
    ),
)
def fit_quality(spark, sf_dir):
    return rounded(impact.fit_quality(hourly_samples(spark, sf_dir)), 4)


def _regime_ctes(name: str, legs: str, start: str, stop: str, size: str, sell_only: bool) -> list[tuple[str, str]]:
    """CTEs ``{name}_samples`` (with rate at the event) and ``{name}_fit`` for each leg of ``legs``."""
    return [
        (
            f"{name}_ticks",
            f"""SELECT l.pump_hash, l.currency_pair, l.pump_time, t.* FROM (SELECT DISTINCT pump_hash, currency_pair, pump_time FROM {legs}) l
            JOIN ticks t ON t.symbol = l.currency_pair AND t.trade_time >= l.pump_time + {start} AND t.trade_time < l.pump_time + {stop}""",
        ),
        (
            f"{name}_candles",
            CANDLE_SQL.format(size=size, source=f"{name}_ticks")
            .replace("SELECT symbol,", "SELECT pump_hash, currency_pair, pump_time,", 1)
            .replace("GROUP BY 1, 2", "GROUP BY 1, 2, 3, 4"),
        ),
        (
            f"{name}_samples",
            f"""SELECT s.* REPLACE (s.notional_quote * coalesce(x.rate, 1) AS notional_usdt) FROM
            ({_samples(f'{name}_candles', 'pump_hash, currency_pair, pump_time', sell_only=sell_only)}) s LEFT JOIN event_rates x ON x.t = s.pump_time""",
        ),
        (f"{name}_fit", f"SELECT pump_hash, currency_pair, {_BETA} AS beta, count(*) AS num_samples FROM {name}_samples GROUP BY 1, 2"),
    ]


_EVENT_RATES = _rate_lookup("event_rates", "labelled", "pump_time")
_OWN = ("own", "SELECT *, pumped_currency_pair AS currency_pair FROM labelled")
_FIT_SELECT = """SELECT l.pump_hash, l.pump_time, l.currency_pair, {beta}, {rate}, coalesce(f.num_samples, 0) AS num_samples, '{frequency}' AS sample_frequency
FROM own l LEFT JOIN {name}_fit f ON l.pump_hash = f.pump_hash AND l.currency_pair = f.currency_pair LEFT JOIN event_rates x ON x.t = l.pump_time"""
_BETA_OUT, _RATE_OUT = r("coalesce(f.beta, 0)", "beta"), r("coalesce(x.rate, 1)", "quote_to_usdt")
_EXIT_DAYS = timedelta(days=5)


def leg_rates(spark, sf_dir, legs):
    rated = asof.quote_to_usdt(legs, rates(spark, sf_dir), term_asset(F.col(CANDIDATE)), EVENT_TIME, "rate")
    return rated.select(GROUP, CANDIDATE, "rate")


@plan(
    "a22_lookback_fit",
    with_sql(
        TICKS,
        LABELS,
        _RATES,
        _EVENT_RATES,
        _OWN,
        *_regime_ctes("entry", "own", "INTERVAL (-14) DAY", "INTERVAL 0 DAY", "5 MINUTE", False),
        select=_FIT_SELECT.format(beta=_BETA_OUT, rate=_RATE_OUT, frequency="5min", name="entry"),
    ),
)
def lookback_fit(spark, sf_dir):
    legs = own_legs(spark, sf_dir)
    fitted = impact.fit_for_events(fx.ticks(spark, sf_dir), legs, impact.entry_regime(), leg_rates(spark, sf_dir, legs))
    return rounded(fitted)


@plan(
    "a23_exit_fit",
    with_sql(
        TICKS,
        LABELS,
        _RATES,
        _EVENT_RATES,
        _OWN,
        *_regime_ctes("exit", "own", "INTERVAL 0 DAY", "INTERVAL 5 DAY", "5 SECOND", True),
        select=_FIT_SELECT.format(beta=_BETA_OUT, rate=_RATE_OUT, frequency="5s", name="exit"),
    ),
)
def exit_fit(spark, sf_dir):
    legs = own_legs(spark, sf_dir)
    regime = impact.exit_regime(_EXIT_DAYS)
    return rounded(impact.fit_for_events(fx.ticks(spark, sf_dir), legs, regime, leg_rates(spark, sf_dir, legs)))


@plan(
    "a23_ten_minute_exit_fit",
    with_sql(
        TICKS,
        LABELS,
        _RATES,
        _EVENT_RATES,
        _OWN,
        *_regime_ctes("exit", "own", "INTERVAL 0 DAY", "INTERVAL 10 MINUTE", "5 SECOND", True),
        select=_FIT_SELECT.format(beta=_BETA_OUT, rate=_RATE_OUT, frequency="5s", name="exit"),
    ),
)
def ten_minute_exit_fit(spark, sf_dir):
    legs = own_legs(spark, sf_dir)
    regime = impact.exit_regime()
    return rounded(impact.fit_for_events(fx.ticks(spark, sf_dir), legs, regime, leg_rates(spark, sf_dir, legs)))


@plan(
    "a24_best_entry_example",
    with_sql(
        TICKS,
        LABELS,
        _RATES,
        _EVENT_RATES,
        _OWN,
        *_regime_ctes("entry", "own", "INTERVAL (-14) DAY", "INTERVAL 0 DAY", "5 MINUTE", False),
        (
            "stats",
            f"""SELECT pump_hash, pump_time, currency_pair AS symbol, least(count(*) FILTER (WHERE side = 1), count(*) FILTER (WHERE side = -1)) AS smaller_side,
            count(*) FILTER (WHERE impact_bps > 0) AS positive_impacts, {_BETA} AS beta FROM entry_samples GROUP BY 1, 2, 3""",
        ),
        ("activity", "SELECT t.pump_hash, t.fills, c.candles FROM (SELECT pump_hash, count(*) AS fills FROM entry_ticks GROUP BY 1) t JOIN (SELECT pump_hash, count(*) AS candles FROM entry_candles GROUP BY 1) c ON t.pump_hash = c.pump_hash"),
        select=f"""SELECT s.pump_hash, symbol, smaller_side, positive_impacts, {r('beta', 'beta')} FROM stats s JOIN activity a ON s.pump_hash = a.pump_hash
        WHERE fills >= 10 AND candles >= 10 AND smaller_side >= 3 AND positive_impacts >= 5 ORDER BY smaller_side DESC, positive_impacts DESC, pump_time, s.pump_hash LIMIT 1""",
    ),
)
def best_entry_example(spark, sf_dir):
    legs = own_legs(spark, sf_dir)
    best = impact.best_entry_example(
        fx.ticks(spark, sf_dir),
        legs,
        leg_rates(spark, sf_dir, legs),
        min_candles=10,
        min_side_samples=3,
        min_positive_impacts=5,
    )
    return rounded(best)


@plan(
    "a24_best_exit_example",
    with_sql(
        TICKS,
        LABELS,
        _RATES,
        _EVENT_RATES,
        _OWN,
        *_regime_ctes("exit", "own", "INTERVAL 0 DAY", "INTERVAL 5 DAY", "5 SECOND", True),
        ("stats", f"SELECT pump_hash, pump_time, currency_pair AS symbol, count(*) AS num_samples, {_BETA} AS beta FROM exit_samples GROUP BY 1, 2, 3"),
        ("activity", "SELECT t.pump_hash, t.fills, c.candles FROM (SELECT pump_hash, count(*) AS fills FROM exit_ticks GROUP BY 1) t JOIN (SELECT pump_hash, count(*) AS candles FROM exit_candles GROUP BY 1) c ON t.pump_hash = c.pump_hash"),
        select=f"""SELECT s.pump_hash, symbol, num_samples, {r('beta', 'beta')} FROM stats s JOIN activity a ON s.pump_hash = a.pump_hash
        WHERE fills >= 3 AND candles >= 3 AND num_samples >= 2 ORDER BY num_samples DESC, pump_time, s.pump_hash LIMIT 1""",
    ),
)
def best_exit_example(spark, sf_dir):
    legs = own_legs(spark, sf_dir)
    best = impact.best_exit_example(
        fx.ticks(spark, sf_dir),
        legs,
        leg_rates(spark, sf_dir, legs),
        impact.exit_regime(_EXIT_DAYS),
        min_fills=3,
        min_candles=3,
        min_samples=2,
    )
    return rounded(best)


# --- Execution ------------------------------------------------------------------------------------------------

_CONFIG = portfolio.ExecutionConfig(portfolio_size=_LEGS, use_price_impact=True, order_notional_usdt=100.0, exit_window=_EXIT_DAYS)
_RAW_CONFIG = portfolio.ExecutionConfig(portfolio_size=_LEGS)


def _execution(sizes: str, with_impact: bool) -> list[tuple[str, str]]:
    """CTEs ending in ``executed`` (legs x sizes) and ``stats`` (events x sizes)."""
    fits = [
        *_regime_ctes("entry", "portfolio", "INTERVAL (-14) DAY", "INTERVAL 0 DAY", "5 MINUTE", False),
        ("own", "SELECT * FROM portfolio WHERE currency_pair = pumped_currency_pair"),
        *_regime_ctes("exit", "own", "INTERVAL 0 DAY", "INTERVAL 5 DAY", "5 SECOND", True),
    ]
    bps = {
        "entry": "2.0 / 3.0 * coalesce(fe.beta, 0) * sqrt(order_usdt / entry_rate * coalesce(xr.rate, 1))",
        "exit": "2.0 / 3.0 * CASE WHEN coalesce(fx.num_samples, 0) > 0 THEN fx.beta ELSE coalesce(fe.beta, 0) END * sqrt(order_usdt / entry_rate * coalesce(xr.rate, 1))",
    }
    bars_ = {
        "entry": "coalesce(fe.num_samples, 0)",
        "exit": "CASE WHEN coalesce(fx.num_samples, 0) > 0 THEN fx.num_samples ELSE coalesce(fe.num_samples, 0) END",
    }
    if not with_impact:
        bps = {k: "0.0" for k in bps}
        bars_ = {k: "0" for k in bars_}
    joins = (
        """LEFT JOIN entry_fit fe ON fe.pump_hash = q.pump_hash AND fe.currency_pair = q.currency_pair
        LEFT JOIN exit_fit fx ON fx.pump_hash = q.pump_hash AND fx.currency_pair = q.currency_pair
        LEFT JOIN event_rates xr ON xr.t = q.pump_time"""
        if with_impact
        else ""
    )
    return [
        TICKS,
        LABELS,
        orders_cte(),
        _CANDIDATES,
        _TOP,
        _RATES,
        _EVENT_RATES,
        _leg_prices_cte(),
        _rate_lookup("entry_rates", "priced", "entry_ts"),
        _rate_lookup("exit_rates", "priced", "exit_ts"),
        *(fits if with_impact else []),
        (
            "quoted",
            f"""SELECT p.*, a.rate AS entry_rate, b.rate AS exit_rate, s.order_usdt FROM priced p LEFT JOIN entry_rates a ON a.t = p.entry_ts
            LEFT JOIN exit_rates b ON b.t = p.exit_ts CROSS JOIN (SELECT {sizes} AS order_usdt) s""",
        ),
        (
            "executed",
            f"""SELECT *, CASE WHEN entry_ts IS NOT NULL THEN greatest(1e-12, entry_base * (1 + entry_impact_bps / 1e4)) END AS entry_price,
            CASE WHEN entry_ts IS NOT NULL THEN greatest(1e-12, exit_base * (1 - exit_impact_bps / 1e4)) END AS exit_price FROM
            (SELECT q.* EXCLUDE (entry_price, exit_price), q.entry_price AS entry_base, q.exit_price AS exit_base,
             order_usdt / entry_rate AS filled_quote, order_usdt / entry_rate * entry_rate AS entry_usdt, order_usdt / entry_rate * exit_rate AS exit_usdt,
             coalesce({bps['entry']}, 0) AS entry_impact_bps, coalesce({bps['exit']}, 0) AS exit_impact_bps,
             CASE WHEN entry_ts IS NULL THEN 0 ELSE {bars_['entry']} END AS entry_impact_num_bars,
             CASE WHEN entry_ts IS NULL THEN 0 ELSE {bars_['exit']} END AS exit_impact_num_bars FROM quoted q {joins})""",
        ),
        (
            "stats",
            """SELECT pump_hash, pump_time, order_usdt,
            coalesce(sum(weight * (exit_price / entry_price - 1 - 0.0025) * exit_usdt) FILTER (WHERE entry_ts IS NOT NULL), 0) AS pnl,
            coalesce(sum(weight * entry_impact_bps) FILTER (WHERE entry_ts IS NOT NULL) / sum(weight) FILTER (WHERE entry_ts IS NOT NULL), 0) AS mean_entry_impact_bps,
            coalesce(sum(weight * exit_impact_bps) FILTER (WHERE entry_ts IS NOT NULL) / sum(weight) FILTER (WHERE entry_ts IS NOT NULL), 0) AS mean_exit_impact_bps,
            coalesce(sum(weight * entry_impact_num_bars) FILTER (WHERE entry_ts IS NOT NULL) / sum(weight) FILTER (WHERE entry_ts IS NOT NULL), 0) AS mean_entry_impact_num_bars,
            coalesce(sum(weight * exit_impact_num_bars) FILTER (WHERE entry_ts IS NOT NULL) / sum(weight) FILTER (WHERE entry_ts IS NOT NULL), 0) AS mean_exit_impact_num_bars,
            coalesce(sum(weight * entry_usdt) FILTER (WHERE entry_ts IS NOT NULL), 0) AS executed_notional_usdt,
            bool_or(currency_pair = pumped_currency_pair) AS has_pump FROM executed GROUP BY 1, 2, 3""",
        ),
    ]


_LEG_COLUMNS = ["entry_price", "exit_price", "filled_quote", "entry_usdt", "exit_usdt", "entry_impact_bps", "exit_impact_bps"]


@plan(
    "x01_x07_executed_legs",
    with_sql(
        *_execution("100.0::DOUBLE", True),
        select=f"""SELECT pump_hash, currency_pair, {', '.join(r(c, c) for c in _LEG_COLUMNS)}, entry_impact_num_bars::BIGINT AS entry_impact_num_bars,
        exit_impact_num_bars::BIGINT AS exit_impact_num_bars, {r('exit_price / entry_price - 1 - 0.0025', 'transaction_return')} FROM executed""",
    ),
)
def executed_legs(spark, sf_dir):
    """Top-3 legs sized at 100 USDT with entry and exit models, the target's exit in its own regime."""
    chosen = portfolio.select_top_k(candidates(spark, sf_dir), _LEGS)
    reference = rates(spark, sf_dir)
    legs = portfolio.quoted_legs(chosen, market(spark, sf_dir), reference, _CONFIG)
    models = portfolio.impact_models(chosen, fx.ticks(spark, sf_dir), reference, _CONFIG)
    done = portfolio.execute(legs, _CONFIG, models)
    value = portfolio.transaction_return(F.col("exit_price"), F.col("entry_price"))
    bars_ = ["entry_impact_num_bars", "exit_impact_num_bars"]
    return rounded(done.select(GROUP, CANDIDATE, *_LEG_COLUMNS, *bars_, value.alias("transaction_return")))


_STATS_SELECT = f"""SELECT pump_hash, pump_time, {', '.join(r(c, c) for c in ['pnl', 'mean_entry_impact_bps', 'mean_exit_impact_bps',
    'mean_entry_impact_num_bars', 'mean_exit_impact_num_bars', 'executed_notional_usdt'])}, has_pump FROM stats"""


@plan("x08_a25_a26_a27_backtest", with_sql(*_execution("1.0::DOUBLE", False), select=_STATS_SELECT))
def backtest(spark, sf_dir):
    return rounded(raw_backtest(spark, sf_dir))


def raw_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.backtest(
        candidates(spark, sf_dir), fx.ticks(spark, sf_dir), market(spark, sf_dir), rates(spark, sf_dir), _RAW_CONFIG
    )


@plan("x08_backtest_with_impact", with_sql(*_execution("100.0::DOUBLE", True), select=_STATS_SELECT))
def backtest_with_impact(spark, sf_dir):
    stats = portfolio.backtest(
        candidates(spark, sf_dir), fx.ticks(spark, sf_dir), market(spark, sf_dir), rates(spark, sf_dir), _CONFIG
    )
    return rounded(stats)


@plan("a27_has_target", with_sql(TICKS, LABELS, _CANDIDATES, _TOP, select="SELECT pump_hash, bool_or(is_pumped) AS has_pump FROM portfolio GROUP BY pump_hash"))
def has_target(spark, sf_dir):
    return portfolio.has_target(portfolio.select_top_k(candidates(spark, sf_dir), _LEGS))


@plan("a28_overall_pnl", with_sql(*_execution("1.0::DOUBLE", False), select=f"SELECT {r('sum(pnl)', 'overall_pnl')} FROM stats"))
def overall_pnl(spark, sf_dir):
    return rounded(portfolio.overall_pnl(raw_backtest(spark, sf_dir)))


_SIZES = [1.0, 100.0, 10000.0]


@plan(
    "j10_a29_size_sweep",
    with_sql(
        *_execution("unnest([1.0::DOUBLE, 100.0::DOUBLE, 10000.0::DOUBLE])", True),
        select=f"""SELECT order_usdt AS quantity_usdt, count(*) AS num_pumps, {r('sum(pnl)', 'overall_pnl', 4)}, {r('sum(pnl) / order_usdt', 'cumulative_roe')},
        {r('avg(pnl)', 'mean_pnl')}, {r('median(pnl)', 'median_pnl')}, {r('avg(pnl / order_usdt)', 'mean_roe')}, {r('median(pnl / order_usdt)', 'median_roe')},
        {', '.join(r(f'avg({c})', c) for c in ['mean_entry_impact_bps', 'mean_exit_impact_bps', 'mean_entry_impact_num_bars', 'mean_exit_impact_num_bars'])},
        {r('avg(executed_notional_usdt)', 'mean_executed_notional_usdt')} FROM stats GROUP BY order_usdt""",
    ),
)
def size_sweep(spark, sf_dir):
    swept = portfolio.sweep_sizes(
        candidates(spark, sf_dir), fx.ticks(spark, sf_dir), market(spark, sf_dir), rates(spark, sf_dir), _CONFIG, _SIZES
    )
    overall = F.round(F.col("overall_pnl") + F.lit(1e-7), 4) + F.lit(0.0)
    return rounded(swept.withColumn("overall_pnl", overall), exact=("overall_pnl",))


def _sweep_sql() -> str:
    parts = []
    for before in (15, 60):
        for after in (1, 15):
            for size in (1, 3):
                source = f"(SELECT * EXCLUDE (weight) FROM portfolio WHERE rank <= {size})"
                priced = _leg_prices_cte(source, f"INTERVAL {before} MINUTE", f"INTERVAL {after} MINUTE")[1]
                parts.append(f"SELECT {size} AS portfolio_size, {before * 60}.0::DOUBLE AS buy_before_s, {after * 60}.0::DOUBLE AS sell_after_s, * FROM ({priced})")
    return with_sql(
        TICKS,
        LABELS,
        orders_cte(),
        _CANDIDATES,
        _TOP,
        _RATES,
        ("variants", " UNION ALL ".join(parts)),
        _rate_lookup("entry_rates", "variants", "entry_ts"),
        _rate_lookup("exit_rates", "variants", "exit_ts"),
        (
            "per_event",
            """SELECT portfolio_size, buy_before_s, sell_after_s, pump_hash,
            sum(CASE WHEN entry_ts IS NULL THEN 0 ELSE (exit_price / entry_price - 1 - 0.0025) * (1 / a.rate) * b.rate END) / count(*) AS pnl
            FROM variants v LEFT JOIN entry_rates a ON a.t = v.entry_ts LEFT JOIN exit_rates b ON b.t = v.exit_ts GROUP BY 1, 2, 3, 4""",
        ),
        select=f"SELECT portfolio_size, buy_before_s, sell_after_s, {r('sum(pnl)', 'overall_pnl')} FROM per_event GROUP BY 1, 2, 3",
    )


@plan("l11_timing_sweep", _sweep_sql())
def timing_sweep(spark, sf_dir):
    minutes = lambda *values: [timedelta(minutes=v) for v in values]
    swept = portfolio.sweep_parameters(
        candidates(spark, sf_dir), market(spark, sf_dir), rates(spark, sf_dir), [1, _LEGS], minutes(15, 60), minutes(1, 15)
    )
    return rounded(swept)


# --- Equity ------------------------------------------------------------------------------------------------------

_MODELS = ("click", "error", "purchase", "signup", "view")
_CURVES = (
    "curves",
    "SELECT event_type AS model, CAST(event_id AS VARCHAR) AS pump_hash, ts AS time, (value - 20) / 1000 AS portfolio_return FROM events",
)


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event returns of five models, one for each kind of events."""
    return fx.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("model"),
        F.col("event_id").cast("string").alias(GROUP),
        F.col("ts").alias("time"),
        ((F.col("value") - 20) / 1000).alias("portfolio_return"),
    )


@plan(
    "a30_portfolio_statistics",
    with_sql(
        _CURVES,
        ("daily", "SELECT model, CAST(time AS DATE) AS day, sum(portfolio_return) AS ret FROM curves GROUP BY 1, 2"),
        ("spine", "SELECT m.model, CAST(d.day AS DATE) AS day FROM (SELECT DISTINCT model FROM daily) m, (SELECT unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY)) AS day FROM daily) d"),
        ("filled", "SELECT s.model, s.day, coalesce(d.ret, 0) AS ret, s.day IN (SELECT day FROM daily) AS traded FROM spine s LEFT JOIN daily d ON s.model = d.model AND s.day = d.day"),
        select=f"""SELECT model, {r('avg(ret) FILTER (WHERE traded)', 'trading_avg_return')}, {r('avg(ret) * 365', 'annualized_return')},
        {r('stddev_samp(ret) * sqrt(365)', 'annualized_volatility')}, {r('avg(ret) * 365 / (stddev_samp(ret) * sqrt(365))', 'sharpe_ratio')} FROM filled GROUP BY model""",
    ),
)
def portfolio_statistics(spark, sf_dir):
    return rounded(portfolio.portfolio_statistics(curves(spark, sf_dir)))


@plan(
    "w10_cumulative_returns",
    with_sql(
        _CURVES,
        select=f"""SELECT model, pump_hash, time, {r('sum(portfolio_return) OVER (PARTITION BY model ORDER BY time, pump_hash ROWS UNBOUNDED PRECEDING)', 'cumulative_return')} FROM curves""",
    ),
)
def cumulative_returns(spark, sf_dir):
    running = portfolio.cumulative_returns(curves(spark, sf_dir))
    return rounded(running.select("model", GROUP, "time", "cumulative_return"))


@plan(
    "j09_aligned_curves",
    with_sql(
        _CURVES,
        select="SELECT time, "
        + ", ".join(r(f"sum(portfolio_return) FILTER (WHERE model = '{m}')", m) for m in _MODELS)
        + " FROM curves GROUP BY time",
    ),
)
def aligned_curves(spark, sf_dir):
    both = curves(spark, sf_dir)
    return rounded(portfolio.align_curves({m: both.where(F.col("model") == m) for m in _MODELS}))
