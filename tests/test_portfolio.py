import math
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tickspark.operators import asof, impact, orders, oversample, portfolio
from tickspark.operators.models import best_round
from tickspark.operators.running import dense_index

TICKS = "trade_id BIGINT, symbol STRING, trade_time TIMESTAMP_NTZ, price DOUBLE, quantity DOUBLE, is_buyer_maker BOOLEAN"


def test_fit_is_monotone_and_unit_free(spark):
    rows = [("A", 100 + i * 125.0, 2 + 0.2 * math.sqrt(100 + i * 125.0)) for i in range(80)]
    samples = spark.createDataFrame(rows, "symbol STRING, notional_usdt DOUBLE, impact_bps DOUBLE")
    model = impact.fit(samples).first()
    assert model.beta > 0 and model.num_samples == 80
    size = spark.createDataFrame([(model.beta, 1.0), (model.beta, 100.0), (model.beta, 0.0)], "b DOUBLE, q DOUBLE")
    one = F.lit(1.0)
    terminal = [r[0] for r in size.select(impact.terminal_impact_bps(F.col("b"), F.col("q"), one)).collect()]
    vwap = [r[0] for r in size.select(impact.vwap_impact_bps(F.col("b"), F.col("q"), one)).collect()]
    assert terminal[0] < terminal[1] and terminal[2] == 0
    assert vwap == pytest.approx([2 / 3 * t for t in terminal])
    falling = samples.withColumn("impact_bps", -F.col("impact_bps"))
    assert impact.fit(falling).first().beta == 0


def day_setup(spark, at):
    ticks = spark.createDataFrame(
        [
            (1, "AAA-BTC", at("2021-01-02 11:40:00"), 100.0, 1.0, False),
            (2, "AAA-BTC", at("2021-01-02 12:00:30"), 105.0, 1.0, False),
            (3, "AAA-BTC", at("2021-01-02 12:01:00"), 110.0, 1.0, False),
        ],
        TICKS,
    )
    legs = spark.createDataFrame(
        [("E", "AAA-BTC", at("2021-01-02 12:00:00"), "AAA-BTC", 0.9, 1.0)],
        "pump_hash STRING, pumped_currency_pair STRING, pump_time TIMESTAMP_NTZ, currency_pair STRING, score DOUBLE, weight DOUBLE",
    )
    rates = spark.createDataFrame(
        [("BTC-USDT", at("2021-01-02 00:00:00"), 20_000.0), ("BTC-USDT", at("2021-01-02 12:01:00"), 40_000.0)],
        "symbol STRING, minute TIMESTAMP_NTZ, rate DOUBLE",
    )
    return ticks, legs, rates


def test_leg_prices_and_impact(spark, at):
    ticks, legs, rates = day_setup(spark, at)
    config = portfolio.ExecutionConfig(1, use_price_impact=True, order_notional_quote=100.0)
    priced = portfolio.quoted_legs(legs, orders.aggregate_orders(ticks), rates, config)
    beta = 10 / math.sqrt(100 * 20_000)
    models = spark.createDataFrame(
        [("E", "AAA-BTC", beta, 20_000.0, 7, beta, 20_000.0, 9)],
        "pump_hash STRING, currency_pair STRING, entry_beta DOUBLE, entry_quote_to_usdt DOUBLE, entry_num_samples BIGINT,"
        "exit_beta DOUBLE, exit_quote_to_usdt DOUBLE, exit_num_samples BIGINT",
    )
    leg = portfolio.execute(priced, config, models).first()
    assert leg.entry_price == pytest.approx(100 * (1 + 10 * 2 / 3 / 1e4))
    assert leg.exit_price == pytest.approx(110 * (1 - 10 * 2 / 3 / 1e4))  # the target sells a minute later
    assert (leg.entry_usdt, leg.exit_usdt) == (2_000_000, 4_000_000)
    assert (leg.entry_impact_num_bars, leg.exit_impact_num_bars) == (7, 9)
    with pytest.raises(ValueError):
        portfolio.execute(priced, config)


def test_pnl_uses_the_exit_rate_and_empty_legs_are_skipped(spark, at):
    ticks, legs, rates = day_setup(spark, at)
    market = orders.aggregate_orders(ticks)
    config = portfolio.ExecutionConfig(1, order_notional_quote=2.0)
    stats = portfolio.portfolio_stats(portfolio.execute(portfolio.quoted_legs(legs, market, rates, config), config)).first()
    assert stats.pnl == pytest.approx((110 / 100 - 1 - 0.0025) * 2 * 40_000)
    assert stats.has_pump and stats.executed_notional_usdt == 40_000
    late = portfolio.ExecutionConfig(1, order_notional_quote=2.0, buy_before=timedelta(hours=2))
    empty = portfolio.portfolio_stats(portfolio.execute(portfolio.quoted_legs(legs, market, rates, late), late)).first()
    assert empty.pnl == 0 and empty.mean_entry_impact_bps == 0 and empty.executed_notional_usdt == 0


def test_size_sweep(spark, at):
    rows = [("E", at("2021-01-02 12:00:00"), q, pnl, q) for q, pnl in ((100.0, 10.0), (1000.0, 50.0))]
    stats = spark.createDataFrame(
        rows, "pump_hash STRING, pump_time TIMESTAMP_NTZ, order_usdt DOUBLE, pnl DOUBLE, executed_notional_usdt DOUBLE"
    )
    names = ["mean_entry_impact_bps", "mean_exit_impact_bps", "mean_entry_impact_num_bars", "mean_exit_impact_num_bars"]
    summary = portfolio.summarise_sizes(stats.withColumns({n: F.lit(1.0) for n in names})).orderBy("quantity_usdt").collect()
    assert [r.mean_executed_notional_usdt for r in summary] == [100, 1000]
    assert summary[0].mean_roe > summary[1].mean_roe and summary[0].median_pnl == 10


def test_rates_direct_inverse_and_missing(spark, at):
    schema = "symbol STRING, minute TIMESTAMP_NTZ, rate DOUBLE"
    direct = [("BTC-USDT", at("2021-01-02 12:00:00"), 10_000.0), ("BTC-USDT", at("2021-01-02 12:01:00"), 10_500.0)]
    inverse = [("USDT-EUR", at("2021-01-02 12:00:00"), 1 / 20_000)]
    rates = spark.createDataFrame(direct + inverse, schema)
    times = ["2021-01-02 12:01:30", "2021-01-02 12:02:30", "2021-01-02 11:00:00", "2021-01-03 00:00:00"]
    rows = [(a, at(t)) for a in ("BTC", "EUR", "USDT", "XYZ") for t in times]
    points = spark.createDataFrame(rows, "asset STRING, t TIMESTAMP_NTZ")
    found = {(r.asset, r.t): r.quote_to_usdt for r in asof.quote_to_usdt(points, rates, F.col("asset"), "t").collect()}
    assert [found["BTC", at(t)] for t in times] == [10_500, 10_500, 10_000, None]  # same day only
    assert found["EUR", at(times[0])] == pytest.approx(20_000)
    assert found["USDT", at(times[3])] == 1 and found["XYZ", at(times[0])] is None
    with pytest.raises(Exception, match="no indicative price for XYZ"):
        asof.quote_to_usdt(points.where("asset = 'XYZ'"), rates, F.col("asset"), "t", strict=True).collect()


def test_selection_weights_and_arguments(spark, at):
    rows = [("g", "a", 0.1), ("g", "b", 0.9), ("g", "c", 0.9), ("h", "x", 0.5)]
    scored = spark.createDataFrame(rows, "pump_hash STRING, currency_pair STRING, score DOUBLE")
    chosen = {(r.pump_hash, r.currency_pair): r.weight for r in portfolio.select_top_k(scored, 2).collect()}
    assert chosen == {("g", "b"): 0.5, ("g", "c"): 0.5, ("h", "x"): 1.0}
    with pytest.raises(ValueError):
        portfolio.ExecutionConfig(0)
    with pytest.raises(ValueError):
        portfolio.ExecutionConfig(1, impact_lookback_days=0)


def test_neighbours_match_brute_force(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(60, 4))
    points = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "_i BIGINT, _x ARRAY<DOUBLE>")
    found = {}
    for r in oversample.nearest_neighbours(points, 5, block_rows=16).collect():
        found.setdefault(r._i, {})[r.rank] = r._j
    for i in range(60):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        assert [found[i][k] for k in range(1, 6)] == list(np.argsort(d)[:5])


def test_neighbours_of_many_blocks_on_many_partitions(spark):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(60, 4))
    x[30:40] = x[:10]  # exact copies: a tie goes to the smaller index
    points = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "_i BIGINT, _x ARRAY<DOUBLE>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = oversample.nearest_neighbours(points, 3, block_rows=8).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = {(r._i, r.rank): r._j for r in rows}
    for i in range(60):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        assert [found.get((i, k)) for k in (1, 2, 3)] == list(np.argsort(d, kind="stable")[:3])


def test_best_round_patience():
    assert best_round([(1, 0.1), (2, 0.3), (3, 0.2), (4, 0.9)], patience=10) == 4
    assert best_round([(1, 0.1), (2, 0.3), (3, 0.2), (4, 0.2), (5, 0.9)], patience=2) == 2


def test_index_is_dense_after_hash_order(spark):
    from tickspark.operators.running import hash_order

    df = spark.range(100).withColumn("pump_hash", F.col("id").cast("string"))
    digest, bucket = hash_order("pump_hash", 3)
    assert sorted(r.i for r in dense_index(df, [digest], bucket, "i").collect()) == list(range(100))


def test_unscored_rows_are_picked_last(spark):
    rows = [("g", "a", float("nan")), ("g", "b", 0.1), ("g", "c", None), ("g", "d", 0.9)]
    scored = spark.createDataFrame(rows, "pump_hash STRING, currency_pair STRING, score DOUBLE")
    ranked = portfolio.select_top_k(scored, 3).orderBy("rank").collect()
    assert [r.currency_pair for r in ranked] == ["d", "b", "a"]


def test_backtest_stops_without_a_rate(spark, at):
    ticks, legs, rates = day_setup(spark, at)
    config = portfolio.ExecutionConfig(portfolio_size=1)
    market = orders.aggregate_orders(ticks)
    with pytest.raises(Exception, match="no indicative price for BTC"):
        portfolio.backtest(legs.drop("weight"), ticks, market, rates.where("rate < 0"), config).collect()


def test_events_of_a_cross_section_share_its_best_candidates(spark, at):
    """Portfolios over the shared best equal those over every (event, symbol), and few rows are made."""
    events = spark.createDataFrame(
        [(f"E{i}", "S1", at("2021-01-02 12:00:00"), i % 2) for i in range(20)],
        "pump_hash STRING, pumped_currency_pair STRING, pump_time TIMESTAMP_NTZ, d INT",
    )
    scores = [0.5, 0.5, None, float("nan"), 0.5, 0.1, 0.9, None]
    scored = spark.createDataFrame([(f"S{i}", d, s) for d in (0, 1, 2) for i, s in enumerate(scores[d:])], "currency_pair STRING, d INT, score DOUBLE")
    columns = ["pump_hash", "currency_pair", "rank", "weight"]
    for k in (1, 3, 7):
        shared = portfolio.shared_candidates(events, scored, ["d"], k)
        assert shared.count() == 20 * k
        got = portfolio.select_top_k(shared, k).select(columns).collect()
        assert sorted(got) == sorted(portfolio.select_top_k(events.join(scored, "d"), k).select(columns).collect())
