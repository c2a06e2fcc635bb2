import io
import json
import math
import zipfile
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickspark.functions import calendar as cal
from tickspark.functions import identifiers as ids
from tickspark.functions import numeric as num
from tickspark.operators import bars, orders
from tickspark.operators.running import bucketed_lag, bucketed_running_sum, dense_index, exact_percentiles
from tickspark.sources import candles as candle_source
from tickspark.sources import events as event_source
from tickspark.sources import ticks as tick_source

TICK_SCHEMA = "trade_id BIGINT, symbol STRING, trade_time TIMESTAMP_NTZ, price DOUBLE, quantity DOUBLE, is_buyer_maker BOOLEAN"


def tick_frame(spark, rows):
    return spark.createDataFrame(rows, TICK_SCHEMA)


def test_orders_slippage_and_lag(spark, at):
    t0, t1 = at("2021-01-01 08:00:00"), at("2021-01-01 09:01:00")
    ticks = tick_frame(
        spark,
        [
            (1, "A-BTC", t0, 10.0, 2.0, False),
            (2, "A-BTC", t0, 12.0, 1.0, True),
            (3, "A-BTC", t1, 20.0, 1.0, True),
            (4, "A-BTC", t1, 18.0, 3.0, True),
        ],
    )
    first, second = orders.with_previous(orders.hourly_orders(ticks)).orderBy("trade_time").collect()
    assert (first.price_first, first.price_last, first.quote_abs, first.quote_sign, first.quantity_sign) == (10, 12, 32, 8, 1)
    assert first.is_long and (first.quote_slippage_abs, first.quote_slippage_sign) == (2, 2)
    assert first.price_last_prev is None and first.num_ticks == 2
    assert (second.price_first, second.price_last, second.quote_abs, second.quote_sign, second.quantity_sign) == (20, 18, 74, -74, -4)
    assert not second.is_long and (second.quote_slippage_abs, second.quote_slippage_sign) == (6, -6)
    # The lag crosses the hour boundary.
    assert (second.price_last_prev, second.trade_time_prev) == (12, t0)


def test_impact_orders(spark, at):
    t0, t1 = at("2021-01-01 00:00:00"), at("2021-01-01 00:00:01")
    ticks = tick_frame(
        spark,
        [
            (1, "A", t0, 100.0, 1.0, False),
            (2, "A", t0, 101.0, 1.0, False),
            (3, "A", t1, 100.0, 1.0, True),
            (4, "A", t1, 99.0, 1.0, True),
        ],
    )
    buy, sell = orders.impact_orders(ticks, 2.0).orderBy("trade_time").collect()
    assert (buy.side, sell.side) == (1, -1)
    assert buy.impact_bps == pytest.approx(100) and sell.impact_bps == pytest.approx(100)
    assert buy.notional_usdt == 2 * buy.notional_quote


def test_candles_skip_empty_slots(spark, at):
    rows = [
        (1, "A", at("2021-01-01 00:00:10"), 10.0, 1.0, False),
        (2, "A", at("2021-01-01 00:04:59"), 11.0, 2.0, True),
        (3, "A", at("2021-01-01 00:20:00"), 12.0, 1.0, False),
    ]
    found = bars.trades_to_candles(tick_frame(spark, rows)).orderBy("open_time").collect()
    assert [(c.close_price, c.quote_asset_volume, c.taker_buy_quote_asset_volume) for c in found] == [(11, 32, 10), (12, 12, 12)]


def zipped(text):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr("data.csv", text)
    return buffer.getvalue()


def test_archives_to_hive_layout_and_back(spark, tmp_path):
    raw = tmp_path / "raw" / "ADA-BTC"
    raw.mkdir(parents=True)
    old = int(datetime(2024, 12, 31, 1).timestamp())
    ms = "".join(f"{i},0.5,{i},{0.5 * i},{1735606800000 + i},True,True\n" for i in range(1, 5))
    us = "".join(f"{i},0.5,{i},{0.5 * i},{1735693200000000 + i},False,True\n" for i in range(5, 8))
    (raw / "trades@2024-12-31.zip").write_bytes(zipped(ms))
    (raw / "trades@2025-01-01.zip").write_bytes(zipped(us))
    (raw / "trades@2025-02-01.zip").write_bytes(zipped(us))
    archives = tick_source.list_archives(spark, str(tmp_path / "raw"), datetime(2024, 12, 31), datetime(2025, 1, 1, 23))
    store = str(tmp_path / "hive")
    for _ in range(2):  # a re-run replaces its partitions
        tick_source.write_ticks(tick_source.ingest(archives), store)
    assert (tmp_path / "hive" / "date=2024-12-31" / "symbol=ADA-BTC").is_dir()
    stored = tick_source.scan_ticks(spark, store)
    assert stored.count() == 7
    times = {r.trade_id: r.trade_time for r in stored.collect()}
    assert times[1] == datetime(2024, 12, 31, 1, 0, 0, 1000)
    assert times[5] == datetime(2025, 1, 1, 1, 0, 0, 5)
    assert old
    assert tick_source.first_date(stored).first()[0] == date(2024, 12, 31)
    # Closed scans keep the right end, half-open ones do not.
    start, end = datetime(2024, 12, 31), datetime(2025, 1, 1, 1, 0, 0, 7)
    assert tick_source.ticks_between(stored, "ADA-BTC", start, end).count() == 7
    assert tick_source.price_series(stored, "ADA-BTC", start, end).count() == 6
    plan = tick_source.ticks_between(stored, "ADA-BTC", start, end)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan and "PushedFilters: [IsNotNull(trade_time)" in plan


def test_label_file_and_ids(spark, tmp_path):
    path = tmp_path / "labels.json"
    path.write_text(json.dumps([{"symbol": "ACM-BTC", "time": "2021-06-05 18:00:13", "exchange": "binance_spot"}], indent=2))
    row = event_source.read_labels(spark, str(path)).first()
    assert row.pump_hash == "ACM-BTC:BINANCE_SPOT:2021-06-05T18-00-13"
    decoded = event_source.read_labels(spark, str(path)).select(
        ids.event_symbol(F.col("pump_hash")), ids.event_exchange(F.col("pump_hash")), ids.event_time(F.col("pump_hash"))
    )
    assert tuple(decoded.first()) == ("ACM-BTC", "BINANCE_SPOT", datetime(2021, 6, 5, 18, 0, 13))
    assert ids.duration_slug(timedelta(milliseconds=250)) == "250MS" and ids.duration_slug(timedelta(seconds=30)) == "30S"
    with pytest.raises(ValueError):
        ids.duration_slug(timedelta(seconds=1.5))


def test_calendar(spark):
    def value(column):
        return spark.range(1).select(column).first()[0]

    def ntz(*parts):
        return F.lit(datetime(*parts)).cast("timestamp_ntz")

    pieces = value(cal.overlapping_bounds(ntz(2025, 1, 1), ntz(2025, 2, 1), timedelta(days=3), timedelta(days=3)))
    assert [p.start_inclusive.day for p in pieces[:10]] == [1, 4, 7, 10, 13, 16, 19, 22, 25, 28]
    assert all(p.end_exclusive == p.start_inclusive + timedelta(days=3) - timedelta(microseconds=1) for p in pieces[:10])
    assert value(cal.months_between(ntz(2025, 1, 1), ntz(2025, 3, 1, 23))) == ["202501", "202502", "202503"]
    assert value(cal.end_of_day(ntz(2025, 1, 1, 5))) == datetime(2025, 1, 1, 23, 59, 59, 999999)
    assert value(cal.floor_time(ntz(2025, 1, 1, 5, 7, 9), 300)) == datetime(2025, 1, 1, 5, 5)
    days = value(cal.partial_month_days(ntz(2025, 1, 30), ntz(2025, 3, 2)))
    assert days == [date(2025, 1, 30), date(2025, 1, 31), date(2025, 3, 1), date(2025, 3, 2)]


def test_numeric_conventions(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 4.0), (None, 1.0)], "a DOUBLE, b DOUBLE")
    assert [r[0] for r in rows.select(num.ratio(F.col("a"), F.col("b"))).collect()] == [float("inf"), float("-inf"), None, 0.25, None]
    clipped = spark.createDataFrame([(0.5,), (None,), (float("inf"),)], "a DOUBLE").select(num.clip(F.col("a"), 1.0, 2.0))
    assert [r[0] for r in clipped.collect()] == [1.0, None, 2.0]


def test_minute_candles(spark):
    columns = ["path", "content"]
    opened = 1704067200000
    line = "{t},1,1,1,{c},{v},0,{q},0,0,{b},0"
    text = "\n".join(
        [
            line.format(t=opened, c="1.0", v="2", q="20000", b="5"),
            line.format(t=opened + 60000, c="2.0", v="0", q="0", b="bad"),
            line.format(t=opened + 60000, c="3.0", v="0", q="0", b="1"),
            line.format(t=opened + 180000, c="x", v="1", q="5", b="1"),
        ]
    )
    archives = spark.createDataFrame([("/raw/BTC-USDT/klines@1m@2024-01-01.zip", bytearray(zipped(text)))], columns)
    parsed = candle_source.parse_candle_archives(archives)
    cleaned = {r.open_time.minute: r for r in candle_source.clean_candles(parsed).collect()}
    assert set(cleaned) == {0, 1} and cleaned[1].close_price == 3.0  # the last duplicate wins, "x" is dropped
    rates = {r.minute.minute: r.rate for r in candle_source.vwap_rates(parsed.where("close_price <> 'x'")).collect()}
    assert rates == {0: 10000.0, 1: 3.0}
    grid = candle_source.minute_grid(candle_source.clean_candles(parsed), datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 4))
    assert [r.close_price for r in grid.orderBy("open_time").collect()] == [1.0, 3.0, None, None]


def test_minute_grid_shuffles_candles_only(spark, at):
    """Against a plain join: bounds inside days, off-minute and repeated candles, a day without any; no minute is shuffled."""
    opened = ["01 23:58:00", "02 00:00:00", "02 00:00:00", "02 00:00:30", "02 00:03:00", "02 23:59:00", "04 00:01:00", "04 00:05:00"]
    rows = [(s, at(f"2024-01-{t}"), float(i)) for s in ("A", "B") for i, t in enumerate(opened) if s == "A" or i % 3]
    rows += [("C", at("2024-01-04 09:00:00"), 1.0), ("D", at("2024-01-05 00:00:00"), 1.0), ("E", at("2024-01-01 00:00:00"), 2.0)]
    candles = spark.createDataFrame(rows, "symbol STRING, open_time TIMESTAMP_NTZ, close_price DOUBLE")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for start, end in [("01 23:57:30", "04 00:04:30"), ("02 00:00:00", "03 00:00:00"), ("02 00:02:00", "02 00:03:00")]:
            start, end = at(f"2024-01-{start}"), at(f"2024-01-{end}")
            grid = candle_source.minute_grid(candles, start, end)
            first = start.replace(second=0) + timedelta(minutes=1 if start.second else 0)
            minutes = []
            while first < end:
                minutes.append(first)
                first += timedelta(minutes=1)
            want = []
            for symbol in sorted({s for s, t, _ in rows if start.date() <= t.date() <= end.date()}):
                for minute in minutes:
                    found = [v for s, t, v in rows if s == symbol and t == minute]
                    want += [(symbol, minute, v) for v in found or [None]]
            key = lambda r: (r[0], r[1], r[2] or -1.0)
            assert sorted(map(tuple, grid.collect()), key=key) == sorted(want, key=key)
            assert "hashpartitioning(symbol#" in (shown := grid._jdf.queryExecution().toString()) and "Join" not in shown
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_small_archives_are_parsed_together(spark):
    """Rows keep their archive, also with an empty file, one without a last line end and one with blank lines."""
    texts = {"A": "1,1.5,2,3,10,True,True\n2,1,2,2,11,False,True", "B": "", "C": "3,1.25,2,2.5,12,True,True\n\n4,7,1,7,13,False,True\n"}

    def zipped(text):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as archive:
            archive.writestr("t.csv", text)
        return buffer.getvalue()

    want = {("A", 1, 1.5, 10, True), ("A", 2, 1.0, 11, False), ("C", 3, 1.25, 12, True), ("C", 4, 7.0, 13, False)}
    for chosen in ("AB", "ABC", "B"):
        rows = [(f"/raw/{s}/trades@2024-01-01.zip", bytearray(zipped(texts[s]))) for s in chosen]
        files = spark.createDataFrame(rows, "path STRING, content BINARY").coalesce(1)
        got = tick_source.parse_archives(files).collect()
        assert {(r.path[5], r.trade_id, r.price, r.raw_time, r.is_buyer_maker) for r in got} == {w for w in want if w[0] in chosen}


# --- Bucketed operators against brute force ------------------------------------------------------------


def skewed(spark, n=400):
    """One key holds most rows."""
    rows = [("hot" if i % 4 else f"k{i % 7}", i, float((i * 37) % 101)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k STRING, t BIGINT, v DOUBLE").withColumn("b", F.floor(F.col("t") / 25))


def test_bucketed_lag_and_sum(spark):
    rows, df = skewed(spark)
    lagged = {(r.k, r.t): r.p for r in bucketed_lag(df, ["k"], "b", "t", {"v": "p"}).collect()}
    sums = {(r.k, r.t): r.s for r in bucketed_running_sum(df, ["k"], "b", ["t"], {"v": "s"}).collect()}
    last, total = {}, {}
    for k, t, v in rows:
        total[k] = total.get(k, 0.0) + v
        assert lagged[k, t] == last.get(k) and sums[k, t] == total[k]
        last[k] = v


def test_dense_index(spark):
    _, df = skewed(spark)
    found = dense_index(df, ["t"], F.col("b"), "i").collect()
    assert all(r.t == r.i for r in found) and len(found) == 400


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 7, 10, 11, 100, 12_345])
def test_exact_percentiles(spark, n):
    import numpy as np

    values = [float((i * 7919) % 1000) if n > 100 else float((i * 37) % 23) for i in range(n)]
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    df = spark.createDataFrame([("hot", v) for v in values] + [("hot", None)], "k STRING, v DOUBLE")
    names = [f"p{i}" for i in range(len(probs))]
    expected = [float(np.quantile(values, p)) for p in probs]
    assert list(exact_percentiles(df, ["k"], "v", probs, names).select(*names).first()) == pytest.approx(expected)
    assert list(exact_percentiles(df, [], "v", probs, names).first()) == pytest.approx(expected)


def test_bars_without_a_price_level_have_no_return(spark, at):
    rows = [("A", at("2024-01-01 01:00:00"), 0.0, 0.0), ("A", at("2024-01-02 01:00:00"), 1.0, 2.0), ("A", at("2024-01-03 01:00:00"), 1.0, 3.0)]
    made = spark.createDataFrame(rows, "symbol STRING, trade_time TIMESTAMP_NTZ, price_first DOUBLE, price_last DOUBLE")
    daily = bars.order_bars(made.withColumn("quote_abs", F.lit(1.0)), "1 day")
    returns = [r.asset_return_pips for r in daily.orderBy("bar_time").collect()]
    assert math.isnan(returns[0]) and returns[1:] == [10000.0, 20000.0]
    assert math.isnan(bars.bar_baseline(daily).collect()[0].asset_return_std)


def test_large_values_round_as_in_sql(spark):
    import duckdb

    from tickspark.plans.registry import r, rounded

    values = [546804.5609644989, 542785.4643244989, 0.0000005, -1.5, float("inf"), None]
    got = [row.v for row in rounded(spark.createDataFrame([(v,) for v in values], "v DOUBLE")).collect()]
    assert got == [duckdb.execute(f"SELECT {r('CAST($1 AS DOUBLE)', 'v')}", [v]).fetchone()[0] for v in values]


def test_active_symbols_are_made_distinct_before_they_meet_the_events(spark, at):
    import re

    ticks = spark.createDataFrame([("A-BTC", "2024-01-01"), ("B-BTC", "2024-01-02"), ("B-BTC", "2024-01-01"), ("C-BTC", "2024-01-04")], "symbol STRING, date STRING")
    marks = [("x", "2024-01-01 01:00:00"), ("y", "2024-01-01 02:00:00"), ("y", "2024-01-04 02:00:00"), ("z", "2024-01-09 00:00:00")]
    marked = spark.createDataFrame([(h, at(t)) for h, t in marks], "pump_hash STRING, pump_time TIMESTAMP_NTZ")
    active = tick_source.active_symbols(ticks.withColumn("date", F.to_date("date")), marked, F.col("pump_time"), F.col("pump_time"))
    want = [("x", "A-BTC"), ("x", "B-BTC"), ("y", "A-BTC"), ("y", "B-BTC"), ("y", "C-BTC")]
    assert sorted((r.pump_hash, r.symbol) for r in active.collect()) == want
    plan = active._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[pump_hash#\d+, symbol#\d+\]", plan)


def test_universe_sizes_are_counted_once_for_each_set_of_dates(spark, at):
    import re

    ticks = spark.createDataFrame([("A-BTC", "2024-01-01"), ("B-BTC", "2024-01-02"), ("B-BTC", "2024-01-01"), ("C-BTC", "2024-01-04")], "symbol STRING, date STRING")
    marks = [("x", "2024-01-01 01:00:00"), ("y", "2024-01-01 02:00:00"), ("y", "2024-01-04 02:00:00"), ("z", "2024-01-09 00:00:00")]
    marked = spark.createDataFrame([(h, at(t)) for h, t in marks], "pump_hash STRING, pump_time TIMESTAMP_NTZ")
    sizes = tick_source.universe_sizes(ticks.withColumn("date", F.to_date("date")), marked, F.col("pump_time"), F.col("pump_time"))
    assert sorted(map(tuple, sizes.collect())) == [("x", 2, "A-BTC", "B-BTC"), ("y", 3, "A-BTC", "C-BTC")]
    plan = sizes._jdf.queryExecution().optimizedPlan().toString()
    # Symbols are counted by dates; no row of an event and a symbol is made or sorted.
    assert re.search(r"Aggregate \[dates#\d+\], \[dates#\d+, count", plan)
    assert not re.search(r"Aggregate \[pump_hash#\d+\], \[pump_hash#\d+, count", plan)
