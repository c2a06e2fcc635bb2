import math
import re
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tickspark.names import INTERVALS, regressor_columns
from tickspark.operators import panel as pn
from tickspark.operators.features import (
    FeatureWindows,
    event_features,
    features_from_orders,
    moments,
    prior_event_count,
    roll_up,
    segment_partials,
    slice_pieces,
)
from tickspark.operators.orders import hourly_orders

ORDERS = [
    # time, first, last, prev, quote_abs, quote_sign, slippage_abs, slippage_sign, long
    ("07:10:00", 100, 101, 99, 10, 5, 1, 1, True),
    ("07:40:00", 101, 102, 100, 20, -5, 2, -2, False),
    ("07:59:00", 200, 102, 1, 1000, 1000, 100, 100, True),
    ("08:00:00", 102, 103, 102, 30, 10, 3, 3, True),
    ("08:30:00", 103, 108, 103, 50, 20, 5, 2, True),
    ("10:00:10", 110, 115, 108, 60, 30, 6, 3, True),
    ("10:00:40", 115, 120, 114, 70, 35, 7, 4, True),
]


def order_frame(spark, at):
    rows = [
        ("AAA-BTC", at(f"2021-01-01 {t}"), float(f), float(last), float(qa), float(qs), float(sa), float(ss), lg)
        for t, f, last, _, qa, qs, sa, ss, lg in ORDERS
    ]
    schema = (
        "symbol STRING, trade_time TIMESTAMP_NTZ, price_first DOUBLE, price_last DOUBLE, quote_abs DOUBLE,"
        "quote_sign DOUBLE, quote_slippage_abs DOUBLE, quote_slippage_sign DOUBLE, is_long BOOLEAN"
    )
    return spark.createDataFrame(rows, schema).withColumn("hour", F.window("trade_time", "1 hour").getField("start"))


def event_frame(spark, at):
    rows = [("E", "AAA-BTC", at("2021-01-01 10:00:00"))]
    return spark.createDataFrame(rows, "pump_hash STRING, pumped_currency_pair STRING, pump_time TIMESTAMP_NTZ")


def test_one_hour_window(spark, at):
    labels = spark.createDataFrame(
        [
            ("1", "AAA-BTC", at("2020-01-01 00:00:00")),
            ("2", "AAA-BTC", at("2020-06-01 00:00:00")),
            ("3", "AAA-BTC", at("2021-02-01 00:00:00")),
            ("4", "BBB-BTC", at("2020-03-01 00:00:00")),
            ("E", "AAA-BTC", at("2021-01-01 10:00:00")),
        ],
        "pump_hash STRING, pumped_currency_pair STRING, pump_time TIMESTAMP_NTZ",
    )
    windows = FeatureWindows(offsets={"1H": timedelta(hours=1)}, decays={"1MIN": timedelta(minutes=1)})
    row = features_from_orders(order_frame(spark, at), event_frame(spark, at), windows, labels).first()
    # Hourly bars: 07, 08 and the one of the event itself.
    returns = [(102 / 100 - 1) * 1e4, (108 / 102 - 1) * 1e4, (120 / 110 - 1) * 1e4]
    quotes = [1030.0, 80.0, 130.0]

    def std(values):
        mean = sum(values) / len(values)
        return math.sqrt(sum((v - mean) ** 2 for v in values) / (len(values) - 1))

    assert row["asset_return@1H"] == pytest.approx((108 / 102 - 1) * 1e4)
    assert row["share_of_long_trades@1H"] == 1
    assert row["powerlaw_alpha@1H"] == pytest.approx(1 + 2 / math.log(50 / 30))
    assert row["slippage_imbalance@1H"] == pytest.approx(5 / 8)
    assert row["flow_imbalance@1H"] == pytest.approx(30 / 80)
    assert row["num_trades@1H"] == 2
    assert row["asset_return_zscore@1H"] == pytest.approx(returns[1] / std(returns))
    assert row["quote_abs_zscore@1H"] == pytest.approx((80 - sum(quotes) / 3) / std(quotes))
    assert row["num_prev_pump"] == 2
    assert row["target_return@1MIN"] == pytest.approx((120 / 108 - 1) * 1e4)


def test_reference_schema_and_empty_windows(spark, at):
    # Two symbols; the second traded on the first date of the slice, but before the slice opens.
    ticks = spark.createDataFrame(
        [
            (1, "AAA-BTC", at("2021-01-01 08:00:00"), 10.0, 2.0, False),
            (2, "BBB-BTC", at("2020-12-02 00:10:00"), 5.0, 1.0, True),
            (3, "CCC-USDT", at("2021-01-01 08:00:00"), 5.0, 1.0, True),
        ],
        "trade_id BIGINT, symbol STRING, trade_time TIMESTAMP_NTZ, price DOUBLE, quantity DOUBLE, is_buyer_maker BOOLEAN",
    )
    found = event_features(ticks, event_frame(spark, at))
    assert len(found.columns) == 87 + 2  # 80 look-backs, 5 decays, prior events and symbol; event id and time
    rows = {r.currency_pair: r for r in found.collect()}
    assert set(rows) == {"AAA-BTC", "BBB-BTC"}  # other quote assets are not in the cross-section
    empty = rows["BBB-BTC"]
    assert empty["num_trades@14D"] == 0 and empty["asset_return@14D"] is None and empty["flow_imbalance@14D"] is None
    assert rows["AAA-BTC"]["powerlaw_alpha@1D"] == float("inf")


def test_feature_plan_has_no_nested_loop(spark, at):
    ticks = spark.createDataFrame(
        [(1, "AAA-BTC", at("2021-01-01 08:00:00"), 10.0, 2.0, False)],
        "trade_id BIGINT, symbol STRING, trade_time TIMESTAMP_NTZ, price DOUBLE, quantity DOUBLE, is_buyer_maker BOOLEAN",
    )
    plan = event_features(ticks, event_frame(spark, at))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_regressor_names():
    names = regressor_columns()
    assert len(names) == 81 and names[0] == "asset_return@5MIN" and names[-1] == "num_prev_pump"
    assert INTERVALS["14D"] == timedelta(days=14)


# --- Panel -----------------------------------------------------------------------------------------------


def test_standardise_guards_constant_groups(spark):
    rows = [("g0", 5.0), ("g0", 5.0), ("g1", 1.0), ("g1", 3.0)]
    df = spark.createDataFrame(rows, "pump_hash STRING, x DOUBLE")
    guarded = sorted((r.pump_hash, r.x) for r in pn.standardise(df, ["x"]).collect())
    assert guarded[:2] == [("g0", 5.0), ("g0", 5.0)]
    assert [v for _, v in guarded[2:]] == pytest.approx([-math.sqrt(0.5), math.sqrt(0.5)])
    plain = [r.x for r in pn.standardise(df, ["x"], guard=False).where("pump_hash = 'g0'").collect()]
    assert plain == [None, None]


def test_medians_percentile_rank_and_failed_events(spark):
    rows = [("g", "a", True, 1.0, None), ("g", "b", False, None, 2.0), ("g", "c", False, 3.0, 2.0), ("g", "d", False, 9.0, 5.0)]
    df = spark.createDataFrame(rows, "pump_hash STRING, currency_pair STRING, is_pumped BOOLEAN, x DOUBLE, r DOUBLE")
    filled = {r.currency_pair: r.x for r in pn.fill_with_medians(df, ["x"]).collect()}
    assert filled["b"] == 3.0
    ranks = {r.currency_pair: r.rank for r in pn.percentile_rank(df, "r", "rank").collect()}
    assert ranks == {"d": 0.25, "b": 0.625, "c": 0.625, "a": 1.0}  # ties average, the filled 0 is last
    assert pn.positive_dense_rank(df, "x").first().positive_rank == 3
    assert pn.remove_failed_events(df, "x", worst_rank=3).count() == 0
    assert pn.remove_failed_events(df, "r", worst_rank=1).count() == 4  # unranked positives stay
    with pytest.raises(ValueError):
        pn.require_single_positive(df.withColumn("is_pumped", F.lit(True)))
    with pytest.raises(ValueError):
        pn.check_columns(df, ["absent"])


def test_group_values_meet_the_panel_where_it_lies(spark, tmp_path):
    """Statistics, kept groups and value counts are stored: the panel's rows are shuffled for none of them but the rank."""
    from tickspark.operators.running import range_bucket

    rows = [(f"g{i % 3}", f"s{i}", i % 7 == 0 and i < 20, float(i % 5), float(i)) for i in range(60)]
    spark.createDataFrame(rows, "pump_hash STRING, currency_pair STRING, is_pumped BOOLEAN, v DOUBLE, x DOUBLE").write.parquet(f"{tmp_path}/panel")
    panel = spark.read.parquet(f"{tmp_path}/panel")
    for out in (pn.standardise(panel, ["x"]), pn.remove_failed_events(panel, "v", 40)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    ranked = pn.percentile_rank(panel, "v", "rank")
    assert ranked._jdf.queryExecution().optimizedPlan().toString().count("currency_pair#") and len(
        re.findall(r"Relation \[pump_hash#\d+,currency_pair#", ranked._jdf.queryExecution().optimizedPlan().toString())
    ) == 1
    bounded = spark.createDataFrame([(v,) for v in [*map(float, range(100)), 7.0, 7.0, None, math.nan]], "v DOUBLE")
    found = {str(r.v): r["_bucket"] for r in range_bucket(bounded, "v", buckets=8).collect()}
    bounds = bounded.agg(F.percentile_approx("v", [i / 8 for i in range(1, 8)], F.lit(80))).first()[0]
    assert found["None"] == 0 and found["nan"] == 7
    assert all(found[str(float(v))] == sum(b < v for b in bounds) for v in range(100))


def test_group_sample_keeps_whole_groups(spark):
    rows = [(f"g{g}", g * 3 + i) for g in range(6) for i in range(3)]
    df = spark.createDataFrame(rows, "pump_hash STRING, v BIGINT")
    first = sorted(r.v for r in pn.sample_groups(df, 0.5, 42).collect())
    assert first == sorted(r.v for r in pn.sample_groups(df, 0.5, 42).collect())
    sizes = [r["count"] for r in pn.sample_groups(df, 0.5, 42).groupBy("pump_hash").count().collect()]
    assert sizes == [3, 3, 3]
    with pytest.raises(ValueError):
        pn.sample_groups(df, 0.0, 1)


def test_deviation_of_large_levels(spark, at):
    """Hourly volumes around 1e9 that differ by units: segments must not cancel."""
    rows = [
        ("AAA-BTC", at(f"2021-01-01 {h:02d}:30:00"), 1.0, 1.0, 1e9 + h % 3, 1.0, 1.0, 1.0, True) for h in range(2, 22)
    ]
    schema = order_frame(spark, at).drop("hour").schema
    orders = spark.createDataFrame(rows, schema).withColumn("hour", F.window("trade_time", "1 hour").getField("start"))
    event = spark.createDataFrame(
        [("E", "AAA-BTC", at("2021-01-01 23:00:00"))], "pump_hash STRING, pumped_currency_pair STRING, pump_time TIMESTAMP_NTZ"
    )
    windows = FeatureWindows(
        offsets={s: INTERVALS[s] for s in ("1H", "2H", "4H", "12H")}, decays={}, lookback=timedelta(hours=22)
    )
    row = features_from_orders(orders, event, windows).first()
    values = [1e9 + h % 3 for h in range(2, 22)]
    mean = sum(values) / len(values)
    std = math.sqrt(sum((v - mean) ** 2 for v in values) / (len(values) - 1))
    inside = [1e9 + h % 3 for h in (20, 21)]
    assert row["quote_abs_zscore@2H"] == pytest.approx((sum(inside) / 2 - mean) / std, rel=1e-6)


def test_preprocessing_refuses_two_positives(spark):
    columns = [*regressor_columns(["1D"]), "target_return@1MIN"]
    rows = [("g", "a", True, *[1.0] * len(columns)), ("g", "b", True, *[2.0] * len(columns))]
    schema = "pump_hash STRING, currency_pair STRING, is_pumped BOOLEAN, " + ", ".join(f"`{c}` DOUBLE" for c in columns)
    panel = spark.createDataFrame(rows, schema).withColumn("pump_time", F.lit("2021-01-01").cast("timestamp_ntz"))
    with pytest.raises(ValueError, match="several positives"):
        pn.preprocess(panel, ["1D"])


def test_median_fill_reads_only_what_is_missing(spark):
    rows = [("a", 1.0, None), ("a", None, None), ("a", 5.0, None), ("b", 7.0, 4.0), ("b", 9.0, 8.0)]
    panel = spark.createDataFrame(rows, "pump_hash STRING, x DOUBLE, y DOUBLE")
    filled = pn.fill_with_medians(panel, ["x", "y"])
    assert sorted(map(tuple, filled.select("pump_hash", "x", "y").collect())) == [
        ("a", 1.0, 6.0), ("a", 3.0, 6.0), ("a", 5.0, 6.0), ("b", 7.0, 4.0), ("b", 9.0, 8.0)
    ]


def test_feature_pieces_are_summed_where_they_are_made(spark, at):
    """What the join makes is not shuffled again: only fills, hours and the few edge-hour sums are."""
    ticks = spark.createDataFrame(
        [(1, "AAA-BTC", at("2021-01-01 08:00:00"), 10.0, 2.0, False)],
        "trade_id BIGINT, symbol STRING, trade_time TIMESTAMP_NTZ, price DOUBLE, quantity DOUBLE, is_buyer_maker BOOLEAN",
    )
    events = event_frame(spark, at)
    windows = FeatureWindows(offsets={"1H": timedelta(hours=1)}, decays={})
    rows = roll_up(segment_partials(slice_pieces(hourly_orders(ticks), events, windows), windows), windows)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Union")]
    assert "HashAggregate" in above and "Exchange" not in above


def test_hours_are_not_shuffled_by_symbol_alone(spark, at):
    """The hour before is looked up where the hours meet the events, and no symbol's whole history lies in one task."""
    ticks = spark.createDataFrame(
        [(1, "AAA-BTC", at("2021-01-01 08:00:00"), 10.0, 2.0, False)],
        "trade_id BIGINT, symbol STRING, trade_time TIMESTAMP_NTZ, price DOUBLE, quantity DOUBLE, is_buyer_maker BOOLEAN",
    )
    pieces = slice_pieces(hourly_orders(ticks), event_frame(spark, at), FeatureWindows())
    plan = pieces._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"hashpartitioning\(symbol#\d+, \d+\)", plan)


def test_events_are_not_gathered_once_for_each_share_or_bound(spark, at):
    """Exploded events meet the hours by shuffle, and edge hours as ids alone: neither is a broadcast that grows with both."""
    ticks = spark.createDataFrame(
        [(1, "AAA-BTC", at("2021-01-01 08:00:00"), 10.0, 2.0, False)],
        "trade_id BIGINT, symbol STRING, trade_time TIMESTAMP_NTZ, price DOUBLE, quantity DOUBLE, is_buyer_maker BOOLEAN",
    )
    pieces = slice_pieces(hourly_orders(ticks), event_frame(spark, at), FeatureWindows())
    plan = pieces._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[period#\d+, share#\d+\]", plan)
    assert not re.findall(r"BroadcastHashJoin \[period#|BroadcastHashJoin \[hour#\d+, _salt", plan)
    # The sums of edge hours are shuffled to their period and share only.
    assert not re.findall(r"Exchange hashpartitioning\(period#\d+, share#\d+, pump_hash", plan)


def test_return_without_a_level_is_nan(spark, at):
    """0/0 is NaN in returns and in the spread of bars, as in their SQL."""
    price = {"07:10:00": 0.0, "08:10:00": 0.0, "08:20:00": 0.0, "08:30:00": 0.0}
    ticks = spark.createDataFrame(
        [(i, "AAA-BTC", at(f"2021-01-01 {t}"), p, 1.0, False) for i, (t, p) in enumerate(price.items())],
        "trade_id BIGINT, symbol STRING, trade_time TIMESTAMP_NTZ, price DOUBLE, quantity DOUBLE, is_buyer_maker BOOLEAN",
    )
    windows = FeatureWindows(offsets={"1H": timedelta(hours=1)}, decays={})
    row = event_features(ticks, event_frame(spark, at), windows).first()
    assert math.isnan(row["asset_return@1H"]) and math.isnan(row["asset_return_zscore@1H"])


def test_prior_events_of_one_time_and_none(spark, at):
    labels = spark.createDataFrame(
        [("1", "A", at("2021-01-01 00:00:00")), ("2", "A", at("2021-01-01 00:00:00")), ("3", "A", at("2021-01-03 00:00:00"))],
        "pump_hash STRING, pumped_currency_pair STRING, pump_time TIMESTAMP_NTZ",
    )
    times = ["2021-01-01", "2021-01-02", "2021-01-03", "2021-01-04"]
    asked = spark.createDataFrame(
        [(s, at(f"{t} 00:00:00")) for s in "AB" for t in times], "currency_pair STRING, pump_time TIMESTAMP_NTZ"
    )
    counted = prior_event_count(asked, labels)
    got = {(r.currency_pair, r.pump_time.day): r.num_prev_pump for r in counted.collect()}
    assert [got["A", d] for d in (1, 2, 3, 4)] == [0, 2, 2, 3] and not any(got["B", d] for d in (1, 2, 3, 4))
    # The candidates are read once and sorted into no window.
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("currency_pair#") and "Union" not in plan


def test_events_of_one_time_share_their_features(spark, at):
    """Each event has the rows it has alone, its own prior events included; a shared time is computed once."""
    ticks = spark.createDataFrame(
        [
            (i, f"{s}-BTC", at(f"2021-01-01 {6 + i % 4:02d}:{(i * 7) % 60:02d}:00"), 10.0 + i % 5, 1.0 + i % 3, i % 2 == 0)
            for i, s in enumerate("ABCABCABDABCABCABD")
        ],
        "trade_id BIGINT, symbol STRING, trade_time TIMESTAMP_NTZ, price DOUBLE, quantity DOUBLE, is_buyer_maker BOOLEAN",
    )
    rows = [("E1", "A-BTC", at("2021-01-01 10:00:00")), ("E2", "B-BTC", at("2021-01-01 10:00:00")), ("E3", "A-BTC", at("2021-01-01 11:30:00"))]
    schema = "pump_hash STRING, pumped_currency_pair STRING, pump_time TIMESTAMP_NTZ"
    events = spark.createDataFrame([*rows, ("E4", "A-BTC", None)], schema)
    windows = FeatureWindows(offsets={"1H": timedelta(hours=1), "2H": timedelta(hours=2)}, decays={"1H": timedelta(hours=1)})
    assert moments(events).count() == 2
    found = event_features(ticks, events, windows)
    alone = [event_features(ticks, spark.createDataFrame([row], schema), windows, labels=events) for row in rows]
    want = sorted((r for one in alone for r in one.collect()), key=str)
    assert len(want) == 12 and sorted(found.collect(), key=str) == want
