import pytest
from pyspark.sql import functions as F

from tickspark.operators import inference, ranking

SCHEMA = "pump_hash STRING, currency_pair STRING, is_pumped BOOLEAN, score DOUBLE"


def frame(spark, groups):
    rows = [(g, f"{g}-{i:03d}", i == positive, s) for g, (scores, positive) in groups.items() for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, SCHEMA)


def golden(spark):
    return frame(
        spark,
        {"p1": ([0.07, 0.08, 0.09, 0.1, 0.2, 0.3], 3), "p2": ([0.4, 0.5, 0.6, 0.7, 0.8, 0.9], 4)},
    )


def linear(spark, groups, size, positive):
    return frame(spark, {f"g{g:03d}": ([1 - i / (size - 1) for i in range(size)], positive(g)) for g in range(groups)})


def values(df, key):
    return {r[key]: r["value"] for r in df.collect()}


def test_top_k(spark):
    assert values(ranking.top_k(golden(spark), [1, 2, 5]), "k") == {1: 0.0, 2: 0.5, 5: 1.0}
    assert values(ranking.top_k_percent(golden(spark), [0.0, 0.1, 0.2, 0.5]), "share") == {0.0: 0.0, 0.1: 0.0, 0.2: 0.5, 0.5: 1.0}


def test_classification(spark):
    top = ranking.classification_table(golden(spark)).first()
    assert top.f1 == 0 and top.balanced_accuracy == pytest.approx(0.4)
    cut = ranking.classification_table(golden(spark), "threshold", 0.5).first()
    assert cut.f1 == pytest.approx(2 / 7) and cut.balanced_accuracy == pytest.approx(0.55)
    with pytest.raises(ValueError):
        ranking.predicted_labels(golden(spark), "other")


def test_perfect_ranking(spark):
    perfect = frame(spark, {"a": ([0.9, 0.8, 0.7], 0), "b": ([0.95, 0.4, 0.3], 0)})
    assert ranking.pr_auc(perfect).first().pr_auc == pytest.approx(1)
    row = ranking.classification_table(perfect).first()
    assert row.f1 == 1 and row.balanced_accuracy == 1


def test_auc_matches_the_curve(spark):
    scored = linear(spark, 7, 40, lambda g: g * 5)
    bins = ranking.auc_bins()
    curve = values(ranking.top_k_percent(scored, bins), "share")
    y = [curve[b] for b in bins]
    area = sum((y[i] + y[i + 1]) / 2 * (bins[i + 1] - bins[i]) for i in range(40)) / 0.2
    assert len(bins) == 41
    assert ranking.top_k_percent_auc(scored).first().topk_percent_auc == pytest.approx(area)
    no_positive = scored.withColumn("is_pumped", F.lit(False))
    assert ranking.top_k_percent_auc(no_positive).first().topk_percent_auc == 0


def test_null_and_tied_scores_rank_last_and_by_id(spark):
    rows = [("g", "b", True, 0.5), ("g", "a", False, 0.5), ("g", "c", False, None), ("h", "x", True, None), ("h", "y", False, 0.1)]
    ranks = {r.pump_hash: r.best_rank for r in ranking.group_ranks(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert ranks == {"g": 2, "h": 2}


def test_bootstrap_intervals(spark):
    mixed = linear(spark, 40, 10, lambda g: 0 if g % 2 else 9)
    ci = inference.bootstrap_auc(mixed, replicates=200).first()
    assert ci.ci_lower <= ci.point_estimate <= ci.ci_upper and ci.std_bootstrap > 0
    first = linear(spark, 25, 8, lambda g: 0)
    rows = inference.bootstrap_top_k(first, [1, 2, 5], replicates=50).collect()
    assert len(rows) == 3 and all(r.point_estimate == 1 and r.ci_lower == 1 for r in rows)


def test_paired_test_separates_models(spark):
    good, bad = linear(spark, 50, 12, lambda g: 0), linear(spark, 50, 12, lambda g: 11)
    row = inference.paired_auc_test(good, bad, replicates=200, alternative="greater").first()
    assert row.observed_diff > 0 and row.ci_lower > 0 and row.p_value < 0.01
    with pytest.raises(ValueError, match="1 in B"):
        inference.paired_auc_test(good, bad.where("pump_hash <> 'g000'"), replicates=5)


@pytest.mark.parametrize("alpha,replicates,alternative", [(0, 5, "less"), (0.05, 0, "less"), (0.05, 5, "both")])
def test_bootstrap_arguments(alpha, replicates, alternative):
    with pytest.raises(ValueError):
        inference.validate_bootstrap(alpha, replicates, alternative)
    with pytest.raises(ValueError):
        inference.validate_bins([], 1)


def test_subperiods_need_enough_events(spark):
    scored = linear(spark, 15, 6, lambda g: 0).withColumn(
        "pump_time", F.when(F.col("pump_hash") < "g012", F.lit("2024-01-01")).otherwise(F.lit("2024-02-01")).cast("timestamp_ntz")
    )
    rows = inference.subperiod_metrics(scored, "2024-01-15", min_events=10).collect()
    assert [(r.subperiod, r.n_pumps, r.n_rows) for r in rows] == [("early", 12, 72)]
    assert rows[0]["topk_percent@0.2"] == 1


def test_empty_table_has_no_classes(spark):
    empty = spark.createDataFrame([], SCHEMA)
    row = ranking.classification_table(empty).first()
    assert row.f1 == 0 and row.balanced_accuracy is None


def test_grid_is_steps(spark):
    bins = ranking.auc_bins()
    assert len(bins) == 41 and bins[0] == 0 and bins[-1] == 40 * 0.005
