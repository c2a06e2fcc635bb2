"""Grouped bootstrap, paired tests and robustness summaries.

Groups are the resampling unit. A replicate is n draws with replacement from the n groups, so the
draw table has replicates x n rows of two small integers; it is generated where the groups are,
joined to one small row per group on an evenly spread index, and reduced per replicate. Draws come
from a seeded hash, which makes them repeatable on any cluster and in any SQL engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.names import EVENT_TIME, GROUP, quoted
from tickspark.operators.ranking import (
    auc_bins,
    group_ranks,
    hit_at_k,
    hit_at_share,
    share_auc,
    top_k_percent,
    top_k_percent_auc,
)
from tickspark.operators.running import dense_index, exact_percentiles, hash_order

ALTERNATIVES = ("two-sided", "greater", "less")


def validate_bootstrap(alpha: float, replicates: int, alternative: str = "two-sided") -> None:
    """A confidence level of 1 - alpha needs an alpha between 0 and 1 and something to resample."""
    faults = []
    if alpha <= 0 or alpha >= 1:
        faults.append(f"alpha={alpha} leaves no interval")
    if replicates <= 0:
        faults.append(f"replicates={replicates} resamples nothing")
    if alternative not in ALTERNATIVES:
        faults.append(f"alternative={alternative!r} is none of {', '.join(ALTERNATIVES)}")
    if faults:
        raise ValueError("; ".join(faults))


def validate_bins(bins: Sequence[float], lowest: float) -> None:
    if not bins or min(bins) < lowest:
        raise ValueError(f"a curve needs one bin or more, none below {lowest}; these are {list(bins)}")


def _bin_range(bins: Sequence[float]) -> float:
    first, last = float(bins[0]), float(bins[-1])
    if last <= first:
        raise ValueError(f"an area needs bins that ascend, not {first} to {last}")
    return last - first


# --- Indicators --------------------------------------------------------------------------------


def top_k_indicators(scored: DataFrame, bins: Sequence[int]) -> DataFrame:
    """group x K table of 0/1 hits (K beyond the group counts the whole group)."""
    validate_bins(bins, 1)
    exploded = group_ranks(scored).withColumn("k", F.explode(F.array(*[F.lit(int(b)) for b in bins])))
    return exploded.select(GROUP, "k", hit_at_k(F.col("k")).alias("hit"))


def top_k_percent_indicators(scored: DataFrame, bins: Sequence[float]) -> DataFrame:
    validate_bins(bins, 0)
    exploded = group_ranks(scored).withColumn("share", F.explode(F.array(*[F.lit(float(b)) for b in bins])))
    return exploded.select(GROUP, "share", hit_at_share(F.col("share")).alias("hit"))


# --- Draws -------------------------------------------------------------------------------------


def draw_index(seed: int, replicate: Column, draw: Column, n: Column) -> Column:
    """Hash (seed, replicate, draw) to an index in [0, n)."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), replicate.cast("string"), draw.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % n


def resampled_means(groups: DataFrame, values: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """Mean of each value column over every replicate's draws: (replicate, values …)."""
    digest, bucket = hash_order(GROUP)
    indexed = dense_index(groups, [digest, GROUP], bucket, "_i")
    n = groups.agg(F.count("*")).scalar()
    draws = (
        indexed.select("_i")
        .withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
        .select("replicate", draw_index(seed, F.col("replicate"), F.col("_i"), n).alias("_i"))
    )
    return draws.join(indexed.select("_i", *values), "_i").groupBy("replicate").agg(
        *[F.avg(v).alias(v) for v in values]
    )


def _interval(values: DataFrame, value: str, keys: Sequence[str], alpha: float) -> DataFrame:
    """Bootstrap summary; each key has one row per replicate, so percentiles are bounded."""
    return values.groupBy(*keys).agg(
        F.avg(value).alias("mean_bootstrap"),
        F.stddev_samp(value).alias("std_bootstrap"),
        F.percentile(value, F.lit(alpha / 2)).alias("ci_lower"),
        F.percentile(value, F.lit(1 - alpha / 2)).alias("ci_upper"),
    )


def _curve_interval(
    ranks: DataFrame, bins: Sequence, name: str, hit, replicates: int, alpha: float, seed: int
) -> DataFrame:
    values = [f"_h{i}" for i in range(len(bins))]
    groups = ranks.select(GROUP, *[hit(F.lit(b)).alias(v) for b, v in zip(bins, values)])
    pairs = F.array(*[F.struct(F.lit(b).alias(name), F.col(v).alias("_v")) for b, v in zip(bins, values)])
    curves = resampled_means(groups, values, replicates, seed).select(F.inline(pairs))
    point = groups.agg(*[F.avg(v).alias(v) for v in values]).select(F.inline(pairs)).withColumnRenamed(
        "_v", "point_estimate"
    )
    summary = _interval(curves, "_v", [name], alpha).join(point, name)
    return summary.select(
        name,
        "point_estimate",
        "mean_bootstrap",
        "std_bootstrap",
        "ci_lower",
        "ci_upper",
        F.lit(replicates).alias("n_bootstrap"),
        F.lit(alpha).alias("alpha"),
    )


def bootstrap_top_k(
    scored: DataFrame, bins: Sequence[int], replicates: int = 1000, alpha: float = 0.05, seed: int = 42
) -> DataFrame:
    """Confidence interval of mean Top@K per K."""
    validate_bootstrap(alpha, replicates)
    validate_bins(bins, 1)
    return _curve_interval(group_ranks(scored), [int(b) for b in bins], "k", hit_at_k, replicates, alpha, seed)


def bootstrap_top_k_percent(
    scored: DataFrame, bins: Sequence[float], replicates: int = 1000, alpha: float = 0.05, seed: int = 42
) -> DataFrame:
    validate_bootstrap(alpha, replicates)
    validate_bins(bins, 0)
    return _curve_interval(
        group_ranks(scored), [float(b) for b in bins], "share", hit_at_share, replicates, alpha, seed
    )


def group_areas(scored: DataFrame, bins: Sequence[float], name: str = "area") -> DataFrame:
    """Normalised area under each group's own hit curve."""
    return group_ranks(scored).select(GROUP, (share_auc(bins) / F.lit(_bin_range(bins))).alias(name))


def bootstrap_auc(
    scored: DataFrame,
    bins: Sequence[float] | None = None,
    replicates: int = 1000,
    alpha: float = 0.05,
    seed: int = 42,
    max_share: float = 0.20,
    step: float = 0.005,
) -> DataFrame:
    """Confidence interval of Top@K%-AUC; one scalar per group is all that is resampled."""
    bins = auc_bins(max_share, step) if bins is None else bins
    validate_bootstrap(alpha, replicates)
    validate_bins(bins, 0)
    groups = group_areas(scored, bins)
    means = resampled_means(groups, ["area"], replicates, seed)
    point = groups.agg(F.avg("area")).scalar()
    return _interval(means, "area", [], alpha).select(
        F.lit("topk_percent_auc").alias("metric"),
        point.alias("point_estimate"),
        "mean_bootstrap",
        "std_bootstrap",
        "ci_lower",
        "ci_upper",
        F.lit(replicates).alias("n_bootstrap"),
        F.lit(alpha).alias("alpha"),
    )


def alignment(scored_a: DataFrame, scored_b: DataFrame) -> DataFrame:
    """How many groups each side lacks: (missing_in_a, missing_in_b)."""
    a = scored_a.select(GROUP).distinct().withColumn("_a", F.lit(1))
    b = scored_b.select(GROUP).distinct().withColumn("_b", F.lit(1))
    return a.join(b, GROUP, "full_outer").agg(
        F.count_if(F.col("_a").isNull()).alias("missing_in_a"), F.count_if(F.col("_b").isNull()).alias("missing_in_b")
    )


def require_aligned(scored_a: DataFrame, scored_b: DataFrame) -> None:
    missing = alignment(scored_a, scored_b).first()
    if missing["missing_in_a"] or missing["missing_in_b"]:
        raise ValueError(
            f"cross-sections must match: {missing['missing_in_a']} missing in A, {missing['missing_in_b']} in B"
        )


def paired_auc_test(
    scored_a: DataFrame,
    scored_b: DataFrame,
    bins: Sequence[float] | None = None,
    replicates: int = 1000,
    alpha: float = 0.05,
    seed: int = 42,
    alternative: str = "two-sided",
    max_share: float = 0.20,
    step: float = 0.005,
    check_alignment: bool = True,
) -> DataFrame:
    """Paired bootstrap of AUC(A) - AUC(B): both models see the same draws, so differences are drawn."""
    bins = auc_bins(max_share, step) if bins is None else bins
    validate_bootstrap(alpha, replicates, alternative)
    validate_bins(bins, 0)
    if check_alignment:
        require_aligned(scored_a, scored_b)
    pairs = group_areas(scored_a, bins, "_a").join(group_areas(scored_b, bins, "_b"), GROUP)
    groups = pairs.select(GROUP, (F.col("_a") - F.col("_b")).alias("diff"))
    diffs = resampled_means(groups, ["diff"], replicates, seed)
    # sums in another order differ in their last bits; a difference that small is none
    diffs = diffs.withColumn("diff", F.round("diff", 12))
    at_most, at_least = F.avg((F.col("diff") <= 0).cast("double")), F.avg((F.col("diff") >= 0).cast("double"))
    p_value = {
        "greater": at_most,
        "less": at_least,
        "two-sided": F.least(F.lit(1.0), 2 * F.least(at_most, at_least)),
    }[alternative]
    observed = groups.agg(F.avg("diff")).scalar()
    return diffs.agg(
        F.avg("diff").alias("mean_diff_bootstrap"),
        F.percentile("diff", F.lit(alpha / 2)).alias("ci_lower"),
        F.percentile("diff", F.lit(1 - alpha / 2)).alias("ci_upper"),
        p_value.alias("p_value"),
    ).select(
        F.lit("topk_percent_auc").alias("metric"),
        observed.alias("observed_diff"),
        "mean_diff_bootstrap",
        "ci_lower",
        "ci_upper",
        "p_value",
        F.lit(alternative).alias("alternative"),
        F.lit(replicates).alias("n_bootstrap"),
        F.lit(alpha).alias("alpha"),
    )


# --- Sub-periods and run summaries ---------------------------------------------------------------


def with_subperiod(scored: DataFrame, split_date: str, date_col: str = EVENT_TIME) -> DataFrame:
    """Add ``subperiod``: early when a group's first date is at or before ``split_date``, else late."""
    first = scored.groupBy(GROUP).agg(F.min(date_col).alias("_first"))
    label = F.when(F.col("_first") <= F.lit(split_date).cast("timestamp_ntz"), "early").otherwise("late")
    return scored.join(first.select(GROUP, label.alias("subperiod")), GROUP)


def subperiod_metrics(
    scored: DataFrame,
    split_date: str,
    bins: Sequence[float] = (0.01, 0.02, 0.05, 0.1, 0.2),
    min_events: int = 10,
    date_col: str = EVENT_TIME,
) -> DataFrame:
    """AUC and Top@K% per sub-period; sub-periods with fewer than ``min_events`` groups are left out."""
    periods = with_subperiod(scored, split_date, date_col)
    key = ["subperiod"]
    sizes = (
        periods.groupBy("subperiod", GROUP)
        .agg(F.count("*").alias("_rows"))
        .groupBy("subperiod")
        .agg(F.count("*").alias("n_pumps"), F.sum("_rows").alias("n_rows"))
        .where(F.col("n_pumps") >= min_events)
    )
    wide = top_k_percent(periods, bins, key).groupBy("subperiod").agg(
        *[F.max(F.when(F.col("share") == float(b), F.col("value"))).alias(f"topk_percent@{b:g}") for b in bins]
    )
    return sizes.join(top_k_percent_auc(periods, keys=key), "subperiod").join(wide, "subperiod")


def describe_runs(results: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, deviation, extremes and 10/25/50/75/90 % points of the ``topk_`` columns, one row each."""
    columns = [c for c in results.columns if c.startswith("topk_")] if columns is None else list(columns)
    long = results.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(quoted(c)).alias("_v")) for c in columns]))
    )
    probs = (0.1, 0.25, 0.5, 0.75, 0.9)
    points = [f"p{int(p * 100)}" for p in probs]
    summary = long.groupBy("metric").agg(
        F.count("_v").alias("count"),
        F.avg("_v").alias("mean"),
        F.stddev_samp("_v").alias("std"),
        F.min("_v").alias("min"),
        F.max("_v").alias("max"),
    )
    joined = summary.join(exact_percentiles(long, ["metric"], "_v", probs, points), "metric", "left")
    return joined.select("metric", "count", "mean", "std", "min", *points, "max")
