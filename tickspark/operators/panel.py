"""The labelled cross-section panel: build, clean, standardise, fill, split and sample."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.functions.numeric import clip, ratio
from tickspark.names import (
    CANDIDATE,
    EVENT_TIME,
    GROUP,
    GROUP_ID,
    LABEL,
    SPLIT_BOUNDARIES,
    SPLIT_NAMES,
    TARGET,
    feature_columns,
    quoted,
    regressor_columns,
    standardised_columns,
)
from tickspark.operators.running import bucketed_running_sum, dense_index, exact_percentiles, hash_order, range_bucket
from tickspark.session import materialise


def positive_label(candidate: Column, target: Column) -> Column:
    return candidate == target


# --- Assembly ------------------------------------------------------------------------------


def assemble_panel(features: DataFrame, events: DataFrame) -> DataFrame:
    """Attach event columns and the label; events whose target has no feature row are left out.

    The events are stored once they are known: as the short list that they are, they meet the features where those lie.
    """
    targets = events.select(GROUP, F.col(TARGET).alias(CANDIDATE)).distinct()
    found = features.select(GROUP, CANDIDATE).join(targets, [GROUP, CANDIDATE]).distinct()
    usable = materialise(found.withColumnRenamed(CANDIDATE, TARGET), "usable-events")
    return features.join(usable, GROUP).withColumn(LABEL, positive_label(F.col(CANDIDATE), F.col(TARGET)))


def dropped_events(features: DataFrame, events: DataFrame) -> DataFrame:
    """Events without any feature row, or whose target has none."""
    return events.join(features.select(GROUP, F.col(CANDIDATE).alias(TARGET)), [GROUP, TARGET], "left_anti")


def group_ids(events: DataFrame) -> DataFrame:
    """Number the groups 0, 1, 2 … in order of event time, then id."""
    return dense_index(
        events.select(GROUP, EVENT_TIME), [EVENT_TIME, GROUP], F.to_date(EVENT_TIME), GROUP_ID
    ).select(GROUP, GROUP_ID)


def add_group_id(panel: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Stored, the ids are seen to be few, and the panel meets them where it lies."""
    source = panel.select(GROUP, EVENT_TIME).distinct() if events is None else events
    return panel.join(materialise(group_ids(source), "group-ids"), GROUP)


# --- Checks --------------------------------------------------------------------------------


def check_columns(df: DataFrame, columns: Sequence[str]) -> None:
    """Raise when a required column is missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")


def groups_without_single_positive(panel: DataFrame) -> DataFrame:
    """Groups whose number of positive rows is not exactly one."""
    counted = panel.groupBy(GROUP).agg(F.sum(F.col(LABEL).cast("bigint")).alias("positives"))
    return counted.where(F.col("positives") != 1)


def require_single_positive(panel: DataFrame) -> None:
    """Raise when a group holds more than one positive (stops at the first such group)."""
    if not groups_without_single_positive(panel).where(F.col("positives") > 1).isEmpty():
        raise ValueError("found several positives within one cross-section")


# --- Projections -----------------------------------------------------------------------------


def regressors(panel: DataFrame, slugs: Sequence[str] | None = None) -> DataFrame:
    return panel.select(*[quoted(c) for c in regressor_columns(list(slugs) if slugs else None)])


# --- Cleaning --------------------------------------------------------------------------------


def positive_dense_rank(panel: DataFrame, value: str) -> DataFrame:
    """Dense rank (highest first) of each group's positive by ``value``: (group, positive_rank).

    A dense rank is one plus the number of distinct larger values, so it needs no sort of the group:
    rows above the positive are deduplicated by value and counted. NULL stays unranked.
    """
    v = F.col(quoted(value))
    positives = panel.where(LABEL).select(GROUP, v.alias("_positive"))
    above = (
        panel.select(GROUP, v.alias("_value"))
        .join(positives, GROUP)
        .where(F.col("_value") > F.col("_positive"))
        .groupBy(GROUP, "_value")
        .agg(F.lit(1).alias("_one"))
        .groupBy(GROUP)
        .agg(F.count("*").alias("_above"))
    )
    rank = F.when(F.col("_positive").isNotNull(), F.coalesce("_above", F.lit(0)) + 1)
    return positives.join(above, GROUP, "left").select(GROUP, rank.alias("positive_rank"))


def keep_groups(df: DataFrame, groups: DataFrame, key: str = GROUP) -> DataFrame:
    return df.join(groups.select(key), key, "left_semi")


def remove_failed_events(panel: DataFrame, value: str = "target_return@1MIN", worst_rank: int = 10) -> DataFrame:
    """Keep groups whose positive ranks above ``worst_rank`` by its own return, or has no return.

    The kept groups are stored: the panel is not shuffled to a list as short as the events.
    """
    ranks = positive_dense_rank(panel, value)
    good = ranks.where(F.col("positive_rank").isNull() | (F.col("positive_rank") < worst_rank))
    return keep_groups(panel, materialise(good.select(GROUP), "kept-groups"))


def clip_tail_exponents(panel: DataFrame, slugs: Sequence[str]) -> DataFrame:
    names = feature_columns("powerlaw_alpha", list(slugs))
    return panel.withColumns({name: clip(F.col(quoted(name)), 1.0, 2.0) for name in names})


def standardise(panel: DataFrame, columns: Sequence[str], group: str = GROUP, guard: bool = True) -> DataFrame:
    """(x - mean) / sample deviation inside each group.

    With ``guard`` a column that is constant in a group is left as it is. Group statistics are
    partial aggregates joined back, so a huge group costs one row per task in the shuffle; stored, they are seen to be
    small and the panel stays where it lies.
    """
    stats = panel.groupBy(group).agg(
        *[
            expression
            for i, name in enumerate(columns)
            for c in [F.col(quoted(name))]
            for expression in (
                F.avg(c).alias(f"_mean{i}"),
                F.stddev_samp(c).alias(f"_std{i}"),
                (F.min(c) == F.max(c)).alias(f"_flat{i}"),
            )
        ]
    )

    def scaled(i: int, name: str) -> Column:
        x, std = F.col(quoted(name)), F.col(f"_std{i}")
        z = F.try_divide(x - F.col(f"_mean{i}"), F.when(std != 0, std))
        return F.when(F.col(f"_flat{i}"), x).otherwise(z) if guard else z

    helpers = [f"_{stem}{i}" for i in range(len(columns)) for stem in ("mean", "std", "flat")]
    return panel.join(materialise(stats, "group-stats"), group).withColumns({n: scaled(i, n) for i, n in enumerate(columns)}).drop(*helpers)


def _long(panel: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    entries = F.array(
        *[F.struct(F.lit(i).alias("_c"), F.col(quoted(n)).cast("double").alias("_x")) for i, n in enumerate(columns)]
    )
    return panel.select(*keys, F.inline(entries))


def group_medians(panel: DataFrame, columns: Sequence[str], group: str | None = GROUP) -> DataFrame:
    """Exact medians of many columns, per group or (``group=None``) over the whole panel, as one wide row."""
    keys = [group] if group else []
    return _wide_medians(_long(panel, columns, keys), columns, keys)


def _wide_medians(entries: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    long = exact_percentiles(entries, [*keys, "_c"], "_x", [0.5], ["_median"])
    wide = [F.max(F.when(F.col("_c") == i, F.col("_median"))).alias(f"_m{i}") for i in range(len(columns))]
    return long.groupBy(*keys).agg(*wide)


def fill_with_medians(panel: DataFrame, columns: Sequence[str], group: str = GROUP) -> DataFrame:
    """Fill NULLs with the group's median, then with the median of all rows.

    Only the (group, column) pairs that hold a NULL and a value need the group's median, and only the columns that
    some group lacks altogether need the median of all rows; one count per group and column finds both.
    """
    counted = panel.groupBy(group).agg(F.count("*").alias("_rows"), *[F.count(F.col(quoted(c))).alias(f"_n{i}") for i, c in enumerate(columns)])
    counted = materialise(counted, "null-counts")
    entries = F.array(*[F.struct(F.lit(i).alias("_c"), F.col(f"_n{i}").alias("_n")) for i in range(len(columns))])
    partly = counted.select(group, "_rows", F.inline(entries)).where((F.col("_n") > 0) & (F.col("_n") < F.col("_rows")))
    long = _long(panel, columns, [group]).join(partly.select(group, "_c"), [group, "_c"], "left_semi")
    by_group = _wide_medians(long, columns, [group])
    lacking = counted.agg(*[F.coalesce(F.bool_or(F.col(f"_n{i}") == 0), F.lit(False)).alias(f"_l{i}") for i in range(len(columns))])
    absent = [c for c, needed in zip(columns, lacking.first()) if needed]  # one flag per column
    joined = panel.join(by_group, group, "left")
    overall: dict[str, Column] = {}
    if absent:
        medians = group_medians(panel, absent, None)
        joined = joined.withColumn("_overall", medians.select(F.struct(*medians.columns)).scalar())
        overall = {c: F.col(f"_overall._m{i}") for i, c in enumerate(absent)}
    filled = {
        c: F.coalesce(F.col(quoted(c)).cast("double"), F.col(f"_m{i}"), overall.get(c, F.lit(None).cast("double")))
        for i, c in enumerate(columns)
    }
    return joined.withColumns(filled).drop("_overall", *[f"_m{i}" for i in range(len(columns))])


def percentile_rank(panel: DataFrame, value: str, name: str, group: str = GROUP, fill: float | None = 0.0) -> DataFrame:
    """Descending percentile rank with average ties: the largest value gets the smallest rank.

    Ranks come from counts per distinct value, accumulated over value ranges, so no group is
    sorted in one task. The counts are stored: bounds, running sums and sizes read them, and none reads the panel again.
    """
    v = F.col(quoted(value))
    filled = panel.withColumn("_value", v if fill is None else F.coalesce(v, F.lit(float(fill))))
    counts = filled.where(F.col("_value").isNotNull()).groupBy(group, "_value").agg(F.count("*").alias("_ties"))
    counts = materialise(counts, "value-counts").withColumn("_down", -F.col("_value"))
    ranged = range_bucket(counts, "_down", [group], 32)
    running = bucketed_running_sum(ranged, [group], "_bucket", ["_down"], {"_ties": "_upto"})
    sizes = counts.groupBy(group).agg(F.sum("_ties").alias("_n"))
    rank = (F.col("_upto") - F.col("_ties") + (F.col("_ties") + 1) / 2) / F.col("_n")
    ranks = running.join(sizes, group).select(group, "_value", rank.alias(name))
    if value in panel.columns and fill is not None:
        filled = filled.withColumn(value, F.col("_value"))
    return filled.join(ranks, [group, "_value"], "left").drop("_value")


# --- Splits and samples ------------------------------------------------------------------------


def split_by_time(
    panel: DataFrame,
    boundaries: Sequence[datetime] = tuple(SPLIT_BOUNDARIES),
    names: Sequence[str] = tuple(SPLIT_NAMES),
    time_col: str = EVENT_TIME,
) -> DataFrame:
    """Add ``split``: before the first boundary, between boundaries, from the last one on."""
    if len(names) != len(boundaries) + 1:
        raise ValueError(f"{len(boundaries)} boundaries make {len(boundaries) + 1} splits, but {len(names)} are named")
    t = F.col(time_col)
    chain = reduce(
        lambda acc, pair: acc.when(t < F.lit(pair[0]).cast("timestamp_ntz"), pair[1]),
        list(zip(boundaries, names))[1:],
        F.when(t < F.lit(boundaries[0]).cast("timestamp_ntz"), names[0]),
    )
    return panel.withColumn("split", F.when(t.isNotNull(), chain.otherwise(names[-1])))


def sample_groups(
    df: DataFrame, fraction: float, seed: int, group: str = GROUP, at_least: int = 1
) -> DataFrame:
    """Rows of ceil(fraction * groups) whole groups, drawn without replacement by seeded hash order."""
    if not 0 < fraction <= 1:
        raise ValueError(f"fraction must be in (0, 1], got {fraction}")
    if at_least < 1:
        raise ValueError(f"at_least must be >= 1, got {at_least}")
    groups = df.select(group).distinct()
    digest, bucket = hash_order(group, seed)
    indexed = dense_index(groups, [digest, group], bucket, "_i")
    total = groups.agg(F.count("*")).scalar()
    wanted = F.least(F.greatest(F.lit(at_least), F.ceil(total * F.lit(float(fraction)))), total)
    return keep_groups(df, indexed.where(F.col("_i") < wanted), group)


def distinct_groups(df: DataFrame, group: str = GROUP) -> DataFrame:
    return df.select(group).distinct()


def group_set_difference(left: DataFrame, right: DataFrame, group: str = GROUP) -> DataFrame:
    """Groups present on one side only, with the side that lacks them."""
    a, b = distinct_groups(left, group), distinct_groups(right, group)
    return a.exceptAll(b).withColumn("missing_in", F.lit("b")).unionByName(
        b.exceptAll(a).withColumn("missing_in", F.lit("a"))
    )


def union_panels(panels: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), panels)


# --- Descriptions ------------------------------------------------------------------------------


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(quoted(column)).agg(F.count("*").alias("count"))


def feature_histograms(panel: DataFrame, columns: Sequence[str], bins: int = 50, group: str = GROUP) -> DataFrame:
    """Equal-width counts per (group, feature); bin edges span the feature's range over all groups.

    Bins run 1 … ``bins`` with the maximum in the last one, as histograms are usually drawn.
    """
    names = F.array(*[F.lit(name) for name in columns])
    long = _long(panel, columns, [group]).where(F.col("_x").isNotNull() & (F.abs("_x") < float("inf")))
    span = long.groupBy("_c").agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    width = (F.col("_high") - F.col("_low")) / bins
    position = F.floor(ratio(F.col("_x") - F.col("_low"), width)) + 1
    slot = F.when(width == 0, F.lit(1)).otherwise(F.least(position, F.lit(bins)))
    return (
        long.join(span, "_c")
        .groupBy(group, "_c", slot.cast("int").alias("bin"))
        .agg(F.count("*").alias("count"))
        .select(group, F.get(names, F.col("_c")).alias("feature"), "bin", "count")
    )


# --- Preprocessing variants ------------------------------------------------------------------


def preprocess(
    panel: DataFrame,
    slugs: Sequence[str],
    variant: str = "default",
    success_column: str = "target_return@1MIN",
    rank_column: str = "target_return@5MIN",
    worst_rank: int = 10,
    events: DataFrame | None = None,
) -> DataFrame:
    """Group ids, failed-event removal, tail clipping and standardisation, per model family.

    ``logistic`` fills NULLs before standardising, ``oversampled`` after it; ``ranker`` adds the
    percentile rank of ``rank_column`` as ``asset_return_rank``. Every step joins group statistics back
    to the panel, so pass a stored panel (see ``sources.panel_store``) and not a feature plan.
    """
    if variant not in ("default", "logistic", "oversampled", "ranker"):
        raise ValueError(f"unknown variant {variant!r}")
    slugs = list(slugs)
    check_columns(panel, [*regressor_columns(slugs), LABEL, GROUP, EVENT_TIME])
    require_single_positive(panel)
    df = add_group_id(panel, events)
    df = clip_tail_exponents(remove_failed_events(df, success_column, worst_rank), slugs)
    if variant == "logistic":
        df = fill_with_medians(df, regressor_columns(slugs))
    df = standardise(df, standardised_columns(slugs))
    if variant == "oversampled":
        df = fill_with_medians(df, regressor_columns(slugs))
    if variant == "ranker":
        df = percentile_rank(df, rank_column, "asset_return_rank")
    return df
