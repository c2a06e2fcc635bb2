"""Group-ranking metrics over scored cross-sections.

A scored table has (pump_hash, currency_pair, is_pumped, score) and, when several models are
compared, key columns such as ``model``. Ties rank by candidate id; NULL scores rank last.

Top@K style metrics only ask whether a positive is among the first K. That holds exactly when the
best positive's rank is at most K, and a rank is one plus the rows that beat it. So groups are
counted, never sorted, and the curves are arithmetic on one small row per group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.names import CANDIDATE, GROUP, LABEL, SCORE, TOPK_BINS, TOPK_PERCENT_BINS
from tickspark.operators.running import bucketed_lag, bucketed_running_sum, range_bucket



def auc_bins(max_share: float = 0.20, step: float = 0.005) -> list[float]:
    """The grid 0, step, 2*step … max_share in double arithmetic."""
    return [i * step for i in range(round(max_share / step) + 1)]


def curve_bins() -> list[float]:
    return [i * 0.01 for i in range(21)]


def score_table(predictions: DataFrame, score: Column | str, keys: Sequence[str] = ()) -> DataFrame:
    """Keep what the metrics need from a model's output."""
    column = F.col(score) if isinstance(score, str) else score
    return predictions.select(*keys, GROUP, CANDIDATE, LABEL, column.alias(SCORE))


def sort_score() -> Column:
    """The score with NULL and NaN below every number."""
    return F.coalesce(F.nanvl(SCORE, F.lit(float("-inf"))), F.lit(float("-inf")))


def group_ranks(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per group: rows ``n``, positives ``positives`` and rank ``best_rank`` of the best positive."""
    group = [*keys, GROUP]
    best = (
        scored.where(LABEL)
        .groupBy(*group)
        .agg(F.count("*").alias("positives"), F.min(F.struct(-sort_score(), CANDIDATE)).alias("_b"))
        .select(*group, "positives", (-F.col("_b.col1")).alias("_best"), F.col(f"_b.{CANDIDATE}").alias("_id"))
    )
    beats = (F.col("_s") > F.col("_best")) | ((F.col("_s") == F.col("_best")) & (F.col(CANDIDATE) < F.col("_id")))
    return (
        scored.select(*group, CANDIDATE, sort_score().alias("_s"))
        .join(best, group, "left")
        .groupBy(*group)
        .agg(
            F.count("*").alias("n"),
            F.coalesce(F.max("positives"), F.lit(0).cast("bigint")).alias("positives"),
            F.when(F.max("positives").isNotNull(), F.count_if(beats) + 1).alias("best_rank"),
        )
    )


def hit_at_k(k: Column) -> Column:
    """1.0 when the best positive is among the first ``k`` rows."""
    return F.coalesce((F.col("best_rank") <= k).cast("double"), F.lit(0.0))


def hit_at_share(share: Column) -> Column:
    """1.0 when the best positive is among the first ceil(n * share) rows; a share of 0 misses."""
    return hit_at_k(F.ceil(F.col("n") * share))


def share_auc(bins: Sequence[float]) -> Column:
    """Trapezoid area under one group's hit curve over ``bins``.

    The trapezoid rule is linear in the hits, so averaging these areas over groups equals the area
    under the averaged curve.
    """
    edges = [float(b) for b in bins]
    weights = [
        ((edges[i + 1] if i + 1 < len(edges) else edges[i]) - (edges[i - 1] if i else edges[i])) / 2
        for i in range(len(edges))
    ]
    return reduce(lambda a, b: a + b, [hit_at_share(F.lit(e)) * F.lit(w) for e, w in zip(edges, weights)])


def _per_bin(ranks: DataFrame, keys: Sequence[str], bins: Sequence, name: str, hit, type_: str) -> DataFrame:
    values = F.array(*[F.lit(b).cast(type_) for b in bins])
    exploded = ranks.withColumn(name, F.explode(values))
    return exploded.groupBy(*keys, name).agg(
        F.try_divide(F.sum(hit(F.col(name))), F.sum("positives")).alias("value")
    )


def top_k(scored: DataFrame, bins: Sequence[int] = TOPK_BINS, keys: Sequence[str] = ()) -> DataFrame:
    """Top@K: groups with a positive in the first K rows over the number of positive rows."""
    return _per_bin(group_ranks(scored, keys), keys, bins, "k", hit_at_k, "int")


def top_k_percent(
    scored: DataFrame, bins: Sequence[float] = TOPK_PERCENT_BINS, keys: Sequence[str] = ()
) -> DataFrame:
    """Top@K%: the same with K = ceil(n * share) per group."""
    return _per_bin(group_ranks(scored, keys), keys, bins, "share", hit_at_share, "double")


def top_k_percent_auc(
    scored: DataFrame, max_share: float = 0.20, step: float = 0.005, keys: Sequence[str] = ()
) -> DataFrame:
    """Area under Top@K% for shares in (0, max_share], normalised by max_share; 0 without positives."""
    area = share_auc(auc_bins(max_share, step))
    value = F.coalesce(F.try_divide(F.sum(area), F.sum("positives")) / F.lit(max_share), F.lit(0.0))
    return group_ranks(scored, keys).groupBy(*keys).agg(value.alias("topk_percent_auc"))


def random_top_k(scored: DataFrame, bins: Sequence[int] = TOPK_BINS, keys: Sequence[str] = ()) -> DataFrame:
    """Expected Top@K of random ranking: mean of K / n over groups (not capped at 1)."""
    sizes = scored.groupBy(*keys, GROUP).agg(F.count("*").alias("n"))
    exploded = sizes.withColumn("k", F.explode(F.array(*[F.lit(b) for b in bins])))
    return exploded.groupBy(*keys, "k").agg(F.avg(F.col("k") / F.col("n")).alias("value"))


# --- Decision rules ------------------------------------------------------------------------------


def predicted_labels(
    scored: DataFrame, rule: str = "top1_per_cross_section", threshold: float = 0.5, keys: Sequence[str] = ()
) -> DataFrame:
    """Add ``predicted`` 0/1: the best row of each group, or every score at or above ``threshold``."""
    if rule == "threshold":
        return scored.withColumn("predicted", F.coalesce((F.col(SCORE) >= threshold).cast("int"), F.lit(0)))
    if rule != "top1_per_cross_section":
        raise ValueError(f"unknown decision rule {rule!r}")
    group = [*keys, GROUP]
    best = scored.groupBy(*group).agg(F.min(F.struct(-sort_score(), CANDIDATE)).getField(CANDIDATE).alias("_top"))
    return scored.join(best, group).withColumn("predicted", (F.col(CANDIDATE) == F.col("_top")).cast("int")).drop("_top")


def classification_table(
    scored: DataFrame, rule: str = "top1_per_cross_section", threshold: float = 0.5, keys: Sequence[str] = ()
) -> DataFrame:
    """Confusion counts, F1 (0 when undefined) and balanced accuracy over the classes present."""
    hit, actual = F.col("predicted") == 1, F.col(LABEL)
    counts = predicted_labels(scored, rule, threshold, keys).groupBy(*keys).agg(
        F.count_if(hit & actual).alias("tp"),
        F.count_if(hit & ~actual).alias("fp"),
        F.count_if(~hit & actual).alias("fn"),
        F.count_if(~hit & ~actual).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recall_1, recall_0 = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    present = (tp + fn > 0).cast("int") + (tn + fp > 0).cast("int")
    return counts.withColumns(
        {
            "f1": F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)),
            "balanced_accuracy": F.try_divide(
                F.coalesce(recall_1, F.lit(0.0)) + F.coalesce(recall_0, F.lit(0.0)), present
            ),
        }
    )


# --- Precision and recall --------------------------------------------------------------------------


def precision_recall_curve(scored: DataFrame, keys: Sequence[str] = (), buckets: int = 64) -> DataFrame:
    """One point per distinct score, highest first: (score, precision, recall).

    Rows are counted per distinct score before any ordering, and the running counts are summed
    inside score ranges and shifted by the ranges above.
    """
    counts = (
        scored.select(*keys, sort_score().alias(SCORE), F.col(LABEL).cast("bigint").alias("_p"))
        .groupBy(*keys, SCORE)
        .agg(F.sum("_p").alias("_tp"), F.count("*").alias("_all"))
        .withColumn("_down", -F.col(SCORE))
    )
    ranged = range_bucket(counts, "_down", keys, buckets)
    running = bucketed_running_sum(ranged, keys, "_bucket", ["_down"], {"_tp": "tp", "_all": "flagged"})
    positives = counts.groupBy(*keys).agg(F.sum("_tp").alias("_positives"))
    joined = running.join(positives, list(keys)) if keys else running.withColumn("_positives", positives.scalar())
    return joined.select(
        *keys,
        "_bucket",
        "_down",
        SCORE,
        (F.col("tp") / F.col("flagged")).alias("precision"),
        F.try_divide(F.col("tp"), F.col("_positives")).alias("recall"),
    )


def pr_auc(scored: DataFrame, keys: Sequence[str] = (), buckets: int = 64) -> DataFrame:
    """Trapezoid area under precision over recall, anchored at recall 0 and precision 1."""
    curve = precision_recall_curve(scored, keys, buckets)
    lagged = _lag_points(curve, keys)
    width = F.col("recall") - F.coalesce("_r", F.lit(0.0))
    height = (F.col("precision") + F.coalesce("_p", F.lit(1.0))) / 2
    return lagged.groupBy(*keys).agg(F.sum(width * height).alias("pr_auc"))


def _lag_points(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    return bucketed_lag(curve, keys, "_bucket", "_down", {"recall": "_r", "precision": "_p"})


# --- Several models --------------------------------------------------------------------------------


def stack_models(scored: dict[str, DataFrame]) -> DataFrame:
    """Union named scored tables under a ``model`` column."""
    named = [df.select(F.lit(name).alias("model"), GROUP, CANDIDATE, LABEL, SCORE) for name, df in scored.items()]
    return reduce(DataFrame.unionByName, named)


def model_columns(table: DataFrame, bin_col: str, models: Sequence[str]) -> DataFrame:
    """Bins as rows and models as columns."""
    return table.groupBy(bin_col).pivot("model", list(models)).agg(F.first("value"))
