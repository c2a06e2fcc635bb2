"""Ordered operators that never put a whole key, or the whole table, into one sort.

A plain ``Window.partitionBy(key).orderBy(t)`` sorts all rows of a key in one task, so a key with
a third of the rows stalls the job, and a window without a key stalls always. Each operator here
works in two levels instead: a window inside (key, bucket), and a second window over one summary
row per (key, bucket). Buckets are calendar slots or ranges of the sort value, so the second level
is small however many rows there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickspark.session import materialise

_BUCKET = "_bucket"
_POSITION = "_position"


def bucketed_lag(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: str,
    columns: dict[str, str],
) -> DataFrame:
    """Previous row's values per key: ``columns`` maps a source column to its lagged name.

    ``bucket`` must be a column that never decreases along ``order`` inside a key.
    """
    keys = list(keys)
    inside = Window.partitionBy(*keys, bucket).orderBy(order)
    local = df.withColumns({_POSITION: F.row_number().over(inside)}).withColumns(
        {lagged: F.lag(source).over(inside) for source, lagged in columns.items()}
    )
    carry = bucket_carry(df, keys, bucket, order, {s: f"_carry_{d}" for s, d in columns.items()})
    joined = local.join(carry, [*keys, bucket], "left")
    first = F.col(_POSITION) == 1
    return joined.withColumns(
        {d: F.when(first, F.col(f"_carry_{d}")).otherwise(F.col(d)) for d in columns.values()}
    ).drop(_POSITION, *[f"_carry_{d}" for d in columns.values()])


def bucket_carry(
    df: DataFrame, keys: Sequence[str], bucket: str, order: str, columns: dict[str, str]
) -> DataFrame:
    """One row per (key, bucket) holding the last values of the bucket before it."""
    keys = list(keys)
    tails = df.groupBy(*keys, bucket).agg(
        *[F.max_by(F.col(source), F.col(order)).alias(carried) for source, carried in columns.items()]
    )
    across = Window.partitionBy(*keys).orderBy(bucket)
    return tails.withColumns({carried: F.lag(carried).over(across) for carried in columns.values()})


def bucketed_running_sum(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[str | Column],
    sums: dict[str, str],
) -> DataFrame:
    """Inclusive running sums per key; ``sums`` maps a source column to its running total."""
    keys = list(keys)
    inside = (
        Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    totals = df.groupBy(*keys, bucket).agg(
        *[F.sum(source).alias(f"_before_{running}") for source, running in sums.items()]
    )
    # With no keys the window covers only the bucket totals, whose number the caller bounds.
    across = (
        (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))
        .orderBy(bucket)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.withColumns(
        {f"_before_{r}": F.coalesce(F.sum(f"_before_{r}").over(across), F.lit(0)) for r in sums.values()}
    )
    local = df.withColumns({running: F.sum(source).over(inside) for source, running in sums.items()})
    joined = local.join(offsets, [*keys, bucket])
    return joined.withColumns({r: F.col(r) + F.col(f"_before_{r}") for r in sums.values()}).drop(
        *[f"_before_{r}" for r in sums.values()]
    )


def dense_index(df: DataFrame, order: Sequence[str | Column], bucket: Column, name: str) -> DataFrame:
    """Number the rows 0, 1, 2 … along ``order``.

    ``bucket`` must agree with ``order`` (non-decreasing) and take few values; rows are ranked
    inside their bucket and shifted by the sizes of the buckets before it.
    """
    counted = bucketed_running_sum(
        df.withColumns({_BUCKET: bucket, "_one": F.lit(1).cast("bigint")}), [], _BUCKET, order, {"_one": name}
    )
    return counted.withColumn(name, F.col(name) - 1).drop(_BUCKET, "_one")


def hash_order(id_: str | Column, seed: int | None = None) -> tuple[Column, Column]:
    """A reproducible shuffle of ids as (sort value, 256-way bucket that agrees with it)."""
    column = F.col(id_) if isinstance(id_, str) else id_
    text = column.cast("string") if seed is None else F.concat(F.lit(f"{seed}:"), column.cast("string"))
    digest = F.md5(text)
    return digest, F.substring(digest, 1, 2)


def range_bucket(df: DataFrame, value: str, keys: Sequence[str] = (), buckets: int = 256) -> DataFrame:
    """Add ``_bucket``: the ascending range of ``value`` a row falls in, ranges of near-equal size.

    Bounds come from a mergeable sketch, so they cost one aggregate and ``buckets`` numbers. Any
    bounds give right results downstream; even ones only balance the work.
    """
    probs = [i / buckets for i in range(1, buckets)]
    bounds = df.groupBy(*keys).agg(F.percentile_approx(value, probs, F.lit(10 * buckets)).alias("_bounds"))
    joined = df.join(bounds, list(keys)) if keys else df.withColumn("_bounds", bounds.scalar())
    # A binary search in columns: the number of bounds below the value, as a count over all of them would find it.
    found = joined.withColumn(_BUCKET, F.lit(0))
    for step in reversed([1 << i for i in range((buckets - 1).bit_length())]):
        passed = F.get("_bounds", F.col(_BUCKET) + F.lit(step - 1)) < F.col(value)
        found = found.withColumn(_BUCKET, F.col(_BUCKET) + F.when(passed, F.lit(step)).otherwise(F.lit(0)))
    return found.drop("_bounds")


_SLACK = 1e-3
_ACCURACY = 10_000


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str]
) -> DataFrame:
    """Exact linear-interpolation percentiles per key without gathering a key's values.

    A mergeable sketch brackets each percentile within a per-mille of the ranks; one more pass
    counts what lies below the bracket and keeps only the distinct values inside it, plus the
    nearest value on either side. The two order statistics are then read off running counts, which are
    summed in ranges of the bracket and shifted by the ranges before.
    The bracket is wider than the sketch error, so the answer is exact and not estimated.
    NULL values are ignored; a key with only NULLs yields no row.
    """
    keys = list(keys)
    present = df.select(*keys, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    spans = [p for prob in probs for p in (max(0.0, prob - _SLACK), min(1.0, prob + _SLACK))]
    bracket = present.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.percentile_approx("_v", spans, F.lit(_ACCURACY)).alias("_span")
    )
    wanted = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                F.lit(float(prob)).alias("p"),
                F.get("_span", F.lit(2 * i)).alias("lo"),
                F.get("_span", F.lit(2 * i + 1)).alias("hi"),
            )
            for i, prob in enumerate(probs)
        ]
    )
    targets = bracket.select(*keys, F.struct("_n", wanted.alias("_w")).alias("_t"))
    joined = present.join(targets, keys) if keys else present.withColumn("_t", targets.scalar())
    joined = joined.select(*keys, "_v", F.col("_t._n").alias("_n"), F.explode("_t._w").alias("_w")).select(
        *keys, "_v", "_n", "_w.*"
    )
    zone = F.when(F.col("_v") < F.col("lo"), 0).when(F.col("_v") <= F.col("hi"), 1).otherwise(2)
    spots = (
        joined.withColumn("_zone", zone)
        .groupBy(*keys, "i", "p", "_n", "_zone", F.when(F.col("_zone") == 1, F.col("_v")).alias("_mid"))
        .agg(F.count("*").alias("_rows"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
        # Below the bracket its last value matters, above it the first one.
        .withColumn("_at", F.when(F.col("_zone") == 0, F.col("_max")).otherwise(F.col("_min")))
    )
    # One small row per distinct value in a bracket, read by the bounds, the totals and the running counts.
    stored = materialise(spots, "percentile-spots")
    each = [*keys, "i"]
    ranged = range_bucket(stored, "_mid", each, 64)
    ordered = ranged.withColumn(_BUCKET, F.when(F.col("_zone") == 0, -1).when(F.col("_zone") == 2, 64).otherwise(F.col(_BUCKET)))
    running = bucketed_running_sum(ordered, each, _BUCKET, ["_zone", "_mid"], {"_rows": "_upto"})
    rank = F.col("p") * (F.col("_n") - 1)
    low, high = F.floor(rank) + 1, F.ceil(rank) + 1
    ranked = running.withColumns({"_low": low, "_high": high, "_part": rank - F.floor(rank)})
    ends_at = F.col("_upto")
    starts_after = F.col("_upto") - F.col("_rows")
    covers = lambda r: (starts_after < F.col(r)) & (F.col(r) <= ends_at)
    picked = ranked.groupBy(*keys, "i").agg(
        F.max(F.when(covers("_low"), F.col("_at"))).alias("_a"),
        F.max(F.when(covers("_high"), F.col("_at"))).alias("_b"),
        F.first("_part").alias("_part"),
    )
    value_at = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("i") == i, value_at)).alias(name) for i, name in enumerate(names)]
    )
