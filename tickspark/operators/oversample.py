"""Synthetic minority oversampling: interpolate positives towards their nearest positives."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickspark.names import LABEL, quoted
from tickspark.operators.running import dense_index, hash_order

_BLOCK_ROWS = 2048
# Every point is sent once to each block, so blocks grow with the table rather than their number.
_FEW_BLOCKS, _LARGE_BLOCK_ROWS = 16, 32_768
_ROUGH_ROWS, _GROUP = 64, 32


def unit_hash(text: Column) -> Column:
    """A repeatable number in [0, 1) from the first 15 hex digits of an md5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("double") / float(16**15)


def index_hash(text: Column, n: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint") % n


def nearest_neighbours(points: DataFrame, k: int, block_rows: int = _BLOCK_ROWS) -> DataFrame:
    """The k nearest other points of every point by Euclidean distance, exactly: (_i, rank, _j).

    ``points`` has a dense ``_i`` and an array ``_x``. Points are cut into blocks, each pair of
    blocks is compared in one task with array arithmetic that keeps only k candidates per point,
    and candidates are merged. Tasks hold two blocks at a time and no pair of points ever becomes
    a row, whatever the number of points.
    """
    n = points.count()
    blocks = max(1, min(math.ceil(n / block_rows), _FEW_BLOCKS + math.ceil(n / _LARGE_BLOCK_ROWS)))
    # Both sides need the same types: cogroup places keys by their hash and casts nothing.
    others = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    block = (F.col("_i") % blocks).cast("int")
    asking = points.select("_i", "_x", block.alias("_a")).withColumn("_b", others)
    offered = points.select(F.col("_i").alias("_j"), F.col("_x").alias("_y"), block.alias("_b")).withColumn("_a", others)

    def closest_rows(asked: np.ndarray, x: np.ndarray, ids: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """The k nearest rows of ``y`` for each row of ``x``, ties by id: (asked, id, distance).

        One matrix product gives rough squares. All rows within its rounding error of the k-th are measured
        again, coordinate by coordinate, and only those distances decide.
        """
        xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
        rough = xx[:, None] + yy[None, :] - 2.0 * (x @ y.T)
        own = asked[:, None] == ids[None, :]
        rough[own] = np.inf
        # The k-th smallest of the groups' minima is no smaller than the k-th smallest value.
        groups = len(ids) // _GROUP
        least = rough[:, : groups * _GROUP].reshape(len(x), groups, _GROUP).min(axis=2) if groups > k else rough
        place = min(k, least.shape[1]) - 1
        error = 8.0 * (x.shape[1] + 4) * np.finfo(np.float64).eps * (xx + yy.max())
        bound = np.partition(least, place, axis=1)[:, place] + 2.0 * error
        row, column = np.nonzero(~(rough > bound[:, None]) & ~own)  # what is not a number stays for the exact step
        square = np.zeros(len(row))
        for d in range(x.shape[1]):
            step = x[row, d] - y[column, d]
            square += step * step
        distance = np.sqrt(square)
        finite = np.isfinite(distance)
        row, column, distance = row[finite], column[finite], distance[finite]
        order = np.lexsort((ids[column], distance, row))
        row, column, distance = row[order], column[order], distance[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        return [asked[row[keep]], ids[column[keep]], distance[keep]]

    def closest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"_i": [], "_j": [], "_d": []}, dtype="float64").astype({"_i": "int64", "_j": "int64"})
        x, y = np.stack(left["_x"].to_numpy()), np.stack(right["_y"].to_numpy())
        asked, ids, out = left["_i"].to_numpy(), right["_j"].to_numpy(), []
        for start in range(0, len(x), _ROUGH_ROWS):
            near = closest_rows(asked[start : start + _ROUGH_ROWS], x[start : start + _ROUGH_ROWS], ids, y)
            out.append(near)
        return pd.DataFrame({name: np.concatenate(parts) for name, parts in zip(("_i", "_j", "_d"), zip(*out))})

    candidates = (
        asking.groupBy("_a", "_b")
        .cogroup(offered.groupBy("_a", "_b"))
        .applyInPandas(closest, "_i long, _j long, _d double")
    )
    order = Window.partitionBy("_i").orderBy("_d", "_j")  # k rows per block
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_d")


def synthetic_minority(
    df: DataFrame, columns: Sequence[str], label: str = LABEL, id_: str = "id", k: int = 5, seed: int = 42
) -> DataFrame:
    """The synthetic rows that balance the classes, with the ids they were made from.

    One synthetic row is made in the place of each majority row in excess, so their number needs no
    counting on the driver. Base point, neighbour and step come from a seeded hash of that place.
    """
    x = F.array(*[F.col(quoted(c)).cast("double") for c in columns])
    digest, bucket = hash_order(id_)
    minority = dense_index(df.where(label).select(id_, x.alias("_x")), [digest, id_], bucket, "_i")
    majority = dense_index(df.where(~F.col(label)).select(id_), [digest, id_], bucket, "_slot")
    size = minority.agg(F.count("*")).scalar()
    # A point has min(k, size - 1) neighbours.
    width = F.least(F.lit(k), size - 1)
    excess = df.agg(F.count_if(~F.col(label)) - F.count_if(F.col(label))).scalar()
    tag = lambda part: F.concat_ws(":", F.lit(str(seed)), F.lit(part), F.col("_slot").cast("string"))
    slots = majority.where(F.col("_slot") < excess).select(
        "_slot",
        index_hash(tag("base"), size).alias("_i"),
        (index_hash(tag("neighbour"), width) + 1).cast("int").alias("rank"),
        unit_hash(tag("step")).alias("step"),
    )
    near = nearest_neighbours(minority.select("_i", "_x"), k)
    base = minority.select("_i", F.col(id_).alias("base_id"), "_x")
    other = minority.select(F.col("_i").alias("_j"), F.col(id_).alias("neighbour_id"), F.col("_x").alias("_y"))
    made = slots.join(near, ["_i", "rank"]).join(base, "_i").join(other, "_j")
    values = {
        name: F.get("_x", F.lit(i)) + F.col("step") * (F.get("_y", F.lit(i)) - F.get("_x", F.lit(i)))
        for i, name in enumerate(columns)
    }
    return made.select("_slot", "base_id", "neighbour_id", "step", *[v.alias(n) for n, v in values.items()])


def oversample(
    df: DataFrame, columns: Sequence[str], label: str = LABEL, id_: str = "id", k: int = 5, seed: int = 42
) -> DataFrame:
    """Original rows plus synthetic positives, with equal class counts; regressors and label only."""
    made = synthetic_minority(df, columns, label, id_, k, seed)
    kept = [quoted(c) for c in columns]
    original = df.select(*[F.col(c).cast("double").alias(n) for c, n in zip(kept, columns)], label)
    return original.unionByName(made.select(*kept, F.lit(True).alias(label)))
