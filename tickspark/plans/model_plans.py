"""Plans for oversampling and model jobs.

The embeddings table serves as a second panel: vectors are candidates, hash buckets of their ids are
cross-sections, and one vector per bucket is the positive.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.names import CANDIDATE, GROUP, LABEL, SCORE
from tickspark.operators import inference, models, oversample, panel, ranking
from tickspark.plans import fixtures as fx
from tickspark.plans.registry import plan, r, rounded, with_sql
from tickspark.session import materialise

DIMENSIONS = 64
COLUMNS = [f"x{i}" for i in range(DIMENSIONS)]
# Vectors per cross-section; their number grows with the table.
_PER_GROUP = 10


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = [F.get("embedding", F.lit(i)).cast("double").alias(name) for i, name in enumerate(COLUMNS)]
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", "label", *values)


def vector_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of neighbouring ids with one positive each: the vector leaning furthest along a fixed direction.

    Groups fall into TRAIN, VALIDATION and TEST by their number.
    """
    lean = sum((F.col(c) for c in COLUMNS[:8]), F.lit(0.0))
    numbered = vectors(spark, sf_dir).withColumns({"_g": F.floor(F.col("vec_id") / _PER_GROUP), "_lean": lean})
    best = numbered.groupBy("_g").agg(F.max_by("vec_id", F.struct("_lean", "vec_id")).alias("_best"))
    part = F.col("_g") % 5
    split = F.when(part < 3, "TRAIN").when(part == 3, "VALIDATION").otherwise("TEST")
    rows = numbered.join(best, "_g").select(
        F.col("_g").cast("string").alias(GROUP),
        F.col("vec_id").cast("string").alias(CANDIDATE),
        (F.col("vec_id") == F.col("_best")).alias(LABEL),
        split.alias("split"),
        *COLUMNS,
    )
    return materialise(rows, "vectors")


def splits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = vector_panel(spark, sf_dir)
    return tuple(rows.where(F.col("split") == name) for name in ("TRAIN", "VALIDATION", "TEST"))


def report(scorer: models.Scorer, test: DataFrame) -> DataFrame:
    return rounded(ranking.top_k(models.evaluation(scorer, test)))


# --- Oversampling ------------------------------------------------------------------------------------

_COORDS = "CAST(embedding AS DOUBLE[])"


@plan(
    "u06_nearest_neighbours",
    with_sql(
        ("points", f"SELECT vec_id, {_COORDS} AS x FROM embeddings"),
        (
            "pairs",
            """SELECT a.vec_id, b.vec_id AS neighbour, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x), b.i) AS rank
            FROM points a JOIN (SELECT *, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) AS i FROM points) b ON a.vec_id <> b.vec_id""",
        ),
        select="SELECT vec_id, rank, neighbour FROM pairs WHERE rank <= 5",
    ),
)
def nearest_neighbours(spark, sf_dir):
    """Exact five nearest vectors of every vector, in blocks."""
    points = fx.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("_x"))
    digest, bucket = panel.hash_order("vec_id")
    indexed = materialise(panel.dense_index(points, [digest, "vec_id"], bucket, "_i"), "points")
    near = oversample.nearest_neighbours(indexed.select("_i", "_x"), 5, block_rows=256)
    ids = indexed.select("_i", "vec_id")
    other = ids.select(F.col("_i").alias("_j"), F.col("vec_id").alias("neighbour"))
    return near.join(ids, "_i").join(other, "_j").select("vec_id", F.col("rank").cast("bigint"), "neighbour")


_SYNTHETIC = with_sql(
    ("points", f"SELECT vec_id, label < 3 AS positive, {_COORDS} AS x FROM embeddings"),
    ("minority", "SELECT vec_id, x, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1 AS i FROM points WHERE positive"),
    ("majority", "SELECT vec_id, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1 AS slot FROM points WHERE NOT positive"),
    ("sizes", "SELECT (SELECT count(*) FROM minority) AS p, (SELECT count(*) FROM majority) AS n"),
    (
        "slots",
        """SELECT slot, ('0x' || substr(md5(concat_ws(':', '42', 'base', slot)), 1, 15))::BIGINT % p AS i,
        ('0x' || substr(md5(concat_ws(':', '42', 'neighbour', slot)), 1, 15))::BIGINT % 5 + 1 AS rank,
        ('0x' || substr(md5(concat_ws(':', '42', 'step', slot)), 1, 15))::BIGINT::DOUBLE / 1152921504606846976.0 AS step
        FROM majority, sizes WHERE slot < n - p""",
    ),
    ("near", "SELECT a.i, b.i AS j, row_number() OVER (PARTITION BY a.i ORDER BY list_distance(a.x, b.x), b.i) AS rank FROM minority a JOIN minority b ON a.i <> b.i"),
    select=f"""SELECT s.slot, a.vec_id AS base_id, b.vec_id AS neighbour_id, {r('s.step', 'step')},
    {', '.join(r(f'a.x[{i + 1}] + s.step * (b.x[{i + 1}] - a.x[{i + 1}])', c) for i, c in enumerate(COLUMNS))}
    FROM slots s JOIN near k ON k.i = s.i AND k.rank = s.rank JOIN minority a ON a.i = k.i JOIN minority b ON b.i = k.j""",
)


@plan("u06_synthetic_minority", _SYNTHETIC)
def synthetic_minority(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn(LABEL, F.col("label") < 3)
    made = oversample.synthetic_minority(rows, COLUMNS, id_="vec_id")
    return rounded(made.select(F.col("_slot").alias("slot"), "base_id", "neighbour_id", "step", *COLUMNS))


@plan(
    "u06_balanced_classes",
    """SELECT label < 3 AS is_pumped, greatest((SELECT count(*) FROM embeddings WHERE label < 3), (SELECT count(*) FROM embeddings WHERE label >= 3)) AS n
    FROM embeddings GROUP BY 1""",
)
def balanced_classes(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn(LABEL, F.col("label") < 3)
    return oversample.oversample(rows, COLUMNS, id_="vec_id").groupBy(LABEL).agg(F.count("*").alias("n"))


# --- Learners ----------------------------------------------------------------------------------------


@plan("l02_dataset_splits")
def dataset_splits(spark, sf_dir):
    rows = vector_panel(spark, sf_dir)
    return rows.groupBy("split").agg(
        F.countDistinct(GROUP).alias("groups"), F.count("*").alias("rows"), F.count_if(LABEL).alias("positives")
    )


@plan("l03_logistic")
def logistic(spark, sf_dir):
    train, _, test = splits(spark, sf_dir)
    return report(models.fit_logistic(train, COLUMNS, class_weight=10.0, lam=1.0, max_iter=50), test)


@plan("l04_forest")
def forest(spark, sf_dir):
    train, _, test = splits(spark, sf_dir)
    return report(models.fit_forest(train, COLUMNS, class_weight=10.0, trees=20, depth=4), test)


@plan("l05_boosted")
def boosted(spark, sf_dir):
    train, validation, test = splits(spark, sf_dir)
    return report(models.fit_boosted(train, COLUMNS, validation, iterations=8, depth=3), test)


@plan("l06_boosted_by_auc")
def boosted_by_auc(spark, sf_dir):
    train, validation, test = splits(spark, sf_dir)
    return report(models.fit_boosted(train, COLUMNS, validation, "topk_auc", iterations=8, depth=3), test)


@plan("l07_oversampled_boosted")
def oversampled_boosted(spark, sf_dir):
    train, _, test = splits(spark, sf_dir)
    return report(models.fit_oversampled(train, COLUMNS, CANDIDATE, iterations=5, depth=3), test)


@plan("l08_pairwise_ranker")
def pairwise_ranker(spark, sf_dir):
    train, _, test = splits(spark, sf_dir)
    return report(models.fit_ranker(train, COLUMNS, max_iter=50), test)


@plan("l09_scores")
def scores(spark, sf_dir):
    train, _, test = splits(spark, sf_dir)
    scored = models.evaluation(models.fit_logistic(train, COLUMNS, 10.0, 1.0, 50), test)
    return rounded(scored.select(GROUP, CANDIDATE, SCORE), 4)


@plan("l10_parameter_sweep")
def parameter_sweep(spark, sf_dir):
    train, validation, _ = splits(spark, sf_dir)
    grid = [{"class_weight": w, "lam": lam, "max_iter": 30} for w in (10.0, 50.0) for lam in (0.1, 1.0)]
    trials, best = models.parameter_sweep(models.fit_logistic, train, validation, COLUMNS, grid)
    rows = [(t["trial"], t["class_weight"], t["lam"], t["topk_percent_auc"], t is best) for t in trials]
    schema = "trial INT, class_weight DOUBLE, lam DOUBLE, topk_percent_auc DOUBLE, best BOOLEAN"
    return rounded(spark.createDataFrame(rows, schema))


@plan("m17_subset_robustness")
def subset_robustness(spark, sf_dir):
    train, _, test = splits(spark, sf_dir)
    fit = partial(models.fit_logistic, columns=COLUMNS, class_weight=10.0, lam=1.0, max_iter=30)
    return rounded(models.subset_robustness(fit, train, test, 0.7, 2))


@plan("m17_robustness_summary")
def robustness_summary(spark, sf_dir):
    train, _, test = splits(spark, sf_dir)
    fit = partial(models.fit_ranker, columns=COLUMNS, max_iter=20)
    return rounded(inference.describe_runs(models.subset_robustness(fit, train, test, 0.7, 2)))
