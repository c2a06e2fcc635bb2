"""Model jobs on the panel with Spark's own learners, and their selection by ranking metrics."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.names import CANDIDATE, EVENT_TIME, GROUP, LABEL, SCORE, quoted
from tickspark.operators.inference import describe_runs
from tickspark.operators.oversample import oversample
from tickspark.operators.panel import preprocess, sample_groups, split_by_time
from tickspark.operators.ranking import top_k_percent, top_k_percent_auc

_FEATURES, _TARGET, _WEIGHT = "_features", "_target", "_weight"


def assemble(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add the feature vector and the numeric label."""
    ready = VectorAssembler(inputCols=list(columns), outputCol=_FEATURES, handleInvalid="keep").transform(df)
    return ready.withColumn(_TARGET, F.col(LABEL).cast("double")) if LABEL in df.columns else ready


def with_class_weight(df: DataFrame, positive_weight: float) -> DataFrame:
    return df.withColumn(_WEIGHT, F.when(F.col(LABEL), F.lit(float(positive_weight))).otherwise(F.lit(1.0)))


def with_balanced_weight(df: DataFrame) -> DataFrame:
    """n / (2 * n_class) per row, so both classes weigh the same."""
    counts = df.agg(F.struct(F.count("*").alias("n"), F.count_if(LABEL).alias("p"))).scalar()
    n, p = F.col("_counts.n"), F.col("_counts.p")
    weight = F.when(F.col(LABEL), n / (2 * p)).otherwise(n / (2 * (n - p)))
    return df.withColumn("_counts", counts).withColumn(_WEIGHT, weight).drop("_counts")


@dataclass(frozen=True)
class Scorer:
    """A fitted model: ``score`` adds the ranking score to any table with its columns."""

    columns: tuple[str, ...]
    apply: Callable[[DataFrame], DataFrame]

    def score(self, df: DataFrame) -> DataFrame:
        return self.apply(assemble(df, self.columns)).drop(_FEATURES, _TARGET)


def _probability(model) -> Callable[[DataFrame], DataFrame]:
    def apply(df: DataFrame) -> DataFrame:
        scored = model.transform(df)
        return scored.withColumn(SCORE, vector_to_array("probability")[1]).drop(
            "probability", "rawPrediction", "prediction"
        )

    return apply


# --- Learners --------------------------------------------------------------------------------------


def fit_logistic(
    train: DataFrame, columns: Sequence[str], class_weight: float = 50.0, lam: float = 10.0, max_iter: int = 500
) -> Scorer:
    """L1 logistic regression; ``lam`` = 1/C of the summed-loss objective.

    Spark minimises the weighted mean loss, so the penalty is divided by the total weight.
    """
    data = with_class_weight(train, class_weight)
    total = data.agg(F.sum(_WEIGHT)).first()[0]
    learner = LogisticRegression(
        featuresCol=_FEATURES,
        labelCol=_TARGET,
        weightCol=_WEIGHT,
        elasticNetParam=1.0,
        regParam=lam / total,
        maxIter=max_iter,
        standardization=False,
    )
    return Scorer(tuple(columns), _probability(learner.fit(assemble(data, columns))))


def fit_forest(
    train: DataFrame,
    columns: Sequence[str],
    class_weight: float = 50.0,
    trees: int = 100,
    depth: int = 5,
    feature_share: float = 0.7,
    row_share: float = 0.7,
    seed: int = 42,
) -> Scorer:
    learner = RandomForestClassifier(
        featuresCol=_FEATURES,
        labelCol=_TARGET,
        weightCol=_WEIGHT,
        impurity="gini",
        numTrees=trees,
        maxDepth=depth,
        featureSubsetStrategy=str(feature_share),
        subsamplingRate=row_share,
        seed=seed,
    )
    data = assemble(with_class_weight(train, class_weight), columns)
    return Scorer(tuple(columns), _probability(learner.fit(data)))


def _boosting(iterations: int, depth: int, learning_rate: float, feature_share: float, row_share: float, seed: int):
    return GBTClassifier(
        featuresCol=_FEATURES,
        labelCol=_TARGET,
        weightCol=_WEIGHT,
        maxIter=iterations,
        maxDepth=depth,
        stepSize=learning_rate,
        featureSubsetStrategy=str(feature_share),
        subsamplingRate=row_share,
        seed=seed,
    )


def _running_margins(model, df: DataFrame, length: int) -> tuple[DataFrame, list[str]]:
    """``df`` with a column for each of the first ``length`` trees: the margin up to it, made from the one before."""
    scored, names = df, []
    for i, (tree, weight) in enumerate(zip(model.trees[:length], model.treeWeights[:length])):
        name = f"_tree{i}"
        one = tree.copy().setPredictionCol(name).setFeaturesCol(_FEATURES)
        before = F.col(names[-1]) if names else F.lit(0.0)
        scored = one.transform(scored).withColumn(name, before + F.col(name) * F.lit(float(weight)))
        names.append(name)
    return scored, names


def _margin_probability(margin: Column) -> Column:
    return 1 / (1 + F.exp(-2 * margin))


def prefix_quality(model, validation: DataFrame, metric: str) -> DataFrame:
    """Validation quality after each boosting round (one row per round, higher is better)."""
    margins, names = _running_margins(model, validation, len(model.trees))
    rounds = margins.select(
        GROUP, CANDIDATE, LABEL, _WEIGHT, F.posexplode(F.array(*names)).alias("_round", "_margin")
    ).withColumn("model", F.col("_round") + 1)
    if metric == "topk_auc":
        table = rounds.withColumn(SCORE, _margin_probability(F.col("_margin")))
        return top_k_percent_auc(table, keys=["model"]).withColumnRenamed("topk_percent_auc", "quality")
    if metric != "logloss":
        raise ValueError(f"unknown metric {metric!r}")
    sign = F.when(F.col(LABEL), 1.0).otherwise(-1.0)
    loss = F.log1p(F.exp(-2 * sign * F.col("_margin")))
    return rounds.groupBy("model").agg((-F.sum(loss * F.col(_WEIGHT)) / F.sum(_WEIGHT)).alias("quality"))


def best_round(quality: Sequence[tuple[int, float]], patience: int = 50) -> int:
    """First best round, stopping once ``patience`` rounds pass without a new best."""
    best, best_value = 1, float("-inf")
    for round_, value in sorted(quality):
        if value > best_value:
            best, best_value = round_, value
        elif round_ - best >= patience:
            break
    return best


def fit_boosted(
    train: DataFrame,
    columns: Sequence[str],
    validation: DataFrame | None = None,
    metric: str = "logloss",
    balanced: bool = True,
    iterations: int = 100,
    depth: int = 5,
    learning_rate: float = 0.1,
    feature_share: float = 0.8,
    row_share: float = 0.8,
    patience: int = 50,
    seed: int = 42,
) -> Scorer:
    """Boosted trees; with ``validation`` the model is cut at its best round by ``metric``.

    ``metric`` is ``logloss`` or ``topk_auc``. All rounds are fitted once and judged from per-tree
    margins, one row per round reaching the driver.
    """
    weigh = with_balanced_weight if balanced else (lambda df: with_class_weight(df, 1.0))
    learner = _boosting(iterations, depth, learning_rate, feature_share, row_share, seed)
    model = learner.fit(assemble(weigh(train), columns))
    length = len(model.trees)
    if validation is not None:
        judged = prefix_quality(model, assemble(weigh(validation), columns), metric)
        length = best_round([(row["model"], row["quality"]) for row in judged.collect()], patience)

    def apply(df: DataFrame) -> DataFrame:
        scored, names = _running_margins(model, df, length)
        return scored.withColumn(SCORE, _margin_probability(F.col(names[-1]))).drop(*names)

    return Scorer(tuple(columns), apply)


def fit_oversampled(train: DataFrame, columns: Sequence[str], id_: str, **boosting: Any) -> Scorer:
    """Boosted trees on a train set balanced with synthetic positives, without class weights."""
    return fit_boosted(oversample(train, columns, id_=id_), columns, balanced=False, **boosting)


def preference_pairs(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Feature differences of each group's positive and its other rows, in both directions.

    A group has one positive, so this is one pair per row and not all pairs of the group.
    """
    vector = F.array(*[F.col(quoted(c)).cast("double") for c in columns])
    rows = train.select(GROUP, LABEL, vector.alias("_x"))
    positives = rows.where(LABEL).groupBy(GROUP).agg(F.min("_x").alias("_p"))
    pairs = rows.where(~F.col(LABEL)).join(positives, GROUP)
    forward = pairs.withColumn("_sign", F.explode(F.array(F.lit(1.0), F.lit(-1.0))))
    difference = F.zip_with("_p", "_x", lambda p, x: p - x)
    signed = F.transform(difference, lambda d: d * F.col("_sign"))
    return forward.select(array_to_vector(signed).alias(_FEATURES), ((F.col("_sign") + 1) / 2).alias(_TARGET))


def fit_ranker(train: DataFrame, columns: Sequence[str], reg: float = 0.01, max_iter: int = 200) -> Scorer:
    """Pairwise logistic ranker: learn to score a group's positive above its other rows."""
    learner = LogisticRegression(
        featuresCol=_FEATURES, labelCol=_TARGET, fitIntercept=False, regParam=reg, maxIter=max_iter
    )
    weights = [float(w) for w in learner.fit(preference_pairs(train, columns)).coefficients]

    def apply(df: DataFrame) -> DataFrame:
        terms = [F.col(quoted(c)) * F.lit(w) for c, w in zip(columns, weights)]
        return df.withColumn(SCORE, reduce(lambda a, b: a + b, terms))

    return Scorer(tuple(columns), apply)


# --- Datasets, sweeps and robustness -----------------------------------------------------------------


def build_datasets(panel: DataFrame, slugs: Sequence[str], variant: str = "default", boundaries=None, **options):
    """Preprocess by model family and add the ``split`` column."""
    prepared = preprocess(panel, slugs, variant, **options)
    return split_by_time(prepared) if boundaries is None else split_by_time(prepared, boundaries)


def evaluation(scorer: Scorer, data: DataFrame) -> DataFrame:
    """Scored table of ``data`` ready for the ranking metrics."""
    extra = [c for c in (EVENT_TIME,) if c in data.columns]
    return scorer.score(data).select(GROUP, CANDIDATE, LABEL, SCORE, *extra)


def parameter_sweep(
    fit: Callable[..., Scorer],
    train: DataFrame,
    validation: DataFrame,
    columns: Sequence[str],
    grid: Sequence[Mapping[str, Any]],
) -> tuple[list[dict], dict]:
    """Fit every parameter set on ``train``, score it on ``validation`` by Top@K%-AUC, name the best.

    Each fit is a distributed job; the loop only walks the handful of parameter sets.
    """
    trials = []
    for number, params in enumerate(grid):
        scorer = fit(train, columns, **params)
        value = top_k_percent_auc(evaluation(scorer, validation)).first()["topk_percent_auc"]
        trials.append({"trial": number, **params, "topk_percent_auc": value})
    return trials, max(trials, key=lambda t: (t["topk_percent_auc"], -t["trial"]))


def subset_robustness(
    fit: Callable[[DataFrame], Scorer],
    train: DataFrame,
    test: DataFrame,
    fraction: float,
    runs: int,
    base_seed: int = 42,
    bins: Sequence[float] = (0.01, 0.02, 0.05, 0.1, 0.2),
) -> DataFrame:
    """Refit on random subsets of whole train groups and measure on the fixed test set, one row per run."""
    if runs < 1:
        raise ValueError(f"runs must be >= 1, got {runs}")

    def sizes(df: DataFrame, prefix: str) -> DataFrame:
        grouped = df.groupBy(GROUP).agg(F.count("*").alias("n"))
        return grouped.agg(F.sum("n").alias(f"{prefix}_rows"), F.count("*").alias(f"{prefix}_cross_sections"))

    results = []
    for run in range(runs):
        seed = base_seed + run
        subset = sample_groups(train, fraction, seed)
        scored = evaluation(fit(subset), test)
        wide = [F.max(F.when(F.col("share") == float(b), F.col("value"))).alias(f"topk_percent@{b:g}") for b in bins]
        tables = [
            sizes(subset, "train"),
            sizes(test, "test"),
            top_k_percent_auc(scored),
            top_k_percent(scored, bins).agg(*wide),
        ]
        tagged = [t.withColumn("run_idx", F.lit(run)) for t in tables]
        row = reduce(lambda a, b: a.join(b, "run_idx"), tagged)
        results.append(row.withColumns({"seed": F.lit(seed), "subset_fraction": F.lit(float(fraction))}))
    return reduce(DataFrame.unionByName, results)


def summarise_robustness(results: DataFrame) -> DataFrame:
    return describe_runs(results)
