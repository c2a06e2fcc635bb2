"""Plans for ranking metrics and inference."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.names import CANDIDATE, GROUP, SCORE
from tickspark.operators import inference, ranking
from tickspark.plans import fixtures as fx
from tickspark.plans.registry import plan, r, rounded, with_sql
from tickspark.plans.sql import SCORED

REPLICATES = 1000
SEED = 42


def scored_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.scored(spark, sf_dir).withColumn(SCORE, F.col("score_b"))


def two_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.stack_models({"a": fx.scored(spark, sf_dir), "b": scored_b(spark, sf_dir)})


def _ranked(score: str = "score", source: str = "scored") -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY pump_hash ORDER BY {score} DESC NULLS LAST, currency_pair) AS rank FROM {source}"""


def _ranks(name: str = "ranks", score: str = "score", source: str = "scored") -> tuple[str, str]:
    return (
        name,
        f"""SELECT pump_hash, count(*) AS n, count(*) FILTER (WHERE is_pumped) AS positives, min(rank) FILTER (WHERE is_pumped) AS best_rank
        FROM ({_ranked(score, source)}) GROUP BY pump_hash""",
    )


_BOTH = (
    "both_models",
    """SELECT 'a' AS model, pump_hash, currency_pair, is_pumped, score FROM scored UNION ALL
    SELECT 'b', pump_hash, currency_pair, is_pumped, score_b FROM scored""",
)
_MODEL_RANKS = (
    "ranks",
    """SELECT model, pump_hash, count(*) AS n, count(*) FILTER (WHERE is_pumped) AS positives, min(rank) FILTER (WHERE is_pumped) AS best_rank FROM
    (SELECT *, row_number() OVER (PARTITION BY model, pump_hash ORDER BY score DESC NULLS LAST, currency_pair) AS rank FROM both_models) GROUP BY model, pump_hash""",
)


def _doubles(values) -> str:
    return "unnest([" + ", ".join(f"CAST('{float(v)!r}' AS DOUBLE)" for v in values) + "])"


def _hit(k: str) -> str:
    return f"CASE WHEN best_rank <= {k} THEN 1.0 ELSE 0.0 END"


_SHARE_HIT = _hit("ceil(n * share)")
_GRID = ("grid", "SELECT i, CAST(i AS DOUBLE) * CAST(0.005 AS DOUBLE) AS share FROM range(41) t(i)")


def _area_sql(keys: str, name: str = "areas", ranks: str = "ranks") -> tuple[str, str]:
    """Trapezoid over the 41-point grid of each group's hit curve, normalised by 0.20."""
    return (
        name,
        f"""SELECT {keys}, max(positives) AS positives, sum((hit + previous) / 2 * (share - previous_share)) / 0.20 AS area FROM
        (SELECT *, lag(hit, 1, hit) OVER w AS previous, lag(share, 1, share) OVER w AS previous_share FROM
          (SELECT {keys}, positives, i, share, {_SHARE_HIT} AS hit FROM {ranks}, grid)
         WINDOW w AS (PARTITION BY {keys} ORDER BY i)) GROUP BY {keys}""",
    )


# --- Point metrics -----------------------------------------------------------------------------------


@plan("w08_w09_best_positive_rank", with_sql(SCORED, _ranks(), select="SELECT * FROM ranks"))
def best_positive_rank(spark, sf_dir):
    return ranking.group_ranks(fx.scored(spark, sf_dir))


@plan(
    "m01_top_k",
    with_sql(
        SCORED,
        _ranks(),
        ("bins", "SELECT unnest([1, 2, 3, 5, 10, 20, 30]) AS k"),
        select=f"SELECT k, {r('sum(' + _hit('k') + ') / sum(positives)', 'value')} FROM ranks, bins GROUP BY k",
    ),
)
def top_k(spark, sf_dir):
    return rounded(ranking.top_k(fx.scored(spark, sf_dir)))


@plan(
    "m02_top_k_percent",
    with_sql(
        SCORED,
        _ranks(),
        ("bins", f"SELECT {_doubles(ranking.TOPK_PERCENT_BINS)} AS share"),
        select=f"SELECT share, {r('sum(' + _SHARE_HIT + ') / sum(positives)', 'value')} FROM ranks, bins GROUP BY share",
    ),
)
def top_k_percent(spark, sf_dir):
    return rounded(ranking.top_k_percent(fx.scored(spark, sf_dir)), exact=("share",))


@plan(
    "m03_m04_top_k_percent_auc",
    with_sql(
        SCORED,
        _ranks(),
        _GRID,
        ("curve", f"SELECT i, share, sum({_SHARE_HIT}) / sum(positives) AS v FROM ranks, grid GROUP BY i, share"),
        select=f"""SELECT {r('sum((v + previous) / 2 * (share - previous_share)) / 0.20', 'topk_percent_auc')} FROM
        (SELECT *, lag(v) OVER (ORDER BY i) AS previous, lag(share) OVER (ORDER BY i) AS previous_share FROM curve) WHERE previous IS NOT NULL""",
    ),
)
def top_k_percent_auc(spark, sf_dir):
    return rounded(ranking.top_k_percent_auc(fx.scored(spark, sf_dir)))


@plan(
    "a31_random_baseline",
    with_sql(
        SCORED,
        _ranks(),
        ("bins", "SELECT unnest([1, 2, 3, 5, 10, 20, 30]) AS k"),
        select=f"SELECT k, {r('avg(k / n)', 'value')} FROM ranks, bins GROUP BY k",
    ),
)
def random_baseline(spark, sf_dir):
    return rounded(ranking.random_top_k(fx.scored(spark, sf_dir)))


def _predicted(rule: str) -> tuple[str, str]:
    value = "CAST(rank = 1 AS INT)" if rule == "top1_per_cross_section" else "CAST(score >= 0.5 AS INT)"
    return ("predicted", f"SELECT *, {value} AS predicted FROM ({_ranked()})")


@plan(
    "m05_predicted_labels",
    with_sql(SCORED, _predicted("top1_per_cross_section"), select="SELECT pump_hash, currency_pair, predicted FROM predicted"),
)
def predicted_labels(spark, sf_dir):
    return ranking.predicted_labels(fx.scored(spark, sf_dir)).select(
        GROUP, CANDIDATE, F.col("predicted").cast("bigint").alias("predicted")
    )


_CONFUSION = ("counts", """SELECT count(*) FILTER (WHERE predicted = 1 AND is_pumped) AS tp, count(*) FILTER (WHERE predicted = 1 AND NOT is_pumped) AS fp,
    count(*) FILTER (WHERE predicted = 0 AND is_pumped) AS fn, count(*) FILTER (WHERE predicted = 0 AND NOT is_pumped) AS tn FROM predicted""")
_CONFUSION_SELECT = f"""SELECT tp, fp, fn, tn, {r('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)', 'f1')},
{r('(tp / (tp + fn) + tn / (tn + fp)) / 2', 'balanced_accuracy')} FROM counts"""


@plan("m06_m07_top1_classification", with_sql(SCORED, _predicted("top1_per_cross_section"), _CONFUSION, select=_CONFUSION_SELECT))
def top1_classification(spark, sf_dir):
    return rounded(ranking.classification_table(fx.scored(spark, sf_dir)))


@plan("m06_m07_threshold_classification", with_sql(SCORED, _predicted("threshold"), _CONFUSION, select=_CONFUSION_SELECT))
def threshold_classification(spark, sf_dir):
    return rounded(ranking.classification_table(fx.scored(spark, sf_dir), "threshold", 0.5))


_CURVE = ("curve", """SELECT score, tp / flagged AS precision, tp / sum(tp0) OVER () AS recall FROM
    (SELECT score, tp0, sum(tp0) OVER w AS tp, sum(n0) OVER w AS flagged FROM
      (SELECT score, count(*) FILTER (WHERE is_pumped) AS tp0, count(*) AS n0 FROM scored GROUP BY score) WINDOW w AS (ORDER BY score DESC))""")


@plan("m09_precision_recall_curve", with_sql(SCORED, _CURVE, select=f"SELECT score, {r('precision', 'precision')}, {r('recall', 'recall')} FROM curve"))
def precision_recall_curve(spark, sf_dir):
    curve = ranking.precision_recall_curve(fx.scored(spark, sf_dir))
    return rounded(curve.select(SCORE, "precision", "recall"), exact=(SCORE,))


@plan(
    "m08_pr_auc",
    with_sql(
        SCORED,
        _CURVE,
        select=f"""SELECT {r('sum((recall - r0) * (precision + p0) / 2)', 'pr_auc')} FROM
        (SELECT *, lag(recall, 1, 0) OVER (ORDER BY score DESC) AS r0, lag(precision, 1, 1) OVER (ORDER BY score DESC) AS p0 FROM curve)""",
    ),
)
def pr_auc(spark, sf_dir):
    return rounded(ranking.pr_auc(fx.scored(spark, sf_dir)))


@plan(
    "m10_model_comparison",
    with_sql(
        SCORED,
        _BOTH,
        _MODEL_RANKS,
        ("bins", "SELECT unnest([1, 2, 3, 5, 10, 20, 30]) AS k"),
        ("t", f"SELECT model, k, sum({_hit('k')}) / sum(positives) AS value FROM ranks, bins GROUP BY model, k"),
        select=f"""SELECT k, {r("max(value) FILTER (WHERE model = 'a')", 'a')}, {r("max(value) FILTER (WHERE model = 'b')", 'b')} FROM t GROUP BY k""",
    ),
)
def model_comparison(spark, sf_dir):
    table = ranking.top_k(two_models(spark, sf_dir), keys=["model"])
    return rounded(ranking.model_columns(table, "k", ["a", "b"]))


@plan(
    "m10_model_curves",
    with_sql(
        SCORED,
        _BOTH,
        _MODEL_RANKS,
        ("bins", f"SELECT {_doubles(ranking.curve_bins())} AS share"),
        _GRID,
        _area_sql("model, pump_hash"),
        ("auc", "SELECT model, sum(area) / sum(positives) AS auc FROM areas GROUP BY model"),
        ("curves", f"SELECT model, share, sum({_SHARE_HIT}) / sum(positives) AS value FROM ranks, bins GROUP BY model, share"),
        select=f"SELECT c.model, c.share, {r('c.value', 'value')}, {r('a.auc', 'topk_percent_auc')} FROM curves c JOIN auc a ON c.model = a.model",
    ),
)
def model_curves(spark, sf_dir):
    both = two_models(spark, sf_dir)
    curves = ranking.top_k_percent(both, ranking.curve_bins(), ["model"])
    return rounded(curves.join(ranking.top_k_percent_auc(both, keys=["model"]), "model"), exact=("share",))


_MODEL_CONFUSION = (
    "counts",
    """SELECT model, count(*) FILTER (WHERE rank = 1 AND is_pumped) AS tp, count(*) FILTER (WHERE rank = 1 AND NOT is_pumped) AS fp,
    count(*) FILTER (WHERE rank > 1 AND is_pumped) AS fn, count(*) FILTER (WHERE rank > 1 AND NOT is_pumped) AS tn FROM
    (SELECT *, row_number() OVER (PARTITION BY model, pump_hash ORDER BY score DESC NULLS LAST, currency_pair) AS rank FROM both_models) GROUP BY model""",
)
_MODEL_CURVE = (
    "curve",
    """SELECT model, score, tp / flagged AS precision, tp / sum(tp0) OVER (PARTITION BY model) AS recall FROM
    (SELECT model, score, tp0, sum(tp0) OVER w AS tp, sum(n0) OVER w AS flagged FROM
      (SELECT model, score, count(*) FILTER (WHERE is_pumped) AS tp0, count(*) AS n0 FROM both_models GROUP BY model, score)
     WINDOW w AS (PARTITION BY model ORDER BY score DESC))""",
)


@plan(
    "m10_classification_table",
    with_sql(
        SCORED,
        _BOTH,
        _MODEL_CONFUSION,
        _MODEL_CURVE,
        (
            "pr",
            """SELECT model, sum((recall - r0) * (precision + p0) / 2) AS pr_auc FROM
            (SELECT *, lag(recall, 1, 0) OVER (PARTITION BY model ORDER BY score DESC) AS r0,
             lag(precision, 1, 1) OVER (PARTITION BY model ORDER BY score DESC) AS p0 FROM curve) GROUP BY model""",
        ),
        select=f"""SELECT c.model, {r('p.pr_auc', 'pr_auc')}, {r('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)', 'f1')},
        {r('(tp / (tp + fn) + tn / (tn + fp)) / 2', 'balanced_accuracy')} FROM counts c JOIN pr p ON c.model = p.model""",
    ),
)
def classification_table(spark, sf_dir):
    both = two_models(spark, sf_dir)
    table = ranking.classification_table(both, keys=["model"]).select("model", "f1", "balanced_accuracy")
    return rounded(ranking.pr_auc(both, ["model"]).join(table, "model"))


@plan("m11_score_table", with_sql(SCORED, select="SELECT pump_hash, currency_pair, is_pumped, round(score * 2, 3) + 0.0 AS score FROM scored"))
def score_table(spark, sf_dir):
    return ranking.score_table(fx.scored(spark, sf_dir), F.round(F.col(SCORE) * 2, 3) + F.lit(0.0))


# --- Indicators and bootstrap ------------------------------------------------------------------------

_K_BINS = (1, 2, 5)
_SHARE_BINS = (0.05, 0.1, 0.2, 0.5)


@plan(
    "m12_top_k_indicators",
    with_sql(SCORED, _ranks(), ("bins", "SELECT unnest([1, 2, 5]) AS k"), select=f"SELECT pump_hash, k, {_hit('k')}::DOUBLE AS hit FROM ranks, bins"),
)
def top_k_indicators(spark, sf_dir):
    return inference.top_k_indicators(fx.scored(spark, sf_dir), _K_BINS).withColumn("k", F.col("k").cast("bigint"))


@plan(
    "m12_top_k_percent_indicators",
    with_sql(SCORED, _ranks(), ("bins", f"SELECT {_doubles(_SHARE_BINS)} AS share"), select=f"SELECT pump_hash, share, {_SHARE_HIT}::DOUBLE AS hit FROM ranks, bins"),
)
def top_k_percent_indicators(spark, sf_dir):
    return inference.top_k_percent_indicators(fx.scored(spark, sf_dir), _SHARE_BINS)


def _draws(value_table: str, values: str, replicates: int = REPLICATES, seed: int = SEED) -> list[tuple[str, str]]:
    """CTE ``means``: the mean of each value over every replicate's draws."""
    return [
        ("indexed", f"SELECT *, row_number() OVER (ORDER BY md5(pump_hash), pump_hash) - 1 AS i, count(*) OVER () AS n FROM {value_table}"),
        (
            "draws",
            f"""SELECT b AS replicate, ('0x' || substr(md5(concat_ws(':', '{seed}', b, i)), 1, 15))::BIGINT % n AS i
            FROM indexed, range({replicates}) t(b)""",
        ),
        ("means", f"SELECT d.replicate, {values} FROM draws d JOIN indexed x ON d.i = x.i GROUP BY d.replicate"),
    ]


def _summary(value: str) -> str:
    return ", ".join(
        [
            r(f"avg({value})", "mean_bootstrap"),
            r(f"stddev_samp({value})", "std_bootstrap"),
            r(f"quantile_cont({value}, 0.025)", "ci_lower"),
            r(f"quantile_cont({value}, 0.975)", "ci_upper"),
        ]
    )


def _curve_ci(bins, hit, name: str, type_: str) -> str:
    values = ", ".join(f"{hit(b)} AS h{i}" for i, b in enumerate(bins))
    means = ", ".join(f"avg(h{i}) AS h{i}" for i in range(len(bins)))
    literal = (lambda b: f"CAST({b} AS BIGINT)") if type_ == "int" else (lambda b: f"CAST('{float(b)!r}' AS DOUBLE)")
    long = " UNION ALL ".join(f"SELECT {literal(b)} AS bin, h{i} AS v FROM means" for i, b in enumerate(bins))
    points = " UNION ALL ".join(f"SELECT {literal(b)} AS bin, avg(h{i}) AS point FROM hits" for i, b in enumerate(bins))
    return with_sql(
        SCORED,
        _ranks(),
        ("hits", f"SELECT pump_hash, {values} FROM ranks"),
        *_draws("hits", means),
        ("long", long),
        ("points", points),
        select=f"""SELECT l.bin AS {name}, {r('max(p.point)', 'point_estimate')}, {_summary('l.v')}, {REPLICATES} AS n_bootstrap,
        CAST(0.05 AS DOUBLE) AS alpha FROM long l JOIN points p ON l.bin = p.bin GROUP BY l.bin""",
    )


@plan("m13_bootstrap_top_k", _curve_ci(_K_BINS, lambda k: _hit(str(k)), "k", "int"))
def bootstrap_top_k(spark, sf_dir):
    return rounded(inference.bootstrap_top_k(fx.scored(spark, sf_dir), _K_BINS, REPLICATES, seed=SEED))


@plan(
    "m13_bootstrap_top_k_percent",
    _curve_ci(_SHARE_BINS, lambda s: _hit(f"ceil(n * CAST('{s!r}' AS DOUBLE))"), "share", "double"),
)
def bootstrap_top_k_percent(spark, sf_dir):
    ci = inference.bootstrap_top_k_percent(fx.scored(spark, sf_dir), _SHARE_BINS, REPLICATES, seed=SEED)
    return rounded(ci, exact=("share", "alpha"))


@plan(
    "m14_bootstrap_auc",
    with_sql(
        SCORED,
        _ranks(),
        _GRID,
        _area_sql("pump_hash"),
        *_draws("areas", "avg(area) AS area"),
        select=f"""SELECT 'topk_percent_auc' AS metric, {r('(SELECT avg(area) FROM areas)', 'point_estimate')}, {_summary('area')},
        {REPLICATES} AS n_bootstrap, CAST(0.05 AS DOUBLE) AS alpha FROM means""",
    ),
)
def bootstrap_auc(spark, sf_dir):
    return rounded(inference.bootstrap_auc(fx.scored(spark, sf_dir), replicates=REPLICATES, seed=SEED))


def _paired_sql(alternative: str) -> str:
    at_most, at_least = "avg(CAST(round(diff, 12) <= 0 AS INT))", "avg(CAST(round(diff, 12) >= 0 AS INT))"
    p_value = {"greater": at_most, "less": at_least, "two-sided": f"least(1.0, 2 * least({at_most}, {at_least}))"}[alternative]
    return with_sql(
        SCORED,
        _ranks("ranks_a", "score"),
        _ranks("ranks_b", "score_b"),
        _GRID,
        _area_sql("pump_hash", "areas_a", "ranks_a"),
        _area_sql("pump_hash", "areas_b", "ranks_b"),
        ("diffs", "SELECT a.pump_hash, a.area - b.area AS diff FROM areas_a a JOIN areas_b b ON a.pump_hash = b.pump_hash"),
        *_draws("diffs", "avg(diff) AS diff"),
        select=f"""SELECT 'topk_percent_auc' AS metric, {r('(SELECT avg(diff) FROM diffs)', 'observed_diff')}, {r('avg(diff)', 'mean_diff_bootstrap')},
        {r('quantile_cont(diff, 0.025)', 'ci_lower')}, {r('quantile_cont(diff, 0.975)', 'ci_upper')}, {r(p_value, 'p_value')},
        '{alternative}' AS alternative, {REPLICATES} AS n_bootstrap, CAST(0.05 AS DOUBLE) AS alpha FROM means""",
    )


def _register_paired(name: str, alternative: str) -> None:
    @plan(name, _paired_sql(alternative))
    def paired_auc_test(spark, sf_dir, alternative=alternative):
        tested = inference.paired_auc_test(
            fx.scored(spark, sf_dir), scored_b(spark, sf_dir), replicates=REPLICATES, seed=SEED, alternative=alternative
        )
        return rounded(tested)


_register_paired("m15_paired_auc_test", "two-sided")
_register_paired("m15_paired_auc_greater", "greater")
_register_paired("m15_paired_auc_less", "less")


@plan(
    "j08_group_alignment",
    with_sql(
        SCORED,
        ("a", "SELECT DISTINCT pump_hash FROM scored WHERE score > 0.9"),
        ("b", "SELECT DISTINCT pump_hash FROM scored WHERE score_b > 0.9"),
        select="""SELECT (SELECT count(*) FROM b WHERE pump_hash NOT IN (SELECT pump_hash FROM a)) AS missing_in_a,
        (SELECT count(*) FROM a WHERE pump_hash NOT IN (SELECT pump_hash FROM b)) AS missing_in_b""",
    ),
)
def group_alignment(spark, sf_dir):
    scored = fx.scored(spark, sf_dir)
    return inference.alignment(scored.where("score > 0.9"), scored.where("score_b > 0.9"))


# --- Robustness ----------------------------------------------------------------------------------------


@plan(
    "a32_describe_runs",
    with_sql(
        SCORED,
        _ranks(),
        ("runs", "SELECT 'topk_percent@0.1' AS metric, n * 0.1 AS v FROM ranks UNION ALL SELECT 'topk_percent_auc', CAST(best_rank AS DOUBLE) / n FROM ranks"),
        select=f"""SELECT metric, count(v) AS "count", {r('avg(v)', 'mean')}, {r('stddev_samp(v)', 'std')}, {r('min(v)', 'min')},
        {', '.join(r(f'quantile_cont(v, {p / 100})', f'p{p}') for p in (10, 25, 50, 75, 90))}, {r('max(v)', 'max')} FROM runs GROUP BY metric""",
    ),
)
def describe_runs(spark, sf_dir):
    ranks = ranking.group_ranks(fx.scored(spark, sf_dir))
    runs = ranks.select(
        (F.col("n") * 0.1).alias("topk_percent@0.1"), (F.col("best_rank") / F.col("n")).alias("topk_percent_auc")
    )
    return rounded(inference.describe_runs(runs))


_PERIODS = ("periods", """SELECT s.*, CASE WHEN f.first <= TIMESTAMP '2024-01-14 12:00:00' THEN 'early' ELSE 'late' END AS subperiod
    FROM scored s JOIN (SELECT pump_hash, min(pump_time) AS first FROM scored GROUP BY pump_hash) f ON s.pump_hash = f.pump_hash""")
_PERIOD_RANKS = (
    "ranks",
    """SELECT subperiod, pump_hash, count(*) AS n, count(*) FILTER (WHERE is_pumped) AS positives, min(rank) FILTER (WHERE is_pumped) AS best_rank FROM
    (SELECT *, row_number() OVER (PARTITION BY pump_hash ORDER BY score DESC NULLS LAST, currency_pair) AS rank FROM periods) GROUP BY 1, 2""",
)
_PERIOD_BINS = (0.01, 0.02, 0.05, 0.1, 0.2)


@plan(
    "m18_subperiod_metrics",
    with_sql(
        SCORED,
        _PERIODS,
        _PERIOD_RANKS,
        _GRID,
        _area_sql("subperiod, pump_hash"),
        ("auc", "SELECT subperiod, sum(area) / sum(positives) AS auc FROM areas GROUP BY subperiod"),
        select=f"""SELECT x.subperiod, count(*) AS n_pumps, sum(n)::BIGINT AS n_rows, {r('max(a.auc)', 'topk_percent_auc')},
        {', '.join(r(f"sum({_hit(f'ceil(n * CAST({b!r} AS DOUBLE))')}) / sum(positives)", f'topk_percent@{b:g}') for b in _PERIOD_BINS)}
        FROM ranks x JOIN auc a ON x.subperiod = a.subperiod GROUP BY x.subperiod HAVING count(*) >= 10""",
    ),
)
def subperiod_metrics(spark, sf_dir):
    split = datetime(2024, 1, 14, 12).isoformat(sep=" ")
    return rounded(inference.subperiod_metrics(fx.scored(spark, sf_dir), split, _PERIOD_BINS))
