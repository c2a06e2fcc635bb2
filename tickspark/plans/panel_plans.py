"""Plans for event features, the panel and its cleaning."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.names import CANDIDATE, EVENT_TIME, GROUP, LABEL, NUM_PREV, quoted, regressor_columns, standardised_columns
from tickspark.operators import panel as pn
from tickspark.operators import portfolio, ranking
from tickspark.operators.features import FeatureWindows, moment_features, per_event, prior_event_count, slice_totals, slices
from tickspark.plans import fixtures as fx
from tickspark.plans.registry import plan, r, rounded, with_sql
from tickspark.plans.sql import LABELS, SCORED, TICKS, features, interval, orders, panel, panel_windows_ctes
from tickspark.session import materialise, scratch_path
from tickspark.sources import events as event_source
from tickspark.sources import panel_store

SLUGS = fx.PANEL_SLUGS
SUCCESS = "target_return@2D"
RANKED = "target_return@5D"


def stored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event list as a file of its own: the planner sees how small it is, and the events are not read again."""
    return materialise(fx.labels(spark, sf_dir), "labels")


def rounded_features(spark: SparkSession, sf_dir: str, windows: FeatureWindows) -> DataFrame:
    """Features of every (event, symbol); rounded once for each event time, before the events share them."""
    labels = stored_labels(spark, sf_dir)
    return per_event(rounded(moment_features(fx.ticks(spark, sf_dir), labels, windows)), labels)


def panel_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_features(spark, sf_dir, fx.PANEL_WINDOWS)


def stored_features(spark: SparkSession, sf_dir: str, labels: DataFrame) -> DataFrame:
    """Features over stored rows of event times, for what reads them several times."""
    rows = rounded(moment_features(fx.ticks(spark, sf_dir), labels, fx.PANEL_WINDOWS))
    return per_event(materialise(rows, "features"), labels)


def build_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel over stored features: what follows reads them several times."""
    labels = stored_labels(spark, sf_dir)
    return pn.assemble_panel(stored_features(spark, sf_dir, labels), labels)


# --- Features ----------------------------------------------------------------------------------------

_WEEK = FeatureWindows(offsets={"7D": timedelta(days=7)}, decays={}, lookback=timedelta(days=8), horizon=timedelta(0))

_RANKED_BY_FLOW = f"""
SELECT e.pump_hash, o.symbol, o.symbol = e.pumped_currency_pair AS is_pumped,
       row_number() OVER (PARTITION BY e.pump_hash ORDER BY sum(quote_sign) / sum(quote_abs) DESC, o.symbol) AS rank
FROM labelled e JOIN orders o ON o.trade_time BETWEEN e.pump_time - INTERVAL 1 HOUR - {interval('7D')} AND e.pump_time - INTERVAL 1 HOUR
GROUP BY e.pump_hash, e.pumped_currency_pair, o.symbol"""


@plan(
    "flagship_flow_ranking",
    with_sql(
        TICKS,
        LABELS,
        orders(),
        ("ranked", _RANKED_BY_FLOW),
        ("bins", "SELECT unnest([1, 2, 3, 5, 10, 20, 30]) AS k"),
        select=f"""SELECT k, {r("count(*) FILTER (WHERE is_pumped AND rank <= k) / count(*) FILTER (WHERE is_pumped)", "value")}
        FROM ranked, bins GROUP BY k""",
    ),
)
def flow_ranking(spark, sf_dir):
    """Ticks to Top@K in one plan: order flow over seven days ranks each event's active symbols."""
    labels = stored_labels(spark, sf_dir)
    rows = per_event(moment_features(fx.ticks(spark, sf_dir), labels, _WEEK).where("`num_trades@7D` > 0"), labels)
    labelled = rows.join(labels.select(GROUP, "pumped_currency_pair"), GROUP).withColumn(
        LABEL, F.col(CANDIDATE) == F.col("pumped_currency_pair")
    )
    # The metrics read scores twice: stored, they cost one feature build.
    scored = materialise(ranking.score_table(labelled, F.col("`flow_imbalance@7D`")), "scores")
    return rounded(ranking.top_k(scored))


@plan(
    "a14_feature_matrix",
    with_sql(*panel_windows_ctes(), select="SELECT * FROM features"),
)
def feature_matrix(spark, sf_dir):
    return panel_features(spark, sf_dir)


_REFERENCE = FeatureWindows()


@plan(
    "a14_reference_windows",
    with_sql(*panel_windows_ctes(LABELS, _REFERENCE), select="SELECT * FROM features"),
)
def reference_windows(spark, sf_dir):
    """All eighty look-back features, five decay returns and the prior-event count at their usual offsets."""
    return rounded_features(spark, sf_dir, _REFERENCE)


_ZSCORES = [f"{family}@{s}" for family in ("asset_return_zscore", "quote_abs_zscore") for s in SLUGS]


def _quoted_sql(column: str) -> str:
    return f'"{column}"'


_PRE = FeatureWindows(offsets=fx.PANEL_WINDOWS.offsets, decays={}, horizon=timedelta(days=5), baseline="pre")


@plan(
    "a03_pre_event_baseline",
    with_sql(
        TICKS,
        LABELS,
        orders(),
        *features(_PRE, baseline="bar_time < pump_time"),
        select=f"SELECT pump_hash, currency_pair, {', '.join(_quoted_sql(c) for c in _ZSCORES)} FROM features",
    ),
)
def pre_event_baseline(spark, sf_dir):
    """The z-scores without look-ahead: only bars that start before the event set the baseline."""
    return rounded_features(spark, sf_dir, _PRE).select(GROUP, CANDIDATE, *[quoted(c) for c in _ZSCORES])


def _family(name: str, slugs=SLUGS) -> str:
    columns = ", ".join(f'"{name}@{s}"' for s in slugs)
    return with_sql(*panel_windows_ctes(), select=f"SELECT pump_hash, currency_pair, {columns} FROM features")


def _register_family(identifier: str, family: str, slugs=SLUGS) -> None:
    @plan(f"{identifier}_{family}", _family(family, slugs))
    def one_family(spark, sf_dir, family=family, slugs=slugs):
        rows = panel_features(spark, sf_dir)
        return rows.select(GROUP, CANDIDATE, *[quoted(f"{family}@{s}") for s in slugs])


for _identifier, _name in {
    "a04": "asset_return",
    "a05": "share_of_long_trades",
    "a06": "powerlaw_alpha",
    "a07": "slippage_imbalance",
    "a08": "flow_imbalance",
    "a09": "num_trades",
    "a10": "asset_return_zscore",
    "a11": "quote_abs_zscore",
}.items():
    _register_family(_identifier, _name)
_register_family("a12", "target_return", list(fx.PANEL_DECAYS))


@plan(
    "j01_event_tick_range_join",
    with_sql(
        TICKS,
        LABELS,
        select=f"""SELECT e.pump_hash, count(*) AS fills, {r('sum(t.price * t.quantity)', 'quote')}
        FROM labelled e JOIN ticks t ON t.trade_time BETWEEN e.pump_time - INTERVAL 30 DAY AND e.pump_time + INTERVAL 1 HOUR GROUP BY e.pump_hash""",
    ),
)
def event_tick_range_join(spark, sf_dir):
    """Market volume in every event's slice: hourly totals for whole hours, fills only in the two cut hours."""
    events = slices(fx.labels(spark, sf_dir), FeatureWindows(offsets={}, decays={}))
    return rounded(slice_totals(fx.ticks(spark, sf_dir), events))


@plan(
    "j11_prior_events",
    with_sql(
        LABELS,
        (
            "pairs",
            """SELECT e.pump_hash, s.symbol, e.pump_time FROM labelled e
            JOIN (SELECT DISTINCT pumped_currency_pair AS symbol, CAST(pump_time AS DATE) AS d FROM labelled) s ON s.d = CAST(e.pump_time AS DATE)""",
        ),
        select="""SELECT p.pump_hash, p.symbol AS currency_pair, count(l.pump_time) AS num_prev_pump FROM pairs p
        LEFT JOIN labelled l ON l.pumped_currency_pair = p.symbol AND l.pump_time < p.pump_time GROUP BY 1, 2""",
    ),
)
def prior_events(spark, sf_dir):
    labels = fx.labels(spark, sf_dir)
    symbols = labels.select(F.col("pumped_currency_pair").alias(CANDIDATE), F.to_date(EVENT_TIME).alias("d")).distinct()
    candidates = labels.withColumn("d", F.to_date(EVENT_TIME)).join(symbols, "d").select(GROUP, EVENT_TIME, CANDIDATE)
    return prior_event_count(candidates, labels).select(GROUP, CANDIDATE, NUM_PREV)


# --- Stores --------------------------------------------------------------------------------------------

@plan("s10_feature_store", with_sql(*panel_windows_ctes(), select="SELECT * FROM features"))
def feature_store(spark, sf_dir):
    path = scratch_path(spark, "features")
    panel_store.write_features(panel_features(spark, sf_dir), path)
    return panel_store.read_features(spark, path)


_ASSEMBLED = [GROUP, CANDIDATE, LABEL, *regressor_columns(SLUGS)]


@plan("s11_u01_panel_assembly", with_sql(*panel(), select=f"SELECT {', '.join(_quoted_sql(c) for c in _ASSEMBLED)} FROM panel"))
def panel_assembly(spark, sf_dir):
    labels = stored_labels(spark, sf_dir)
    rows = stored_features(spark, sf_dir, labels)
    # Two stores of features, as separate runs leave them, read as one panel.
    halves = [rows.where(F.crc32(F.col(GROUP)) % 2 == i) for i in range(2)]
    return pn.assemble_panel(pn.union_panels(halves), labels).select(*[quoted(c) for c in _ASSEMBLED])


_GHOSTS = "SELECT pump_hash, CASE WHEN CAST(regexp_extract(pump_hash, '([0-9]+)$', 1) AS BIGINT) % 2 = 0 THEN 'NONE-BTC' ELSE pumped_currency_pair END AS pumped_currency_pair, pump_time FROM labelled"


@plan(
    "s11_dropped_events",
    with_sql(
        LABELS,
        ("marked", _GHOSTS),
        select="""SELECT pumped_currency_pair AS currency_pair, strftime(pump_time, '%Y-%m-%dT%H:%M:%S') AS time, 'BINANCE_SPOT' AS exchange
        FROM marked WHERE pumped_currency_pair = 'NONE-BTC'""",
    ),
)
def dropped_events(spark, sf_dir):
    number = F.regexp_extract(GROUP, r"([0-9]+)$", 1).cast("bigint")
    target = F.when(number % 2 == 0, "NONE-BTC").otherwise(F.col("pumped_currency_pair"))
    labels = fx.labels(spark, sf_dir)
    marked = labels.withColumn("pumped_currency_pair", target)
    present = labels.select(GROUP, F.col("pumped_currency_pair").alias(CANDIDATE))
    path = scratch_path(spark, "dropped")
    event_source.write_dropped(pn.dropped_events(present, marked), path)
    return spark.read.schema("currency_pair STRING, time STRING, exchange STRING").json(path)


# --- Panel ---------------------------------------------------------------------------------------------


@plan("p07_positive_label", with_sql(*panel(), select="SELECT pump_hash, currency_pair, is_pumped FROM panel"))
def positive_label(spark, sf_dir):
    return build_panel(spark, sf_dir).select(GROUP, CANDIDATE, LABEL)


_CLIPPED = ", ".join(
    f'CASE WHEN "powerlaw_alpha@{s}" IS NOT NULL THEN least(greatest("powerlaw_alpha@{s}", 1), 2) END AS "powerlaw_alpha@{s}"'
    for s in SLUGS
)


@plan("p08_clip_tail", with_sql(*panel(), select=f"SELECT pump_hash, currency_pair, {_CLIPPED} FROM panel"))
def clip_tail(spark, sf_dir):
    clipped = pn.clip_tail_exponents(build_panel(spark, sf_dir), SLUGS)
    return rounded(clipped.select(GROUP, CANDIDATE, *[f"`powerlaw_alpha@{s}`" for s in SLUGS]))


@plan(
    "p18_groups_without_single_positive",
    with_sql(
        SCORED,
        select="""SELECT pump_hash, sum(CAST(is_pumped AS INT))::BIGINT AS positives FROM scored GROUP BY pump_hash HAVING sum(CAST(is_pumped AS INT)) <> 1""",
    ),
)
def groups_without_single_positive(spark, sf_dir):
    return pn.groups_without_single_positive(fx.scored(spark, sf_dir))


_REGRESSORS = ", ".join(f'"{c}"' for c in regressor_columns(SLUGS))


@plan("p10_p19_regressors", with_sql(*panel(), select=f"SELECT {_REGRESSORS} FROM panel"))
def regressors(spark, sf_dir):
    df = build_panel(spark, sf_dir)
    pn.check_columns(df, [*regressor_columns(SLUGS), LABEL])
    return rounded(pn.regressors(df, SLUGS))


@plan(
    "w02_group_ids",
    with_sql(LABELS, select="SELECT pump_hash, row_number() OVER (ORDER BY pump_time, pump_hash) - 1 AS pump_id FROM labelled"),
)
def group_ids(spark, sf_dir):
    return pn.group_ids(fx.labels(spark, sf_dir))


_RANKS = (
    "ranks",
    f"""SELECT pump_hash, positive_rank FROM (SELECT pump_hash, is_pumped, CASE WHEN "{SUCCESS}" IS NOT NULL THEN
    dense_rank() OVER (PARTITION BY pump_hash ORDER BY "{SUCCESS}" DESC NULLS LAST) END AS positive_rank FROM panel) WHERE is_pumped""",
)


@plan("w03_positive_rank", with_sql(*panel(), _RANKS, select="SELECT * FROM ranks"))
def positive_rank(spark, sf_dir):
    return pn.positive_dense_rank(build_panel(spark, sf_dir), SUCCESS)


_KEPT = ("kept", "SELECT * FROM panel WHERE pump_hash IN (SELECT pump_hash FROM ranks WHERE positive_rank IS NULL OR positive_rank < 40)")


@plan("w03_j07_failed_events", with_sql(*panel(), _RANKS, _KEPT, select="SELECT pump_hash, currency_pair FROM kept"))
def failed_events(spark, sf_dir):
    kept = pn.remove_failed_events(build_panel(spark, sf_dir), SUCCESS, worst_rank=40)
    return kept.select(GROUP, CANDIDATE)


def _scaled_sql(columns, source: str, guard: bool = True, digits: int = 6) -> str:
    parts = []
    for c in columns:
        w = "OVER (PARTITION BY pump_hash)"
        z = f'("{c}" - avg("{c}") {w}) / nullif(stddev_samp("{c}") {w}, 0)'
        value = f'CASE WHEN min("{c}") {w} = max("{c}") {w} THEN "{c}" ELSE {z} END' if guard else z
        parts.append(r(value, c, digits))
    return f"SELECT pump_hash, currency_pair, {', '.join(parts)} FROM {source}"


# Infinite tails have no mean: the scaled columns are the clipped ones, as the preprocessing does.
_CLIP_PANEL = (
    "clipped",
    "SELECT * REPLACE (" + ", ".join(f'CASE WHEN "powerlaw_alpha@{s}" IS NOT NULL THEN least(greatest("powerlaw_alpha@{s}", 1), 2) END AS "powerlaw_alpha@{s}"' for s in SLUGS) + ") FROM panel",
)
_SCALED = standardised_columns(SLUGS)


@plan("w04_standardise", with_sql(*panel(), _CLIP_PANEL, select=_scaled_sql(_SCALED, "clipped")))
def standardise(spark, sf_dir):
    df = pn.standardise(pn.clip_tail_exponents(build_panel(spark, sf_dir), SLUGS), _SCALED)
    return rounded(df.select(GROUP, CANDIDATE, *[quoted(c) for c in _SCALED]))


_PLAIN = [f"asset_return@{s}" for s in SLUGS]


@plan("w05_standardise_plain", with_sql(*panel(), select=_scaled_sql(_PLAIN, "panel", guard=False)))
def standardise_plain(spark, sf_dir):
    df = pn.standardise(build_panel(spark, sf_dir), _PLAIN, guard=False)
    return rounded(df.select(GROUP, CANDIDATE, *[quoted(c) for c in _PLAIN]))


def _filled_sql(columns, source: str, digits: int = 6) -> str:
    parts = [
        r(f'coalesce(CAST("{c}" AS DOUBLE), median(CAST("{c}" AS DOUBLE)) OVER (PARTITION BY pump_hash), (SELECT median(CAST("{c}" AS DOUBLE)) FROM {source}))', c, digits)
        for c in columns
    ]
    return f"SELECT pump_hash, currency_pair, {', '.join(parts)} FROM {source}"


_FILLED = regressor_columns(SLUGS)


@plan("w06_median_fill", with_sql(*panel(), _CLIP_PANEL, select=_filled_sql(_FILLED, "clipped")))
def median_fill(spark, sf_dir):
    clipped = pn.clip_tail_exponents(build_panel(spark, sf_dir), SLUGS)
    df = pn.fill_with_medians(clipped, _FILLED)
    return rounded(df.select(GROUP, CANDIDATE, *[quoted(c) for c in _FILLED]))


@plan(
    "w07_return_rank",
    with_sql(
        *panel(),
        ("filled", f'SELECT pump_hash, currency_pair, coalesce("{RANKED}", 0) AS v FROM panel'),
        select=f"""SELECT pump_hash, currency_pair, {r('(rank() OVER (PARTITION BY pump_hash ORDER BY v DESC) + (count(*) OVER (PARTITION BY pump_hash, v) - 1) / 2.0) / count(*) OVER (PARTITION BY pump_hash)', 'asset_return_rank')} FROM filled""",
    ),
)
def return_rank(spark, sf_dir):
    # Rounded like the check, so the two sides agree on which values tie.
    ranked = pn.percentile_rank(build_panel(spark, sf_dir), RANKED, "asset_return_rank")
    return rounded(ranked.select(GROUP, CANDIDATE, "asset_return_rank"))


_BOUNDARIES = [datetime(2024, 1, 15), datetime(2024, 1, 22)]


@plan(
    "u03_time_split",
    with_sql(
        LABELS,
        select="""SELECT pump_hash, CASE WHEN pump_time < TIMESTAMP '2024-01-15' THEN 'TRAIN' WHEN pump_time < TIMESTAMP '2024-01-22' THEN 'VALIDATION'
        ELSE 'TEST' END AS split FROM labelled""",
    ),
)
def time_split(spark, sf_dir):
    return pn.split_by_time(fx.labels(spark, sf_dir), _BOUNDARIES).select(GROUP, "split")


@plan(
    "u04_group_sample",
    with_sql(
        SCORED,
        ("groups", "SELECT pump_hash, row_number() OVER (ORDER BY md5(concat('7:', pump_hash)), pump_hash) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT pump_hash FROM scored)"),
        select="SELECT pump_hash, currency_pair FROM scored WHERE pump_hash IN (SELECT pump_hash FROM groups WHERE i < ceil(n * CAST(0.3 AS DOUBLE)))",
    ),
)
def group_sample(spark, sf_dir):
    return pn.sample_groups(fx.scored(spark, sf_dir), 0.3, 7).select(GROUP, CANDIDATE)


@plan(
    "u02_group_difference",
    with_sql(
        SCORED,
        select="""SELECT pump_hash, CASE WHEN bool_or(event_kind = 'a') THEN 'b' ELSE 'a' END AS missing_in FROM
        (SELECT DISTINCT pump_hash, 'a' AS event_kind FROM scored WHERE score > 0.9 UNION ALL SELECT DISTINCT pump_hash, 'b' FROM scored WHERE score_b > 0.9)
        GROUP BY pump_hash HAVING count(*) = 1""",
    ),
)
def group_difference(spark, sf_dir):
    scored = fx.scored(spark, sf_dir)
    return pn.group_set_difference(scored.where("score > 0.9"), scored.where("score_b > 0.9"))


@plan(
    "u05_cross_sections",
    with_sql(
        SCORED,
        select="""SELECT g.pump_hash, g.groups, s.candidates FROM (SELECT max(pump_hash) AS pump_hash, count(DISTINCT pump_hash) AS groups FROM scored) g
        JOIN (SELECT pump_hash, count(*) AS candidates FROM scored GROUP BY pump_hash) s ON s.pump_hash = g.pump_hash""",
    ),
)
def cross_sections(spark, sf_dir):
    """The number of distinct groups and the size of the last one, extracted by its id."""
    scored = fx.scored(spark, sf_dir)
    groups = pn.distinct_groups(scored)
    last = groups.agg(F.max(GROUP)).scalar()
    section = scored.where(F.col(GROUP) == last)
    return section.groupBy(GROUP).agg(groups.agg(F.count("*")).scalar().alias("groups"), F.count("*").alias("candidates"))


@plan(
    "a33_prior_event_histogram",
    with_sql(
        LABELS,
        ("counted", "SELECT a.pump_hash, count(b.pump_hash) AS num_prev_pump FROM labelled a LEFT JOIN labelled b ON a.pumped_currency_pair = b.pumped_currency_pair AND b.pump_time < a.pump_time GROUP BY a.pump_hash"),
        select='SELECT num_prev_pump, count(*) AS "count" FROM counted GROUP BY num_prev_pump',
    ),
)
def prior_event_histogram(spark, sf_dir):
    labels = fx.labels(spark, sf_dir)
    own = labels.select(GROUP, EVENT_TIME, F.col("pumped_currency_pair").alias(CANDIDATE))
    return pn.value_counts(prior_event_count(own, labels), NUM_PREV)


_HIST = ["flow_imbalance@7D", "asset_return@7D", "share_of_long_trades@14D"]


@plan(
    "a34_feature_histograms",
    with_sql(
        *panel(),
        ("long", " UNION ALL ".join(f"SELECT pump_hash, '{c}' AS feature, \"{c}\" AS x FROM panel WHERE \"{c}\" IS NOT NULL" for c in _HIST)),
        ("span", "SELECT feature, min(x) AS lo, max(x) AS hi FROM long GROUP BY feature"),
        select="""SELECT pump_hash, feature, bin, count(*) AS "count" FROM (SELECT pump_hash, l.feature,
        CAST(least(floor((x - lo) / ((hi - lo) / 50)) + 1, 50) AS BIGINT) AS bin FROM long l JOIN span s ON l.feature = s.feature) GROUP BY 1, 2, 3""",
    ),
)
def feature_histograms(spark, sf_dir):
    return rounded(pn.feature_histograms(build_panel(spark, sf_dir), _HIST))


def _variant_sql(variant: str) -> str:
    ctes = [*panel(), _RANKS, _KEPT, ("clipped", _CLIP_PANEL[1].replace("FROM panel", "FROM kept"))]
    source = "clipped"
    if variant == "logistic":
        ctes.append(("filled", _filled_sql(_FILLED, source, 15)))
        source = "filled"
    rest = ", ".join(f'"{c}"' for c in _FILLED if c not in _SCALED)
    scaled = _scaled_sql(_SCALED, source, digits=15)
    ctes.append(("scaled", scaled.replace("currency_pair,", f"currency_pair, {rest},", 1)))
    source = "scaled"
    if variant == "oversampled":
        ctes.append(("filled_after", _filled_sql(_FILLED, source, 15)))
        source = "filled_after"
    # Medians of two six-digit values have seven digits, so seven never rounds a tie.
    columns = ", ".join(r(f'"{c}"', c, 7) for c in _FILLED)
    if variant == "ranker":
        rank = """(rank() OVER (PARTITION BY pump_hash ORDER BY v DESC) + (count(*) OVER (PARTITION BY pump_hash, v) - 1) / 2.0)
        / count(*) OVER (PARTITION BY pump_hash)"""
        ctes.append(("valued", f'SELECT pump_hash, currency_pair, is_pumped, coalesce("{RANKED}", 0) AS v FROM kept'))
        ctes.append(("ranked", f"SELECT pump_hash, currency_pair, is_pumped, {r(rank, 'asset_return_rank', 7)} FROM valued"))
        return with_sql(*ctes, select=f"SELECT pump_hash, currency_pair, is_pumped, asset_return_rank, {columns} FROM scaled JOIN ranked USING (pump_hash, currency_pair)")
    return with_sql(*ctes, select=f"SELECT pump_hash, currency_pair, {columns} FROM {source}")


def preprocessed(spark: SparkSession, sf_dir: str, variant: str) -> DataFrame:
    labels = fx.labels(spark, sf_dir)
    return pn.preprocess(build_panel(spark, sf_dir), SLUGS, variant, SUCCESS, RANKED, worst_rank=40, events=labels)


@plan("l01_preprocess_default", _variant_sql("default"))
def preprocess_default(spark, sf_dir):
    df = preprocessed(spark, sf_dir, "default")
    return rounded(df.select(GROUP, CANDIDATE, *[quoted(c) for c in _FILLED]), 7)


@plan("l01_preprocess_logistic", _variant_sql("logistic"))
def preprocess_logistic(spark, sf_dir):
    df = preprocessed(spark, sf_dir, "logistic")
    return rounded(df.select(GROUP, CANDIDATE, *[quoted(c) for c in _FILLED]), 7)


@plan("l01_preprocess_oversampled", _variant_sql("oversampled"))
def preprocess_oversampled(spark, sf_dir):
    df = preprocessed(spark, sf_dir, "oversampled")
    return rounded(df.select(GROUP, CANDIDATE, *[quoted(c) for c in _FILLED]), 7)


@plan("l01_preprocess_ranker", _variant_sql("ranker"))
def preprocess_ranker(spark, sf_dir):
    df = preprocessed(spark, sf_dir, "ranker")
    return rounded(df.select(GROUP, CANDIDATE, LABEL, "asset_return_rank", *[quoted(c) for c in _FILLED]), 7)


@plan(
    "t01_top_k_portfolio",
    with_sql(
        SCORED,
        select=f"""SELECT pump_hash, currency_pair, rank, {r('1.0 / count(*) OVER (PARTITION BY pump_hash)', 'weight')} FROM
        (SELECT *, row_number() OVER (PARTITION BY pump_hash ORDER BY score DESC NULLS LAST, currency_pair) AS rank FROM scored) WHERE rank <= 5""",
    ),
)
def top_k_portfolio(spark, sf_dir):
    chosen = portfolio.select_top_k(fx.scored(spark, sf_dir), 5)
    return rounded(chosen.select(GROUP, CANDIDATE, "rank", "weight"))


_UNSCORED = "CASE WHEN score_b > 0.9 THEN CAST('nan' AS DOUBLE) WHEN score_b >= 0.1 THEN score END"


@plan(
    "t01_unscored_candidates",
    with_sql(
        SCORED,
        ("partly", f"SELECT pump_hash, currency_pair, {_UNSCORED} AS s FROM scored"),
        select=f"""SELECT pump_hash, currency_pair, rank, {r('1.0 / count(*) OVER (PARTITION BY pump_hash)', 'weight')} FROM
        (SELECT *, row_number() OVER (PARTITION BY pump_hash ORDER BY CASE WHEN NOT isnan(s) THEN s END DESC NULLS LAST, currency_pair) AS rank FROM partly)
        WHERE rank <= 5""",
    ),
)
def unscored_candidates(spark, sf_dir):
    """NULL and NaN scores rank behind every number."""
    partly = fx.scored(spark, sf_dir).withColumn("score", F.expr(_UNSCORED))
    chosen = portfolio.select_top_k(partly, 5)
    return rounded(chosen.select(GROUP, CANDIDATE, "rank", "weight"))
