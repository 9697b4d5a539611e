"""Model preparation, linear fits and experiment bookkeeping.

Data preparation is distributed (one-hot by generator columns, min-max
scaling as expressions fitted on the training split, feature scores by
aggregation); linear fits share one table of sums (``gram``), tree models are in
``trees``. Only bounded metadata reaches the driver: the one-hot vocabulary,
per-feature min / max, sums of products, selected feature names and metric rows.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators import features as fe
from larder.operators import gram
from larder.operators import scorers as sc
from larder.operators import stats as st

TARGET = "units_sold"
MAX_LEVELS = 1000  # category levels that a model may encode
DEFAULT_FEATURE_COUNTS = (4, 6, 8, 10, 12, 14)
RESULT_SCHEMA = ("experiment_id string, model_name string, feature_count int, selected_features string, "
                 "training_samples long, validation_samples long, training_seconds double, r2_score double, "
                 "mae double, mse double, rmse double, mape double, smape double, status string, error_message string")


def encode(df: DataFrame, train: DataFrame, groups=("category", "region")) -> tuple[DataFrame, list[str]]:
    """Add 0/1 columns for the training vocabulary of each group (unknown -> zeros)."""
    vocab = fe.one_hot_vocabulary(train, list(groups)).orderBy("group", "level").limit(MAX_LEVELS + 1).collect()
    if len(vocab) > MAX_LEVELS:  # a dense model column per level: beyond this the input must be hashed or grouped first
        raise ValueError(f"more than {MAX_LEVELS} category levels")
    names = [f"{r['group']}_{r['level']}" for r in vocab]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"encoded columns repeat: {repeated}")
    # A row's token is made once a group, not once a level.
    tokens = {g: f"_token_{g}" for g in groups if any(r["group"] == g for r in vocab)}
    hits = [F.when(F.col(tokens[r["group"]]) == r["level"], 1.0).otherwise(0.0).alias(n) for r, n in zip(vocab, names)
            if n not in df.columns]  # columns that are encoded already pass through
    return df.withColumns({name: fe.group_token(g) for g, name in tokens.items()}).select(*[f"`{c}`" for c in df.columns], *hits), names


def fit_minmax(train: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    row = train.agg(*[F.min(c).alias(f"lo_{i}") for i, c in enumerate(cols)],
                    *[F.max(c).alias(f"hi_{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"lo_{i}"], row[f"hi_{i}"]) for i, c in enumerate(cols)}


def feature_scores(train: DataFrame, candidates: list[str]) -> list[tuple[float, int, str]]:
    """(score, position, feature) of every candidate, best first; independent of how many are taken."""
    rows = st.mutual_info(train, candidates, TARGET, 10).collect()  # one row per candidate
    return sorted(((r["score"], r["position"], r["column"]) for r in rows), key=lambda x: (-x[0], x[1]))


def select_features(train: DataFrame, candidates: list[str], k: int, scores: list | None = None) -> list[str]:
    """The k best candidates in column order."""
    top = (scores or feature_scores(train, candidates))[:k]
    return [c for _, _, c in sorted(top, key=lambda x: x[1])]


class Prepared:
    """Encoded splits, candidate list and scaler ranges fitted on train only.

    ``store`` writes the encoded frame once; every fit reads it."""

    def __init__(self, frame: DataFrame, split_col: str = "split", exclude=("spoilage_risk",), store=lambda df: df):
        base = [c for c in ("shelf_life_days", "cost_price", "spoilage_sensitivity", "spoilage_risk",
                            "selling_price", "discount_pct", "is_promoted", "supplier_score", "storage_temp")
                if c not in exclude]
        train_raw = frame.where(F.col(split_col) == "train")
        enc, onehot = encode(frame, train_raw)
        enc = store(enc)
        self.frame = enc
        self.candidates = base + onehot
        self.train = enc.where(F.col(split_col) == "train")
        self.validation = enc.where(F.col(split_col) == "validation")
        self.test = enc.where(F.col(split_col) == "test")
        self.ranges = fit_minmax(self.train, self.candidates + [TARGET])
        self._moments = None

    def values(self, feats: list[str]) -> dict[str, Column]:
        """Inputs scaled by the training ranges; a missing one counts as the training minimum."""
        return {f: F.coalesce(v, F.lit(0.0)) for f, v in sc.scaled(self.frame, self.ranges, feats).items()}

    def moments(self) -> gram.Moments:
        """Sums of products of all scaled candidates and the scaled target over the training rows; one job, kept."""
        if self._moments is None:
            target = sc.scaled(self.frame, self.ranges, [TARGET])[TARGET]
            self._moments = gram.moments(self.train, self.values(self.candidates), target)
        return self._moments

    def predicted(self, fit: gram.LinearFit) -> Column:
        """A linear fit's prediction: inverse-scaled and clipped at 0."""
        lo, hi = self.ranges[TARGET]
        return F.greatest(F.lit(0.0), fe.min_max_inverse(fit.expression(self.values(fit.features)), F.lit(lo), F.lit(hi)))


def scored(prep: Prepared, fit: gram.LinearFit, rows: DataFrame) -> DataFrame:
    return rows.select("row_id", F.col(TARGET).cast("double").alias("actual"), prep.predicted(fit).alias("predicted"))


def feature_sweep(spark: SparkSession, prep: Prepared, counts=DEFAULT_FEATURE_COUNTS, alpha: float = 1.0) -> DataFrame:
    """Select -> scale -> fit -> validate for each feature count; failures are
    recorded as rows and the loop goes on. Impossible or repeated k skipped.

    All fits share one table of sums and all validations one pass over the
    validation rows. ``training_seconds`` is measured: a fit's own time plus its
    share of the time that the sums took.
    """
    n_train, n_val = prep.train.count(), prep.validation.count()
    scores = feature_scores(prep.train, prep.candidates)
    wanted = [k for k in dict.fromkeys(counts) if 1 <= k <= len(prep.candidates)]
    t0 = time.perf_counter()
    moments, failure = None, ""
    try:
        moments = prep.moments()
    except Exception as exc:  # noqa: BLE001 - recorded in every experiment's row
        failure = f"{type(exc).__name__}: {exc}"
    shared = (time.perf_counter() - t0) / max(len(wanted), 1)
    fits, seconds, errors = {}, {}, {}
    for k in wanted:
        t0 = time.perf_counter()
        try:
            if moments is None:
                raise RuntimeError(failure)
            fits[k] = gram.ridge(moments, select_features(prep.train, prep.candidates, k, scores), alpha)
        except Exception as exc:  # noqa: BLE001 - recorded as a failed experiment row
            errors[k] = f"{type(exc).__name__}: {exc}"
        seconds[k] = round(shared + time.perf_counter() - t0, 6)
    metrics = {}
    if fits:
        each = F.array(*[F.struct(F.lit(k).alias("k"), prep.predicted(fit).alias("predicted")) for k, fit in fits.items()])
        pred = prep.validation.select(F.col(TARGET).cast("double").alias("actual"), F.inline(each))
        metrics = {r["k"]: r for r in st.regression_metrics(pred, keys=["k"]).collect()}  # one row a feature count
    rows = []
    for k in wanted:
        feats = ",".join(fits[k].features) if k in fits else ""
        m = metrics.get(k)
        measures = [m[c] for c in ("r2", "mae", "mse", "rmse", "mape", "smape")] if m else [None] * 6
        rows.append((f"ridge_k{k}", "ridge", k, feats, n_train, n_val, seconds[k], *measures,
                     "failed" if k in errors else "success", errors.get(k, "")))
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def ranking() -> list:
    """Order of experiments: rounded R2 down, rounded MAE, RMSE, seconds, id."""
    return [F.bround("r2_score", 4).desc(), F.bround("mae", 4), F.col("rmse"), F.col("training_seconds"), F.col("experiment_id")]


def rank_experiments(results: DataFrame, model_name: str) -> DataFrame:
    """Successful rows of one model: round(R2,4) desc, round(MAE,4), RMSE, seconds, id."""
    ok = results.where((F.col("model_name") == model_name) & (F.col("status") == "success"))
    return ok.orderBy(*ranking())


def best_metric_by_k(results: DataFrame, metric: str = "r2_score") -> DataFrame:
    agg = F.max if metric == "r2_score" else F.min
    ok = results.where(F.col("status") == "success")
    return ok.groupBy("model_name", "feature_count").agg(agg(metric).alias(f"best_{metric}")) \
             .orderBy("model_name", "feature_count")


def fastest_by_k(results: DataFrame) -> DataFrame:
    ok = results.where(F.col("status") == "success")
    return ok.groupBy("model_name", "feature_count").agg(F.min("training_seconds").alias("fastest_seconds")) \
             .orderBy("model_name", "feature_count")


def save_model(spark: SparkSession, fit: gram.LinearFit, prep: Prepared, path: str, version: str = "1") -> None:
    """Weights, inputs in order and training ranges under ``path``."""
    ranges = {c: list(prep.ranges[c]) for c in [*fit.features, TARGET]}
    sc.save_scorer(spark, path, "linear", "ridge", version, fit.features,
                   {"weights": fit.weights, "intercept": fit.intercept, "ranges": ranges, "target": TARGET})
