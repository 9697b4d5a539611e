"""Column statistics, correlations, information scores and metrics.

Numeric frames are unpivoted to ``(column, value)`` so that one aggregation
serves every column. Exact quantiles and ranks never put a column into one
task: values are first counted (partial aggregation), then the running count
over the distinct values of each column (range-partitioned prefix sums, see
``prefix``) locates the ranks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.operators.prefix import running_total, running_totals
from larder.operators.repeats import MARK, mark_of, repeated_marks
from larder.session import stored


def long_numeric(df: DataFrame, cols: list[str], id_col: str | None = None) -> DataFrame:
    """Wide numeric frame -> (id?, column, position, value double)."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"),
                                 F.col(c).cast("double").alias("value")) for i, c in enumerate(cols)])
    keep = [id_col] if id_col else []
    return df.select(*keep, F.inline(entries))


def value_counts_by(long: DataFrame, keys: list[str]) -> DataFrame:
    return long.where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("c"))


def exact_quantiles(long: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """Linear-interpolation quantiles (the common default) per key, exact."""
    vc = value_counts_by(long, keys)
    cum = running_total(vc, keys, "value", "c", "cum")
    n = cum.groupBy(*keys).agg(F.sum("c").alias("n"))
    j = cum.join(n, keys)
    aggs = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("n") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs += [F.min(F.when(F.col("cum") > lo, F.col("value"))).alias(f"_{name}_lo"),
                 F.min(F.when(F.col("cum") > hi, F.col("value"))).alias(f"_{name}_hi"),
                 F.first(pos - lo).alias(f"_{name}_frac")]
    g = j.groupBy(*keys).agg(*aggs)
    out = g.select(*keys, *[(F.col(f"_{k}_lo") + (F.col(f"_{k}_hi") - F.col(f"_{k}_lo")) * F.col(f"_{k}_frac"))
                            .alias(k) for k in probs])
    return out


def describe_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles, max, skew, kurtosis (bias-corrected,
    as pandas), missing %, unique count per column."""
    long = long_numeric(df, cols)
    v = F.col("value")
    base = long.groupBy("column", "position").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(v).alias("count"), F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2"), F.count_distinct(v).alias("unique"))
    q = exact_quantiles(long, ["column"], {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    n = F.col("count").cast("double")
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, ((n + 1) * F.col("g2") + 6) * (n - 1) / ((n - 2) * (n - 3)))
    j = base.join(q, "column")
    r = lambda c: F.round(c, 6)
    return j.select("column", "count", r(F.col("mean")).alias("mean"), r(F.col("std")).alias("std"),
                    "min", r(F.col("q25")).alias("q25"), r(F.col("q50")).alias("q50"), r(F.col("q75")).alias("q75"),
                    "max", r(skew).alias("skew"), r(kurt).alias("kurtosis"),
                    r((F.col("n_rows") - F.col("count")) / F.col("n_rows") * 100).alias("missing_pct"),
                    "unique")


def histogram(df: DataFrame, cols: list[str], bins: int = 30) -> DataFrame:
    """Equal-width bins between each column's min and max (last bin closed); empty bins have n = 0."""
    long = long_numeric(df, cols).where(F.col("value").isNotNull())
    rng = long.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    j = long.join(F.broadcast(rng), "column")  # one row per column: bounded by the column count
    width = F.col("hi") - F.col("lo")
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) / width * bins))).cast("int")
    g = j.groupBy("column", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = rng.select("column", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(g, ["column", "bin"], "left").fillna(0, ["n"]).select("column", "bin",
                    F.round(F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins, 6).alias("bin_start"),
                    "n")


def box_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Quartiles, 1.5 IQR fences, whisker ends inside the fences, outlier count."""
    long = long_numeric(df, cols).where(F.col("value").isNotNull())
    q = exact_quantiles(long, ["column"], {"q1": 0.25, "median": 0.5, "q3": 0.75})
    q = q.withColumn("iqr", F.col("q3") - F.col("q1")) \
         .withColumn("lower_fence", F.col("q1") - 1.5 * F.col("iqr")) \
         .withColumn("upper_fence", F.col("q3") + 1.5 * F.col("iqr"))
    j = long.join(F.broadcast(q), "column")  # bounded by the column count
    v = F.col("value")
    inside = (v >= F.col("lower_fence")) & (v <= F.col("upper_fence"))
    g = j.groupBy("column", "q1", "median", "q3", "iqr", "lower_fence", "upper_fence").agg(
        F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"))
    return g.select("column", *[F.round(c, 6).alias(c) for c in
                                ["q1", "median", "q3", "iqr", "lower_fence", "upper_fence"]],
                    "whisker_low", "whisker_high", "n_outliers")


def corr_pearson(df: DataFrame, cols: list[str], pairs: list[tuple[str, str]] | None = None,
                 values: dict[tuple[str, str], tuple[Column, Column]] | None = None) -> DataFrame:
    """Pairwise Pearson matrix (upper triangle or the given pairs), pairwise-complete rows, one aggregation.

    ``values`` has what to correlate for a pair where that is not its two columns."""
    pairs = pairs or [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    row = df.agg(*[F.corr(*(values or {}).get((a, b), (a, b))).alias(f"{a}__{b}") for a, b in pairs])
    stack = ", ".join(f"'{a}', '{b}', `{a}__{b}`" for a, b in pairs)
    out = row.selectExpr(f"stack({len(pairs)}, {stack}) as (col_a, col_b, corr)")
    return out.withColumn("corr", F.round("corr", 6))


#: Values of a column up to which its table of ranks is copied to every task; a longer one is joined by shuffle.
RANKED_VALUES = 100_000


def _complete(present: tuple[str, ...]) -> Column:
    ok = F.lit(True)
    for c in present:
        ok = ok & F.col(c).isNotNull()
    return ok


def average_ranks(df: DataFrame, cols: list[str], groups: list[tuple[tuple[str, ...], list[str]]], few: int = RANKED_VALUES) -> DataFrame:
    """The rows and, as ``_rank_<g>_<column>``, the average rank (ties share the mean rank) of each column of group g.

    A group ranks its columns over the rows where its own columns (the first of
    the pair) are present. The values of all columns are counted for every group at once;
    the rows stay wide: a column of few values looks its ranks up in a copied
    table, and only for a column of more than ``few`` values do the rows move.
    """
    places = list(enumerate(groups))

    def value(c):
        return F.col(c).cast("double")

    # Which groups a row's value counts for, as 0 and 1.
    each = F.array(*[F.struct(F.lit(c).alias("column"), value(c).alias("value"),
                              *[(_complete(present) if c in used else F.lit(False)).cast("int").alias(f"in{g}") for g, (present, used) in places])
                     for c in cols])
    counted = df.select(F.inline(each)).where(F.col("value").isNotNull()).groupBy("column", "value").agg(
        *[F.sum(f"in{g}").alias(f"c{g}") for g, _ in places])
    upto = running_totals(counted, ["column"], "value", {f"upto{g}": f"c{g}" for g, _ in places})
    ranks = stored(upto.select("column", "value", *[F.when(F.col(f"c{g}") > 0, F.col(f"upto{g}") - (F.col(f"c{g}") - 1) / 2.0).alias(f"r{g}")
                                                    for g, _ in places]), "ranks")
    sizes = {r["column"]: r["n"] for r in ranks.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a column
    rows = df
    # Columns of many values come first: the rows then move without the ranks of the others.
    for c in sorted(cols, key=lambda c: -sizes.get(c, 0)):
        table = ranks.where(F.col("column") == c).select(F.col("value").alias("_value"), *[F.col(f"r{g}").alias(f"_rank_{g}_{c}")
                                                                                          for g, (_, used) in places if c in used])
        rows = rows.join(F.broadcast(table) if sizes.get(c, 0) <= few else table, value(c) == F.col("_value"), "left").drop("_value")
    return rows


def corr_spearman(df: DataFrame, cols: list[str], id_col: str, few: int = RANKED_VALUES) -> DataFrame:
    """Spearman = Pearson on average ranks, pairwise complete.

    Ranks depend on which rows are complete, and that only on the columns with
    nulls in a pair, so pairs are grouped by those columns: one ranking per
    group over the rows where they are present (columns without nulls share one).
    Rows of one ``id_col`` count as one row, with their highest rank in each column.
    """
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()  # one row
    groups: dict[tuple, list[tuple[str, str]]] = {}
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            groups.setdefault(tuple(c for c in (a, b) if nulls[c]), []).append((a, b))
    used = [(present, [c for c in cols if any(c in p for p in pairs)]) for present, pairs in groups.items()]
    ranked = average_ranks(df.select(id_col, *[c for c in cols if c != id_col]), cols, used, few)
    wide = ranked.select(id_col, *[F.when(_complete(present), F.col(f"_rank_{g}_{c}")).alias(f"_at_{g}_{c}")
                                   for g, (present, mine) in enumerate(used) for c in mine])
    repeated, mark = repeated_marks(df, [id_col]), mark_of([id_col])
    if not repeated.isEmpty():  # only rows that share an id move
        more = wide.join(repeated, mark == F.col(MARK), "left_semi")
        more = more.groupBy(id_col).agg(*[F.max(c).alias(c) for c in wide.columns if c != id_col])
        wide = wide.join(repeated, mark == F.col(MARK), "left_anti").unionByName(more)
    values = {(a, b): (F.col(f"_at_{g}_{a}"), F.col(f"_at_{g}_{b}")) for g, pairs in enumerate(groups.values()) for a, b in pairs}
    return corr_pearson(wide, cols, list(values), values)


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(values, which of them are given) of batches with one array column of ``width`` numbers."""
    for b in batches:
        if b.num_rows:
            flat = b.column(0).flatten()
            given = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, width)
            yield np.asfortranarray(flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)), given


def _wider(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    """(least, greatest, least, greatest) of both; NaN counts as the greatest number."""
    return b if a is None else np.array([np.fmin(a[0], b[0]), np.maximum(a[1], b[1]), np.fmin(a[2], b[2]), np.maximum(a[3], b[3])])


def mutual_info(df: DataFrame, cols: list[str], target: str, bins: int = 10) -> DataFrame:
    """Binned mutual information (nats) of each feature with the target.

    Equal-width bins for feature and target, contingency counts by one
    aggregation, then sum p * ln(p / (p_f * p_t)). Tasks count in small tables
    over Arrow batches, so a row is not multiplied by the number of columns.
    """
    rows = df.where(F.col(target).isNotNull()).select(F.array(*[F.col(c).cast("double") for c in [*cols, target]]).alias("x"))
    width, kinds = len(cols), "position int, lo double, hi double, tlo double, thi double"

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Least and greatest value of each column and of the target beside it; one row a column and task."""
        found: dict[int, np.ndarray] = {}
        for x, given in _matrices(batches, width + 1):
            for i in range(width):
                here = given[:, i]
                if here.any():
                    v, t = x[here, i], x[here, width]
                    found[i] = _wider(found.get(i), np.array([np.fmin.reduce(v), np.max(v), np.fmin.reduce(t), np.max(t)]))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), *[pa.array([e[k] for e in found.values()], pa.float64()) for k in range(4)]],
                                         names=["position", "lo", "hi", "tlo", "thi"])

    seen = rows.mapInArrow(ends, kinds).groupBy("position").agg(F.min("lo"), F.max("hi"), F.min("tlo"), F.max("thi")).collect()  # one row a column
    limits = {r[0]: tuple(r)[1:] for r in seen}

    def binned(v, lo, hi):
        if hi == lo:
            return np.zeros(len(v), dtype=np.int64)
        with np.errstate(all="ignore"):
            at = np.floor((v - lo) / (hi - lo) * bins)
        return np.where(np.isnan(at), 0, np.minimum(at, bins - 1)).astype(np.int64)

    def contingency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by (column, bin of the feature, bin of the target): at most columns x bins x bins a task."""
        counts = np.zeros((width, bins * bins), dtype=np.int64)
        for x, given in _matrices(batches, width + 1):
            targets: dict[tuple, np.ndarray] = {}  # columns without gaps share the target's bins
            for i, (lo, hi, tlo, thi) in limits.items():
                if (tlo, thi) not in targets:
                    targets[tlo, thi] = binned(x[:, width], tlo, thi)
                here = given[:, i]
                at = binned(x[here, i], lo, hi) * bins + targets[tlo, thi][here]
                counts[i] += np.bincount(at, minlength=bins * bins)
        i, at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array((at // bins).astype(np.int32)), pa.array((at % bins).astype(np.int32)),
                                          pa.array(counts[i, at])], names=["position", "fb", "tb", "c"])

    names = F.array(*[F.lit(c) for c in cols])
    cells = rows.mapInArrow(contingency, "position int, fb int, tb int, c bigint").groupBy("position", "fb", "tb").agg(F.sum("c").alias("c")) \
        .withColumn("column", F.element_at(names, F.col("position") + 1))
    wf = Window.partitionBy("column", "fb")
    wt = Window.partitionBy("column", "tb")
    wn = Window.partitionBy("column")
    p = cells.select("column", "position", "c",
                     F.sum("c").over(wf).alias("cf"), F.sum("c").over(wt).alias("ct"), F.sum("c").over(wn).alias("n"))
    term = (F.col("c") / F.col("n")) * F.log((F.col("c") * F.col("n")) / (F.col("cf") * F.col("ct")))
    return p.groupBy("column", "position").agg(F.round(F.sum(term), 6).alias("score"))


def select_k_best(scores: DataFrame, k: int) -> DataFrame:
    """k highest scores (ties: earlier column first), returned in column order."""
    w = Window.orderBy(F.col("score").desc(), F.col("position"))  # one row per feature: bounded
    return scores.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k).drop("_rk")


def regression_metrics(pred: DataFrame, actual: str = "actual", predicted: str = "predicted",
                       keys: list[str] = ()) -> DataFrame:
    """R2, MAE, MSE, RMSE, MAPE (x100, |actual| > 1e-8 only; null if none), sMAPE
    (x100, |a|+|p| > 1e-8 only; 0 if none), from sums in one aggregation."""
    a, p = F.col(actual), F.col(predicted)
    err = p - a
    mape_ok = F.abs(a) > 1e-8
    sm_den = F.abs(a) + F.abs(p)
    sm_ok = sm_den > 1e-8
    g = pred.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.abs(err)).alias("sae"), F.sum(err * err).alias("sse"),
        F.var_pop(a).alias("va"),
        F.sum(F.when(mape_ok, F.abs(err) / F.abs(a))).alias("sape"), F.count_if(mape_ok).alias("n_ape"),
        F.sum(F.when(sm_ok, 2 * F.abs(err) / sm_den)).alias("ssape"), F.count_if(sm_ok).alias("n_sape"))
    sst = F.col("va") * F.col("n")
    r = lambda c: F.round(c, 6)
    return g.select(*keys, "n",
                    r(1 - F.col("sse") / F.nullif(sst, F.lit(0.0))).alias("r2"),
                    r(F.col("sae") / F.col("n")).alias("mae"),
                    r(F.col("sse") / F.col("n")).alias("mse"),
                    r(F.sqrt(F.col("sse") / F.col("n"))).alias("rmse"),
                    r(F.when(F.col("n_ape") > 0, F.col("sape") / F.col("n_ape") * 100)).alias("mape"),
                    r(F.when(F.col("n_sape") > 0, F.col("ssape") / F.col("n_sape") * 100)
                      .otherwise(F.lit(0.0))).alias("smape"))
